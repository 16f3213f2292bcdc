"""Row positions and running aggregates without funnelling a group, or the whole table, into one task.

``Window.orderBy(...)`` without a partition moves every row to one task, and a
per-speaker window moves a hot speaker to one task. Here rows are dealt by ranges
of the order, sorted inside their partition and written once, each with its range
and its place in it. Everything else is sums per range: a row's position is its place
plus the number of rows in earlier ranges, and a running aggregate is a scan inside
the range plus the aggregate of the earlier ranges.

The ranges are Spark's own (``repartitionByRange``); the write is what makes all
later reads agree on them and cuts the lineage, so a lost executor costs a re-read.
Building the frame runs that write only. Tables of one row per range are as long as
there are shuffle partitions; they are windowed and broadcast. Tables of one row per
(range, group) hold at most ranges + groups rows and are joined, adaptively.

Pass narrow rows: what is passed is written. ``then`` maps the sorted rows one for one, in
their order, just before the write: columns that it adds are neither sampled for the ranges
nor shuffled. Nulls come first in the order, and a null group is a group. Rows with equal
order keys share a range and get positions in an arbitrary but fixed order. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.session import written

PLACE_BITS = 33     # monotonically_increasing_id: the partition above, the row in it below


def dealt(df: DataFrame, order: Sequence[str], parts: int | None = None,
          then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` in order, written once (after ``then``), with ``_range`` (their order is that of the rows)
    and ``_place`` (0-based inside the range)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(then(rows) if then else rows)
    at = F.col("_at")
    return rows.select(*[c for c in rows.columns if c != "_at"], F.shiftright(at, PLACE_BITS).alias("_range"),
                       at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"))


def before(per_range: DataFrame, *sums: str) -> DataFrame:
    """One row per range: each named column becomes its sum over all earlier ranges."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums])


def number_rows(df: DataFrame, order: Sequence[str], name: str = "ordinal", parts: int | None = None,
                then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """0-based position of each row in ``order``."""
    rows = dealt(df, order, parts, then)
    earlier = before(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_earlier")), "_earlier")
    out = rows.join(F.broadcast(earlier), "_range")             # one row per range
    given = [c for c in rows.columns if c not in ("_range", "_place")]
    return out.select(*given, (F.col("_earlier") + F.col("_place")).cast("bigint").alias(name))


def number_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal",
                     parts: int | None = None) -> DataFrame:
    """0-based position of each row within its ``keys`` group, in ``order``. A hot group lies
    in several ranges; rows meet their group's start by (range, group), never by group alone."""
    rows = dealt(df, [*keys, *order], parts)
    runs = rows.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # a group's rows in earlier ranges; a group has at most one run per range
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_range", *keys, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = runs.withColumnsRenamed({c: f"_run_{c}" for c in ["_range", *keys]})
    same = [F.col(c).eqNullSafe(F.col(f"_run_{c}")) for c in ["_range", *keys]]
    out = rows.join(runs, same)
    return out.select(*df.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name))


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """``df`` with running sums (this row included) of numeric columns in ``order``: ``sums`` maps
    result names to columns. A sum per range, the earlier ranges' sums, and a scan inside the range."""
    rows = dealt(df, order, parts)
    per = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier = before(per, *[f"_sum_{n}" for n in sums])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()]).join(F.broadcast(earlier), "_range")
    return out.select(*df.columns, *[(F.coalesce(f"_in_{n}", F.lit(0)) + F.col(f"_sum_{n}")).alias(n) for n in sums])
