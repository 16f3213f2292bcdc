"""Positions and neighbours in a global order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.llm.store import keep


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` and written once; ``part`` numbers the
    ranges in order. Equal keys share a range. Nulls come first."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()))


def part_offsets(kept: DataFrame, **sums: str) -> DataFrame:
    """One row per range (as many as there are shuffle partitions) with the sum of
    each named column over all earlier ranges."""
    per = kept.groupBy("part").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in sums.items()])
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint").alias(n) for n in sums])


def with_next(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds ``next_key`` and ``next_tie``: the following row in (key, tie) order,
    the first row after the last. ``df`` should be narrow."""
    kept = ranged(df, key, tie)
    w = Window.partitionBy("part").orderBy(F.col(key).asc_nulls_first(), tie)
    inner = kept.withColumn("_n", F.lead(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).over(w))
    # one row per range from here on
    heads = kept.groupBy("part").agg(F.min(F.struct(F.col(key).isNotNull().alias("_p"), F.col(key).alias("k"),
                                                    F.col(tie).alias("t"))).alias("h"))
    w1 = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("h").over(w1), F.first("h").over(whole)).alias("h"))
    out = inner.join(F.broadcast(heads), "part")
    nxt = F.when(F.col("_n").isNull(), F.struct(F.col("h.k"), F.col("h.t"))).otherwise(F.col("_n"))
    return out.withColumn("_n", nxt).select(*df.columns, F.col("_n.k").alias("next_key"), F.col("_n.t").alias("next_tie"))
