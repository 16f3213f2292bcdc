"""Positions, running sums and shuffles against plain Python; the plans' shapes."""

import pytest
from pyspark.sql import functions as F

from vocalframe.operators import splits
from vocalframe.operators.numbering import number_in_groups, number_rows, running_sums
from vocalframe.operators.permute import WALK, bases, original, permuted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 1000, 4097, 12_345])
def test_shuffle_is_a_bijection_and_undone(spark, n):
    df = spark.range(n).select("id", permuted(F.col("id"), n, 42).alias("q"), permuted(F.col("id"), n, 43).alias("other"))
    rows = df.withColumn("back", original(F.col("q"), n, 42)).collect()
    assert sorted(r.q for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 1000:
        assert sum(r.q == r.id for r in rows) < 20 and sum(r.q == r.other for r in rows) < 20
        # neighbours are torn apart: the mean distance of a shuffle is n / 3
        q = [r.q for r in sorted(rows, key=lambda r: r.id)]
        assert 0.25 * n < sum(abs(a - b) for a, b in zip(q, q[1:])) / n < 0.42 * n


def test_small_tables_always_land():
    assert all(a * b - n < WALK and a * b >= n for n in range(1, 4096) for a, b in [bases(n)])


def test_shuffle_of_large_numbers_and_odd_positions(spark):
    n = (1 << 59) + 12_345
    p = [0, 1, n - 1, n // 3, 1 << 52]
    df = spark.createDataFrame([(x,) for x in p], "p long").select("p", permuted(F.col("p"), n, "s").alias("q"))
    got = df.withColumn("back", original(F.col("q"), n, "s")).collect()
    assert [r.back for r in got] == p and len({r.q for r in got}) == 5 and all(0 <= r.q < n for r in got)
    none = spark.createDataFrame([(None,)], "p long")
    assert none.select(permuted(F.col("p"), 5, 1).alias("q")).first().q is None
    with pytest.raises(Exception, match="outside"):
        spark.range(6).select(permuted(F.col("id"), 5, 1)).collect()
    with pytest.raises(ValueError):
        permuted(F.col("p"), 1 << 61, 1)


def test_shuffling_moves_no_row(spark):
    df = spark.range(1000).withColumn("b", splits.shuffled_batch(F.col("id"), 1000, 7, 8)) \
        .withColumn("split", splits.ratio_role(F.col("id"), 1000, 7))
    assert "Exchange" not in plan(df) and "Sort" not in plan(df) and "Window" not in plan(df)
    assert {r["count"] for r in df.groupBy("b").count().collect()} == {8}
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 800, "validation": 100, "test": 100}


def test_numbering_builds_with_one_write_and_no_sample(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), F.lit("x").alias("v"))
    out = number_rows(df, ["k"], parts=7)
    assert "Sample" not in plan(out) and "BroadcastHashJoin" in plan(out) and "SinglePartition" in plan(out)   # the range totals
    assert [(r.k, r.ordinal) for r in out.orderBy("k").collect()] == [(k, k) for k in range(5000)]
    assert out.columns == ["k", "v", "ordinal"]
    assert number_rows(df.where("false"), ["k"]).count() == 0 and number_in_groups(df.where("false"), ["v"], ["k"]).count() == 0


def test_null_keys_ties_and_clashing_names(spark):
    rows = [(None, 3, "a"), (None, 1, "b"), ("s", 2, "c"), ("s", None, "d"), ("t", 9, "e"), ("t", 9, "e")]
    df = spark.createDataFrame(rows, "speaker string, idx int, ordinal string")
    got = {(r.speaker, r.idx): r.n for r in number_in_groups(df, ["speaker"], ["idx"], "n", parts=3).collect() if r.speaker != "t"}
    assert got == {(None, 1): 0, (None, 3): 1, ("s", None): 0, ("s", 2): 1}
    assert sorted(r.n for r in number_in_groups(df, ["speaker"], ["idx"], "n").where("speaker = 't'").collect()) == [0, 1]
    everywhere = number_rows(df, ["speaker", "idx"], "n", parts=4).collect()
    assert sorted(r.n for r in everywhere) == list(range(6)) and everywhere[0].asDict().keys() == {"speaker", "idx", "ordinal", "n"}


def test_hot_group_is_dealt_over_ranges(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("s"), "id")
    out = number_in_groups(df, ["s"], ["id"], parts=12).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.id):
        assert r.ordinal == seen.get(r.s, 0)
        seen[r.s] = r.ordinal + 1


def test_running_sums(spark):
    rows = [(i, float(i % 7) if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, x double").repartition(5)
    got = {r.i: (r.total, r.n) for r in running_sums(df.withColumn("one", F.lit(1)), ["i"], {"total": "x", "n": "one"}, parts=9).collect()}
    total = 0.0
    for i, x in rows:
        total += x or 0.0
        assert got[i] == (total, i + 1)
