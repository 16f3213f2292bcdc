"""User metrics from mergeable states and user models with named tensors."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocalframe.operators import infer


def frame(spark, n=9000):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 == 0 else None if i % 17 == 0 else f"g{i % 40}", i % 2, int(rng.integers(0, 400)) if i % 13 else None) for i in range(n)]
    return spark.createDataFrame([*rows, ("empty", 0, None)], "k string, side int, x int").repartition(6), rows


@pytest.mark.parametrize("salts", [1, 4, 32])
def test_medians_and_distinct_counts_match_pandas(spark, monkeypatch, salts):
    df, rows = frame(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")       # many states a group
    try:
        got = {(r.k, r.side): (r.m, r.d) for r in infer.group_metrics(df, ["k", "side"], infer.median_of("x"), "m", salts).join(
            infer.group_metrics(df, ["k", "side"], infer.distinct_of("x"), "d", salts).withColumnsRenamed({"k": "k2", "side": "s2"}),
            F.col("k").eqNullSafe(F.col("k2")) & (F.col("side") == F.col("s2"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=["k", "side", "x"])
    want = {(None if pd.isna(k) else k, s): (g.x.median(), float(g.x.nunique())) for (k, s), g in pdf.groupby(["k", "side"], dropna=False)}
    assert got == {**want, ("empty", 0): (None, 0.0)}
    assert infer.group_metrics(df.where("false"), ["k"], infer.median_of("x")).count() == 0


def test_a_user_metric_of_any_kind(spark):
    """The longest run of letters: a state that is a text."""
    metric = infer.Metric(lambda rows: max(rows.t, key=lambda t: (len(t), t)).encode(), lambda a, b: max(a, b, key=lambda x: (len(x), x)),
                          lambda s: float(len(s)))
    df = spark.createDataFrame([(1, "ab"), (1, "abc"), (2, "x"), (1, "")], "k int, t string").repartition(3)
    assert {r.k: r.metric for r in infer.group_metrics(df, ["k"], metric).collect()} == {1: 3.0, 2: 1.0}


def test_named_tensors_and_struct_results(spark, tmp_path):
    path = str(tmp_path / "w.json")
    w = [[1.0, 0.0, -1.0], [0.5, 2.0, 0.0]]
    json.dump({"classes": [4, 9], "weights": w}, open(path, "w"))
    x = np.random.default_rng(1).integers(-9, 9, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(x)], "i int, v array<double>, o double").repartition(4)
    got = infer.predict_tensors(df, infer.linear_classes(path), {"x": F.col("v"), "offset": F.col("o")}, "struct<label:int,score:double>",
                                {"x": [3]}, batch_size=7).orderBy("i").collect()
    scores = x @ np.array(w).T
    assert [r.prediction.label for r in got] == [(4, 9)[k] for k in scores.argmax(1)]
    assert [r.prediction.score for r in got] == [s.max() + i for i, s in enumerate(scores)]
