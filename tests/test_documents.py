"""Ordered documents: every shape against the json module, commits and aborts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vocalframe.sources import documents


def frame(spark, n):
    rows = [(7 * i, f"s/{i}.wav", f"s{i % 3}", f'he said "{i}"\nnew line é', f"ref {i}" if i % 5 else None, "pn", "rn") for i in range(n)]
    df = spark.createDataFrame(rows, "idx long, audio_path string, speaker string, prediction string, reference string, pn string, rn string")
    df = df.withColumns({"transcription": F.col("reference"), "pred_normalized": F.col("pn"), "normalized_prediction": F.col("pn"),
                         "trans_normalized": F.col("rn"), "normalized_reference": F.col("rn")})
    return df.repartition(5), rows


@pytest.mark.parametrize("n", [0, 1, 500])
def test_every_shape_round_trips(spark, tmp_path, n):
    df, rows = frame(spark, n)
    at = {s: str(tmp_path / "sub" / f"{s}.json") for s in documents.SHAPES}
    for shape, path in at.items():
        documents.write_predictions(df, path, shape)
        documents.write_predictions(df, path, shape)                       # replaces
    text = {s: open(p, encoding="utf-8").read() for s, p in at.items()}
    assert json.loads(text["array"]) == [{"audio_path": r[1], "prediction": r[3]} for r in rows]
    assert json.loads(text["samples"]) == {"samples": [{"prediction": r[3], "reference": r[4]} for r in rows]}
    lines = [json.loads(x) for x in text["lines"].splitlines() if x]
    assert lines == [{"speaker": r[2], "transcription": r[4], "prediction": r[3], "pred_normalized": "pn", "trans_normalized": "rn"} for r in rows]
    indexed = [json.loads(x) for x in text["indexed"].splitlines() if x]
    assert indexed == [{"idx": k, "prediction": r[3], "reference": r[4], "normalized_prediction": "pn", "normalized_reference": "rn"}
                       for k, r in enumerate(rows)]
    assert sorted(os.listdir(tmp_path / "sub")) == sorted(f"{s}.json" for s in documents.SHAPES)      # no fragments left
    for shape, schema in (("samples", "prediction string, reference string"), ("array", "audio_path string, prediction string")):
        back = documents.read_document(spark, at[shape], schema).collect()
        assert sorted(r.prediction for r in back) == sorted(r[3] for r in rows)


def test_failed_jobs_leave_the_old_document(spark, tmp_path):
    df, _ = frame(spark, 50)
    path = str(tmp_path / "d.json")
    documents.write_predictions(df, path, "samples")
    old = open(path).read()
    broken = F.when(F.col("idx") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("prediction"))
    with pytest.raises(Exception, match="no"):
        documents.write_document(df, broken, ["idx"], path)
    assert open(path).read() == old and os.listdir(tmp_path) == ["d.json"]
    with pytest.raises(Exception, match="exists"):
        documents.write_document(df, F.col("prediction"), ["idx"], path, overwrite=False)
    assert open(path).read() == old and os.listdir(tmp_path) == ["d.json"]


def test_unknown_shapes_and_missing_columns_raise(spark, tmp_path):
    df, _ = frame(spark, 2)
    with pytest.raises(ValueError, match="unknown prediction shape"):
        documents.write_predictions(df, str(tmp_path / "x"), "table")
    with pytest.raises(ValueError, match="reference"):
        documents.write_predictions(df.drop("reference"), str(tmp_path / "x"), "samples")
    assert os.listdir(tmp_path) == []
