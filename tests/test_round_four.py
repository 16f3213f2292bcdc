"""Prediction documents of one numbered table: no table and no shuffle for each document."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from vocalframe.operators.numbering import number_rows
from vocalframe.session import checkpoint_dir
from vocalframe.sources import documents


def test_prediction_documents_write_one_table_in_order(spark, tmp_path):
    """The query once wrote a table of the texts and a second one of them to number a document's records."""
    from vocalframe.plans.sinks import prediction_documents
    rows = [(3, "src1", "en", "One (two) three!\n\n  \nFOUR five"), (1, "src2", "en", 'a "quoted" é line'), (2, None, "en", "x\ty"),
            (None, "src3", "en", "of no document"), (4, "src1", "en", None), (5, "src1", "en", "\n")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    at = checkpoint_dir(spark).removeprefix("file://")
    kept = lambda kind: {p for p in glob.glob(f"{at}/**/{kind}-*", recursive=True) if os.path.isdir(p)}
    tables, folders = kept("table"), kept("predictions")
    out = prediction_documents(spark, str(tmp_path))
    assert len(kept("table") - tables) == 1
    (folder,) = kept("predictions") - folders
    assert sorted(os.listdir(folder)) == sorted(f"{s}.json" for s in documents.SHAPES)
    texts = ["of no document", 'a "quoted" é line', "x\ty", "One (two) three!", "FOUR five"]
    text = {s: open(f"{folder}/{s}.json", encoding="utf-8").read() for s in documents.SHAPES}
    assert [r["reference"] for r in json.loads(text["samples"])["samples"]] == texts
    assert [r["audio_path"] for r in json.loads(text["array"])] == [None, f"src2/{1 << 32}.wav", None, f"src1/{3 << 32}.wav", f"src1/{(3 << 32) + 3}.wav"]
    assert [json.loads(x)["transcription"] for x in text["lines"].splitlines()] == texts
    indexed = [json.loads(x) for x in text["indexed"].splitlines()]
    assert [(r["idx"], r["reference"]) for r in indexed] == list(enumerate(texts))
    assert sorted((r.shape, r.idx, r.prediction) for r in out.where("shape = 'indexed'").collect()) == [
        ("indexed", r["idx"], r["prediction"]) for r in indexed]
    assert out.groupBy("shape").count().where("count != 5").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered_rows_are_strung_together_by_place_however_they_lie(spark, tmp_path, parts):
    df = spark.range(200).select(F.col("id").alias("place"), F.when(F.col("id") % 50 != 9, F.concat(F.lit("r"), "id")).alias("v"))
    kept = "\n".join(f"r{k}" for k in range(200) if k % 50 != 9)
    for rows in (df.repartition(parts, "v"), df.repartitionByRange(parts, F.desc("place")), df.coalesce(1).orderBy(F.desc("place"))):
        documents.write_document(rows, F.col("v"), [], str(tmp_path / "d"), head="<\n", foot="\n>", position="place")
        assert open(tmp_path / "d").read() == f"<\n{kept}\n>"
    documents.write_document(df.where("false"), F.col("v"), [], str(tmp_path / "d"), head="<", foot=">", position="place")
    assert open(tmp_path / "d").read() == "<>" and os.listdir(tmp_path) == ["d"]


def test_rows_are_numbered_before_what_is_added_to_them(spark):
    df = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate([5, None, 3, 5, 9, 1, None])], "k int, v string").repartition(4)
    out = number_rows(df, ["k"], "n", parts=3, then=lambda rows: rows.withColumn("w", F.upper("v")).drop("v"))
    assert out.columns == ["k", "w", "n"]
    got = out.orderBy("n").collect()
    assert [(r.n, r.k) for r in got] == list(enumerate([None, None, 1, 3, 5, 5, 9]))
    assert sorted(r.w for r in got) == [f"V{i}" for i in range(7)]
