"""Cases the first verdict found: nulls, separators, time zones, empty channels, odd roots."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vocalframe.functions import paths
from vocalframe.operators import numbering, runs, splits
from vocalframe.operators import waveform as X
from vocalframe.sources import files


def test_upsert_keeps_stored_fields_and_explicit_nulls(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, wer double, fold_dir string")
    new = spark.createDataFrame([("a", None, 7), ("c", 3.0, 8)], "k string, wer double, n int")
    got = {r.k: (r.wer, r.fold_dir, r.n) for r in runs.upsert(old, new, ["k"]).collect()}
    assert got == {"a": (None, "x", 7), "b": (2.0, "y", None), "c": (3.0, None, 8)}


def test_protocol_hash_has_no_collisions(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")]
    df = spark.createDataFrame(rows, "p string, q string").select(runs.protocol_hash("p", "q").alias("h"))
    assert len({r.h for r in df.collect()}) == 4


def test_iso_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(0,), (-1,), (1_700_000_000_123_456,)], "m bigint").select(F.timestamp_micros("m").alias("t"))
    want = ["1969-12-31T23:59:59.999999+00:00", "1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20.123456+00:00"]
    try:
        for z in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert sorted(r[0] for r in df.select(paths.iso_utc(F.col("t"))).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_base_model_raises(spark):
    df = spark.createDataFrame([("", '{"base_model_name_or_path": ""}')], "o string, c string")
    with pytest.raises(Exception, match="not declared"):
        df.select(paths.base_model(F.col("o"), F.col("c"))).collect()


def test_mono_of_empty_channels(spark):
    df = spark.createDataFrame([([[], []],), ([[1.0, 3.0], [3.0, 5.0]],)], "c array<array<double>>")
    assert sorted(r[0] for r in df.select(X.mono(F.col("c"))).collect()) == [[], [2.0, 4.0]]


def test_null_text_and_null_speaker(spark):
    df = spark.createDataFrame([(0, None, None), (1, "b", "s"), (2, None, None), (3, "a", "s")], "idx bigint, text string, speaker string")
    got = {r.idx: (r.phrase_no, r.split) for r in splits.phrase_split(df, "text", 2).collect()}
    assert got == {0: (0, "validation"), 1: (1, "train"), 2: (0, "validation"), 3: (2, "validation")}
    at = {r.idx: r.ordinal for r in numbering.number_in_groups(df, ["speaker"], ["idx"]).collect()}
    assert at == {0: 0, 2: 1, 1: 0, 3: 1}


def test_roots_are_no_patterns_and_broken_snapshots_raise(spark):
    d = tempfile.mkdtemp(prefix="vf-") + "/a+b (x)"
    os.makedirs(f"{d}/sub")
    open(f"{d}/sub/one.wav", "wb").write(b"RIFF")
    assert [r.audio_path for r in files.list_audio(spark, d).collect()] == ["sub/one.wav"]
    os.makedirs(f"{d}/broken")
    open(f"{d}/broken/part.parquet", "w").write("not parquet")
    with pytest.raises(Exception):
        files.snapshot(spark, f"{d}/broken", lambda: pytest.fail("derived over a broken snapshot")).count()
    assert files.snapshot(spark, f"{d}/new", lambda: spark.range(3)).count() == 3
