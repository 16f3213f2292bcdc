"""Hand-made rows every implementation must pass (FIXTURES.md section 4) and
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalframe.functions import paths as P
from vocalframe.operators import labels as L
from vocalframe.operators import metrics, pairing, splits
from vocalframe.operators import spectral as M
from vocalframe.operators import waveform as X
from vocalframe.operators.numbering import number_in_groups, number_rows


def _scored(spark, rows):
    return spark.createDataFrame(rows, "speaker string, word_errors long, ref_words long, char_errors long, ref_chars long")


def test_a3_corpus_rate_is_ratio_of_sums(spark):
    df = _scored(spark, [("a", 1, 4, 0, 1), ("b", 2, 4, 0, 1)])
    got = {r.speaker: r.wer for r in metrics.corpus_rates(df).collect()}
    assert got == {"a": 25.0, "b": 50.0, "overall": 37.5}


def test_a3_vs_a6_macro(spark):
    df = _scored(spark, [("a", 1, 2, 0, 1), ("b", 1, 8, 0, 1)])
    overall = {r.speaker: r.wer for r in metrics.corpus_rates(df).collect()}["overall"]
    per = metrics.metric_record(df, ["speaker"])
    macro = metrics.macro_average(per).collect()[0].wer
    assert overall == pytest.approx(20.0) and macro == pytest.approx(31.25)


def test_empty_reference_policy(spark):
    df = _scored(spark, [("a", 3, 0, 3, 0)])
    r = metrics.corpus_rates(df).where("speaker = 'a'").collect()[0]
    assert r.wer is None and r.word_errors == 3


def test_t2_j1_dedup_keeps_lowest_idx(spark):
    df = spark.createDataFrame([(0, "s", "Hello"), (1, "s", " hello "), (2, "s", "hello  "), (3, "s", ""),
                                (4, "s", None)], "idx long, speaker string, text string")
    assert [tuple(r) for r in pairing.dedup_per_speaker(df).collect()] == [("s", 0)]


def test_d4_phrase_split(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "idx long, t string")
    got = sorted(r.idx for r in splits.phrase_split(df, "t", 2).where("split = 'validation'").collect())
    assert got == [0, 2, 3]


def test_j2_pairing(spark):
    df = spark.createDataFrame([(0, "c", "x"), (2, "c", "x"), (4, "c", "y"), (1, "p", "x"), (3, "p", "x")],
                               "idx long, speaker string, t string")
    got = sorted(tuple(r) for r in pairing.pair_transcripts(df, "c", "p", "t").collect())
    assert got == [(0, 1), (2, 1)]


def test_x3_resample_golden(spark):
    df = spark.createDataFrame([([0.0, 1.0, 4.0, 9.0], 8000)], "s array<float>, r int")
    got = df.select(X.resample(F.col("s"), F.col("r")).alias("o")).collect()[0].o
    ref = np.interp(np.linspace(0, 3, 8), np.arange(4), [0, 1, 4, 9]).astype(np.float32)
    assert len(got) == 8 and got[0] == 0 and got[-1] == 9
    assert np.allclose(got, ref, atol=1e-6) and abs(got[1] - 0.428571) < 1e-6


def test_m1_channel_mask(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0], [4.0]], [1, 2])], "m array<array<float>>, r array<int>")
    out = df.select(M.apply_channel_mask(F.col("m"), F.col("r"), 2).alias("o")).collect()[0].o
    assert [row[0] for row in out] == [1.0, 0.0, 0.0, 4.0]


def test_m2_m4_properties(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    g = df.select(M.mask_groups(7, F.col("k"), 10, 8).alias("g")).collect()
    vals = [v for r in g for v in r.g]
    assert min(vals) >= 1 and max(vals) <= 254
    mel = spark.createDataFrame([([[float(c * 10 + t) for t in range(3)] for c in range(8)], [5, 10])],
                                "m array<array<float>>, r array<int>")
    v1, v2 = M.complementary_views(F.col("m"), F.col("r"), 4)
    row = mel.select(v1.alias("a"), v2.alias("b"), "m").collect()[0]
    assert (np.array(row.a) + np.array(row.b) == np.array(row.m)).all()


def test_m5_m6_are_permutations_within_groups(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    rows = df.select(M.local_shuffle_order(3, F.col("k"), 16, 4).alias("o"),
                     M.group_shuffle_order(3, F.col("k"), [2, 8, 6]).alias("g")).collect()
    for r in rows:
        assert sorted(r.o) == list(range(16))
        assert all(c // 4 == i // 4 for i, c in enumerate(r.o))
        bounds = [(0, 2), (2, 10), (10, 16)]
        for lo, hi in bounds:
            assert sorted(r.g[lo:hi]) == list(range(lo, hi))


def test_l2_l3_padding(spark):
    df = spark.createDataFrame([(0, [1, 5], 0), (1, [1, 6, 7], 0)], "idx long, ids array<int>, batch_id long")
    got = {r.idx: (r.labels, r.drop_start) for r in L.pad_batch(df).collect()}
    assert got[0][0] == [5, -100] and got[1][0] == [6, 7] and got[0][1] is True
    df2 = spark.createDataFrame([(0, [1, 5], 0), (1, [2, 6, 7], 0)], "idx long, ids array<int>, batch_id long")
    got2 = {r.idx: r.labels for r in L.pad_batch(df2).collect()}
    assert got2[0] == [1, 5, -100] and got2[1] == [2, 6, 7]


def test_a13_best_checkpoint_earliest_on_ties(spark):
    from vocalframe.operators.runs import best_checkpoint
    log = spark.createDataFrame([(0, 1, 9.0), (0, 2, 5.0), (0, 3, 5.0)], "run int, step int, eval_wer double")
    assert best_checkpoint(log).collect()[0].step == 2


def test_p6_speaker_from_name(spark):
    df = spark.createDataFrame([("/a/F03_s1_001.wav",), ("MC01_x.wav",), ("zz_1.wav",)], "p string")
    rows = df.select(P.speaker_from_name(F.col("p")).alias("s")).collect()
    spk = [r.s for r in rows]
    assert spk == ["F03", "MC01", "zz"]
    known = [r.k for r in df.select(P.known_speaker(P.speaker_from_name(F.col("p"))).alias("k")).collect()]
    assert known == [True, True, False]
    with pytest.raises(Exception):
        df.select(P.strict_speaker(P.speaker_from_name(F.col("p")), F.col("p"))).collect()


def test_p5_half_even(spark):
    assert spark.range(1).select(F.rint(F.lit(2.5)).alias("r")).collect()[0].r == 2.0


def test_a7_tier_order(spark):
    per = spark.createDataFrame([("s1", 10.0, 5.0, 3), ("s2", 20.0, 6.0, 4)],
                                "speaker string, wer double, cer double, num_samples long")
    dim = spark.createDataFrame([("s1", "Odd", None), ("s2", "Mild", 2)], "speaker string, severity string, sev_pos int")
    got = [r.severity for r in metrics.ordered_tiers(metrics.severity_macro(per, dim)).collect()]
    assert got == ["Mild", "Odd"]


def test_a7_missing_speaker_raises(spark):
    per = spark.createDataFrame([("s9", 10.0, 5.0, 3)], "speaker string, wer double, cer double, num_samples long")
    dim = spark.createDataFrame([("s1", "Mild", 2)], "speaker string, severity string, sev_pos int")
    with pytest.raises(Exception):
        metrics.severity_macro(per, dim).collect()


def test_folds_partition_rows(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "idx long, speaker string")
    for h in ["s0", "s1", "s2"]:
        f = splits.loso_role(df, h)
        assert f.count() == 30 and f.where("role = 'validation'").count() == 10
    folds = spark.createDataFrame([("s1", 1), ("s2", 2)], "held_out string, fold_no long")
    got = {r.held_out: (r.train_samples, r.validation_samples, r.fold_seed)
           for r in splits.loso_summary(df, folds, 42).collect()}
    assert got == {"s1": (20, 10, 42), "s2": (20, 10, 43)}
    with pytest.raises(Exception):
        splits.loso_summary(df, spark.createDataFrame([("zz", 1)], "held_out string, fold_no long"), 1).collect()


def test_ordinals_match_windows_under_skew(spark):
    # one speaker holds a third of the rows: grouped ordinal must still be exact
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 17}") for i in range(3000)]
    df = spark.createDataFrame(rows, "idx long, speaker string").repartition(7)
    g = {r.idx: r.ordinal for r in number_in_groups(df, ["speaker"], ["idx"], parts=6).collect()}
    exp = {}
    for spk in {s for _, s in rows}:
        for k, i in enumerate(sorted(i for i, s in rows if s == spk)):
            exp[i] = k
    assert g == exp
    o = {r.idx: r.ordinal for r in number_rows(df, ["idx"], parts=5).collect()}
    assert o == {i: i for i in range(3000)}


def test_ratio_split_exact_counts(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"))
    c = {r.split: r["count"] for r in splits.ratio_split(df, 7).groupBy("split").count().collect()}
    assert c == {"train": 800, "validation": 100, "test": 100}


def test_split_dispatcher(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(100)], "idx long, speaker string")
    c = {r.split: r["count"] for r in splits.split_dataset(df, "ratio", 3).groupBy("split").count().collect()}
    assert c == {"train": 80, "validation": 10, "test": 10}
    lo = {r.speaker: r.split for r in splits.split_dataset(df, "loso", loso_test_speaker="s1",
                                                           loso_val_speaker="s2").collect()}
    assert lo["s1"] == "test" and lo["s2"] == "validation" and lo["s0"] == "train"
    with pytest.raises(ValueError):
        splits.split_dataset(df, "kfold")


def test_refresh_and_resume_guard(spark):
    from vocalframe.operators import runs
    res = spark.createDataFrame([("m1", "primary", 10.0, 5.0, 3), ("m2", "primary", 20.0, None, 4)],
                                "model string, target string, wer double, cer double, num_samples long")
    avg = runs.refresh_averages(res, "loso").collect()[0]
    assert avg.wer == 10.0 and avg.num_models == 1  # the incomplete record is ignored
    one = runs.refresh_averages(res.limit(1), "single").collect()[0]
    assert one.num_models == 1
    a = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run string, fp string")
    runs.check_resume(a, a, ["run"], "fp")
    b = spark.createDataFrame([("r1", "x"), ("r2", "z")], "run string, fp string")
    with pytest.raises(ValueError, match="r2"):
        runs.check_resume(a, b, ["run"], "fp")


def test_whole_matrices_of_shuffles_and_masks(spark):
    from vocalframe.operators import spectral as M
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [2, 0, 1], [1, 0, 1])], "k int, m array<array<float>>, o array<int>, keep array<int>")
    r = df.select(M.reorder(F.col("m"), F.col("o")).alias("o"), M.keep_channels(F.col("m"), F.col("keep")).alias("k"),
                  M.keep_channels(F.col("m"), M.span_keep(F.lit(1), F.lit(2), 3)).alias("s")).first()
    assert r.o == [[5, 6], [1, 2], [3, 4]] and r.k == [[1, 2], [0, 0], [5, 6]] and r.s == [[1, 2], [0, 0], [0, 0]]
    for wrong in (M.reorder(F.col("m"), F.array(F.lit(0))), M.keep_channels(F.col("m"), F.array(F.lit(0)))):
        with pytest.raises(Exception, match="differ in their channels"):
            df.select(wrong).collect()
