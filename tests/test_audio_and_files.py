"""Arrow jobs (numpy properties) and file sources/sinks on a fresh temp folder."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalframe.operators import audio, splits
from vocalframe.sources import files, folds


def test_wav_roundtrip_and_listing(spark):
    root = tempfile.mkdtemp(prefix="vf-audio-")
    os.makedirs(f"{root}/spk/a")
    sig = np.sin(np.linspace(0, 20, 1600)).astype(np.float32) * 0.5
    for name in ["spk/a/F01_1.wav", "spk/M02_2.wav"]:
        with open(f"{root}/{name}", "wb") as f:
            f.write(audio.encode_wav_bytes(sig, 8000))
    open(f"{root}/spk/notes.txt", "w").write("x")
    listed = files.list_audio(spark, root).collect()
    assert [r.audio_path for r in listed] == ["spk/M02_2.wav", "spk/a/F01_1.wav"]
    raw = spark.read.format("binaryFile").load(f"{root}/spk/a/*.wav")
    dec = audio.decode_wav(raw).collect()[0]
    assert dec.sampling_rate == 8000 and np.allclose(dec.channels[0], sig, atol=1e-4)
    assert [r.path for r in files.list_impulse_responses(spark, root).collect()] == sorted(r.path for r in listed)


def test_log_mel_shape_and_range():
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000).astype(np.float32)
    m = audio.log_mel(x)
    assert m.shape == (80, 3000)
    assert m.max() - m.min() <= 2.0 + 1e-6  # 8 decades / 4


def test_augmentation_properties():
    rng = np.random.default_rng(0)
    x = np.sin(2 * np.pi * 300 * np.arange(16000) / 16000).astype(np.float32) * 0.3
    assert abs(len(audio.time_stretch(x, 1.25)) - 16000 / 1.25) <= 1
    assert len(audio.pitch_shift(x, 2.0)) == len(x)
    y = audio.add_noise_snr(x, rng, 10, 10)
    snr = 10 * np.log10(np.mean(x.astype(np.float64) ** 2) / np.mean((y - x).astype(np.float64) ** 2))
    assert 9 < snr < 11
    ir = np.zeros(64, np.float32)
    ir[0] = 1.0
    assert np.allclose(audio.apply_impulse_response(x, ir), x, atol=1e-5)
    a = audio.augment_one(x, 16000, 5, [ir])
    b = audio.augment_one(x, 16000, 5, [ir])
    assert np.array_equal(a, b)


def test_pitch_shift_moves_peak():
    sr, f0 = 16000, 500.0
    x = np.sin(2 * np.pi * f0 * np.arange(sr) / sr).astype(np.float32)
    y = audio.pitch_shift(x, 12.0)
    peak = np.argmax(np.abs(np.fft.rfft(y))) * sr / len(y)
    assert abs(peak - 2 * f0) < 30


@pytest.mark.parametrize("n", [511, 512, 4000, 16000])
def test_stretch_and_pitch_at_every_length(n):
    sr, f0 = 16000, 1000.0
    x = np.sin(2 * np.pi * f0 * np.arange(n) / sr).astype(np.float32)
    for y, want in ((audio.time_stretch(x, 1.25), f0), (audio.pitch_shift(x, 12.0), 2 * f0)):
        spec = np.abs(np.fft.rfft(y * np.hanning(len(y)), 1 << 16))
        assert abs(np.argmax(spec) * sr / (1 << 16) - want) < max(60, 0.6 * sr / n * 2)
    assert len(audio.time_stretch(x[:64], 1.25)) == round(64 / 1.25) and len(audio.pitch_shift(x[:64], 5.0)) == 64


def test_severity_map_and_json_sources(spark):
    d = tempfile.mkdtemp(prefix="vf-json-")
    # The reference's severity file content.
    doc = {"_comment": "x", "order_for_lora": ["Normal", "Mild", "Moderate", "Mod-Sev", "Severe"],
           "FC01": "Normal", "FC02": "Normal", "FC03": "Normal", "MC01": "Normal", "MC02": "Normal",
           "MC03": "Normal", "MC04": "Normal", "F04": "Mild", "M03": "Mild", "F03": "Moderate",
           "M05": "Mod-Sev", "F01": "Severe", "M01": "Severe", "M02": "Severe", "M04": "Severe"}
    json.dump(doc, open(f"{d}/sev.json", "w"), indent=2)
    sev = {r.speaker: (r.severity, r.sev_pos) for r in files.load_severity_map(spark, f"{d}/sev.json").collect()}
    assert len(sev) == 15 and sev["M05"] == ("Mod-Sev", 4) and sev["FC01"] == ("Normal", 1)
    json.dump([1, 2], open(f"{d}/arr.json", "w"))
    with pytest.raises(Exception):
        files.read_json_object(spark, f"{d}/arr.json").collect()
    assert files.read_json_object(spark, f"{d}/sev.json").count() == 1


def test_fold_catalogue_and_checkpoint_kinds(spark):
    d = tempfile.mkdtemp(prefix="vf-folds-")
    for spk, kind in [("F01", "lora"), ("M02", "bn"), ("F03", "full")]:
        os.makedirs(f"{d}/held-out-{spk}/final-model")
        json.dump({"held_out_speaker": spk, "severity": "Severe"}, open(f"{d}/held-out-{spk}/run_config.json", "w"))
        m = f"{d}/held-out-{spk}/final-model"
        if kind == "lora":
            json.dump({"base_model_name_or_path": "base"}, open(f"{m}/adapter_config.json", "w"))
        json.dump({"bottleneck_adapter_dim": 8} if kind == "bn" else {"d": 1}, open(f"{m}/config.json", "w"))
    json.dump({"_name_or_path": "runs/bottleneck-study"}, open(f"{d}/held-out-F03/final-model/config.json", "w"))
    cat = {r.speaker: r for r in folds.fold_catalogue(spark, d).collect()}
    assert {s: r.model_type for s, r in cat.items()} == {"F01": "lora_adapter", "F03": "whisper_finetuned", "M02": "bottleneck_adapter"}
    assert all(r.base_model == folds.DEFAULT_MODEL and json.loads(r.run_config)["held_out_speaker"] == s for s, r in cat.items())
    assert cat["F01"].fold_dir == f"{d}/held-out-F01" and cat["F01"].model_dir == f"{d}/held-out-F01/final-model"
    json.dump({"parameters": {"model_name": "m/x"}}, open(f"{d}/held-out-M02/run_config.json", "w"))    # no speaker: the folder's
    only = folds.fold_catalogue(spark, d, ["M02"])
    assert [r.base_model for r in only.collect()] == ["m/x"]


def folders_with(tmp_path, **broken):
    """Two sound folds and one more, F09, with the given files."""
    for name, configs in {"F01": {"run_config.json": "{}", "final-model/config.json": "{}"},
                          "M02": {"run_config.json": '{"held_out_speaker": " M02 "}', "final-model/adapter_config.json": "{}"}, **broken}.items():
        os.makedirs(tmp_path / f"held-out-{name}")
        for file, text in configs.items():
            at = tmp_path / f"held-out-{name}" / file
            os.makedirs(at.parent, exist_ok=True)
            at.write_text(text) if text is not None else os.makedirs(at)
    (tmp_path / "held-out-notes.txt").write_text("a file is no fold")
    return str(tmp_path)


@pytest.mark.parametrize("what, found", [
    ({"final-model/config.json": "{}"}, "missing run_config.json.*held-out-F09"),
    ({"run_config.json": "{}"}, "missing final-model.*held-out-F09"),
    ({"run_config.json": '{"held_out_speaker": "F08"}', "final-model/config.json": "{}"}, "says 'F09'.*says 'F08'"),
    ({"run_config.json": "[1]", "final-model/config.json": "{}"}, "expected a JSON object in .*run_config"),
    ({"run_config.json": "{}", "final-model/weights.bin": ""}, "neither a full checkpoint nor an adapter"),
    ({"run_config.json": "{}", "final-model/config.json": "[]"}, "expected a JSON object in .*config.json"),
])
def test_broken_folds_raise_when_read(spark, tmp_path, what, found):
    d = folders_with(tmp_path, F09=what)
    with pytest.raises(Exception, match=found):
        folds.fold_catalogue(spark, d).collect()
    # the filter reaches the source: the broken folder is not opened
    assert [r.speaker for r in folds.fold_catalogue(spark, d).where("speaker = 'M02'").collect()] == ["M02"]
    assert folds.fold_catalogue(spark, d).where("speaker in ('M02', 'F01', 'Z')").count() == 2
    assert folds.fold_catalogue(spark, d, ["F01"]).where("model_type = 'whisper_finetuned'").count() == 1


def test_fold_listing_errors_and_partitions(spark, tmp_path):
    d = folders_with(tmp_path)
    assert folds.fold_catalogue(spark, d).rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="missing from .*: M08, M09"):
        folds.fold_catalogue(spark, d, ["F01", "M09", "M08"]).collect()
    with pytest.raises(Exception, match="does not exist"):
        folds.fold_catalogue(spark, d + "/none").collect()
    os.makedirs(tmp_path / "empty")
    with pytest.raises(Exception, match="no held-out-"):
        folds.fold_catalogue(spark, d + "/empty").collect()


def test_model_sources(spark, tmp_path):
    d = folders_with(tmp_path, F03={"final-model/adapter_config.json": '{"base_model_name_or_path": "b/c"}'})
    rows = [("org/name", None), ("org/name", "o"), (f"{d}/held-out-F03/final-model", None), (f"{d}/held-out-F03/final-model", "o"),
            (f"file://{d}/held-out-F01/final-model", None), (None, "o")]
    df = spark.createDataFrame(rows, "source string, override string").withColumn("model_dir_", F.lit("clash"))
    got = [(r.model_type, r.base_model) for r in folds.model_sources(df, F.col("source"), F.col("override")).collect()]
    assert got == [("whisper_pretrained", "org/name"), ("whisper_pretrained", "o"), ("lora_adapter", "b/c"), ("lora_adapter", "o"),
                   ("whisper_finetuned", rows[4][0]), (None, None)]
    for bad, found in ((f"{d}/none", "does not exist"), ("./none", "does not exist"), (f"{d}/held-out-notes.txt", "not a folder"),
                       (f"{d}/held-out-M02/final-model", "does not declare"), (d, "neither")):
        with pytest.raises(Exception, match=found):
            folds.model_sources(df.limit(1), F.lit(bad)).collect()
        with pytest.raises(ValueError, match=found):
            folds.single_model(spark, bad)
    one = folds.single_model(spark, f"{d}/held-out-F03/final-model", base_model="x").first()
    assert (one.speaker, one.fold_dir, one.model_type, one.base_model) == ("all", f"{d}/held-out-F03", "lora_adapter", "x")
    name = folds.single_model(spark, "org/name", "F01").first()
    assert (name.speaker, name.fold_dir, name.model_dir, name.run_config, name.base_model) == ("F01", ".", "org/name", "{}", "org/name")


def test_speakers_to_hold_out(spark, tmp_path):
    at = str(tmp_path / "severity.json")
    open(at, "w").write('{"_note": "x", "Z9": "Mild", "A1": "NORMAL", "M01": "Severe", "F01": "Mild", "order_for_lora": ["Severe", "Mild"]}')
    sev = files.load_severity_map(spark, at)
    rows = lambda df: [(r.held_out, r.fold_no) for r in df.orderBy("fold_no").collect()]
    assert rows(splits.resolve_speakers(sev)) == [("Z9", 1), ("M01", 2), ("F01", 3)]
    assert rows(splits.resolve_speakers(sev, include_normal=True)) == [("Z9", 1), ("A1", 2), ("M01", 3), ("F01", 4)]
    assert rows(splits.resolve_speakers(sev, ["F01", "A1", "F01"])) == [("F01", 1), ("A1", 2)]
    with pytest.raises(ValueError, match="B7.*X"):
        splits.resolve_speakers(sev, ["F01", "X", "B7"])
    assert {r.speaker: r.sev_pos for r in sev.collect()} == {"Z9": 2, "A1": None, "M01": 1, "F01": 2}


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="vf-sinks-")
    df = spark.createDataFrame([(0, "a b", "a c", "train"), (1, "x", "x", "test")],
                               "idx long, prediction string, reference string, split string")
    files.write_csv(df, f"{d}/csv")
    files.write_text(df, "prediction", f"{d}/txt")
    files.write_split_manifest(df, f"{d}/man")
    assert spark.read.option("header", True).csv(f"{d}/csv").columns == df.columns
    assert sorted(r.value for r in spark.read.text(f"{d}/txt").collect()) == ["a b", "x"]
    assert {r.split for r in spark.read.json(f"{d}/man").collect()} == {"train", "test"}


def test_split_snapshot_and_json_sink(spark):
    d = tempfile.mkdtemp(prefix="vf-split-")
    df = spark.createDataFrame([(0, "train"), (1, "test"), (2, "train")], "idx long, split string")
    df.write.partitionBy("split").parquet(f"{d}/t")
    assert files.load_split(spark, f"{d}/t", "train").count() == 2
    with pytest.raises(ValueError, match="available"):
        files.load_split(spark, f"{d}/t", "validation")
    calls = []

    def derive():
        calls.append(1)
        return df
    files.snapshot(spark, f"{d}/snap", derive)
    files.snapshot(spark, f"{d}/snap", derive)
    assert len(calls) == 1
    files.write_json(df, f"{d}/j")
    files.write_json(df.limit(1), f"{d}/j")  # replaced on success
    assert spark.read.json(f"{d}/j").count() == 1


def test_augmentation_draws_from_all_responses(spark):
    rows = spark.createDataFrame([(i, [0.5, -0.25, 0.125, 0.0], 8000, 1000 + i, 0) for i in range(400)],
                                 "id bigint, s array<float>, r int, seed bigint, epoch int")
    pulses = [[1.0, 0.1 * k] for k in range(20)]
    irs = spark.createDataFrame([(100 - k, p) for k, p in enumerate(pulses)], "k bigint, x array<float>")
    drawn = audio.with_response(rows, "seed", irs, "k", "x")
    got = {r.id: r.ir for r in drawn.collect()}
    assert len(got) == 400 and len({tuple(v) for v in got.values()}) == 20
    out = {r.key: r.samples for r in audio.augment_job(drawn, "id", "s", "r", "seed", "epoch", "ir").collect()}
    for i in range(400):
        want = audio.augment_one(np.array([0.5, -0.25, 0.125, 0.0], np.float32), 8000, 1000 + i, [np.array(got[i], np.float32)])
        assert np.array_equal(np.float32(out[i]), want)
    assert {tuple(r.ir or ()) for r in audio.with_response(rows, "seed", irs.where("false"), "k", "x").collect()} == {()}


def test_augmented_waveforms_depend_on_every_response(spark, monkeypatch):
    from vocalframe.plans import jobs
    seen = []
    real = audio.augment_job
    monkeypatch.setattr(audio, "augment_job", lambda df, *a: seen.append(df) or real(df, *a))
    n = jobs.augmented_waveforms(spark, "/root/testdata/sf0.001").count()
    waves = jobs.wave(spark, "/root/testdata/sf0.001").count()
    assert n == 2 * waves and seen[0].select("ir").distinct().count() > min(waves, 100) / 2
