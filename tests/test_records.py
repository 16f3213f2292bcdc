"""Logs of differing entries, run documents, protocols, reports and method names against plain Python."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vocalframe.functions import paths
from vocalframe.operators import records


def write_logs(tmp_path, logs):
    for run, doc in logs.items():
        os.makedirs(tmp_path / run)
        (tmp_path / run / "trainer_state.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(tmp_path / "*" / "trainer_state.json")


def test_last_evaluations_of_differing_logs(spark, tmp_path):
    logs = {"a": {"log_history": [{"loss": 1.0, "step": 1}, {"eval_wer": 30, "eval_cer": 10.5, "epoch": 1.0, "step": 2, "eval_loss": 0.25},
                                  {"eval_wer": 20.5, "eval_cer": 9, "step": 4, "epoch": 2.0}, {"train_runtime": 3.5, "step": 4, "extra": {"x": [1, None]}}]},
            "b": {"log_history": [{"loss": 2.0}]}, "c": {"log_history": []}, "d": {"other": 1},
            "e": {"log_history": [{"eval_wer": 5, "eval_cer": 1, "eval_loss": None}]}}
    entries = records.read_logs(spark, write_logs(tmp_path, logs))
    assert entries.count() == 6
    runs = spark.createDataFrame([(r,) for r in [*logs, "a"]], "run string")
    got = {r.run: r.last and r.last.asDict() for r in records.last_eval(entries, runs).collect()}
    assert got == {"a": {"wer": 20.5, "cer": 9.0, "eval_loss": None, "epoch": 2.0, "step": 4}, "b": None, "c": None, "d": None,
                   "e": {"wer": 5.0, "cer": 1.0, "eval_loss": None, "epoch": None, "step": None}}
    assert {r.run for r in records.last_eval(entries).collect()} == {"a", "b", "e"}


@pytest.mark.parametrize("doc, found", [("[1]", "not a JSON object: x"), ({"log_history": [{"eval_wer": 3}]}, "without eval_cer in run x")])
def test_broken_logs_raise(spark, tmp_path, doc, found):
    with pytest.raises(Exception, match=found):
        records.last_eval(records.read_logs(spark, write_logs(tmp_path, {"x": doc}))).collect()


def speakers(spark):
    rows = [("B", 1, "Severe", 2, 50.0, 20.0, 10, ("f1",)), ("A", 2, "Mild", 1, 10.0, 5.0, 20, ("f2",)), ("C", 3, "Other", None, 20.0, 6.0, 5, ("f3",)),
            ("D", 4, "Mild", 1, 30.0, 15.0, 7, ("f4",))]
    return spark.createDataFrame(rows, "speaker string, fold_no int, severity string, sev_pos int, wer double, cer double, num_samples long, fold struct<name:string>")


def test_result_and_last_epoch_documents(spark):
    per = speakers(spark)
    made = F.lit("2024-01-01T00:00:00+00:00")
    doc = json.loads(records.result_document(per, {"mode": F.lit("finetune"), "dataset": F.struct(F.lit("d").alias("name"))}, made).first().document)
    assert list(doc) == ["schema_version", "created_at", "mode", "dataset", "selected_speakers", "speaker_severity", "speaker_metrics", "folds",
                         "overall_macro", "severity_macro"]
    assert doc["selected_speakers"] == ["B", "A", "C", "D"] and list(doc["folds"]) == ["B", "A", "C", "D"] and doc["dataset"] == {"name": "d"}
    assert doc["overall_macro"] == {"wer": 27.5, "cer": 11.5} and list(doc["severity_macro"]) == ["Mild", "Severe", "Other"]
    assert doc["severity_macro"]["Mild"] == {"wer": 20.0, "cer": 10.0, "num_speakers": 2, "num_samples": 27}
    assert doc["speaker_metrics"]["A"] == {"wer": 10.0, "cer": 5.0, "num_samples": 20, "severity": "Mild"}
    last = spark.createDataFrame([("A", (1.0, 2.0, None, 3.0, 4)), ("B", None)],
                                 "run string, last struct<wer:double,cer:double,eval_loss:double,epoch:double,step:long>")
    end = json.loads(records.last_epoch_document(last, per, {"mode": F.lit("m")}, made).first().document)
    assert end["folds"] == {"A": {"wer": 1.0, "cer": 2.0, "eval_loss": None, "epoch": 3.0, "step": 4, "severity": "Mild"}, "B": None}
    assert records.macro_overall(per).first().wer == 27.5
    for empty in (records.macro_overall, lambda p: records.result_document(p, {}, made)):
        with pytest.raises(Exception, match="empty table of speakers"):
            empty(per.where("false")).collect()


def protocol(mode="loso", split="test", samples=None, held=None):
    n = lambda v, t: F.lit(v).cast(t)
    return records.protocol(F.lit(mode), (F.lit("one"), F.lit(split)), (F.lit("two"), F.lit("clean")), n(30.0, "double"), n(samples, "int"), n(held, "string"))


def test_protocols_name_every_field(spark):
    at = lambda **k: spark.range(1).select(protocol(**k).alias("p"), records.fingerprint(protocol(**k)).alias("f")).first()
    p = at().p.asDict(True)
    assert p == {"evaluation_mode": "loso", "primary": {"dataset": "one", "split": "test", "selection": "speaker matching the held-out-* model"},
                 "retention": {"dataset": "two", "split": "clean", "selection": "same retention set for every LOSO model"}, "max_audio_seconds": 30.0,
                 "max_samples": None, "metric_normalization": "Whisper BasicTextNormalizer", "result_aggregation": "unweighted macro average over LOSO models"}
    assert at(mode="single").p.primary.selection == "all filtered speakers" and at(mode="single", held="F01").p.primary.selection == "F01"
    prints = {at(**k).f for k in ({}, {"split": "train"}, {"samples": 5}, {"mode": "single"}, {"mode": "single", "held": "F01"})}
    assert len(prints) == 5 and at().f == at().f
    with pytest.raises(Exception, match="unknown evaluation mode: k-fold"):
        at(mode="k-fold")


def test_resume_guard_gives_the_first_reason(spark):
    def report(mode="loso", folder="d", model=None, **k):
        return F.struct(F.lit(mode).alias("mode"), F.lit(folder).alias("method_dir"), F.lit(model).cast("string").alias("model_source"),
                        protocol(mode, **k).alias("protocol"))
    rows = lambda s, c: spark.range(1).select(F.lit("r1").alias("run"), s.alias("s"), c.alias("c"))
    assert records.guard_resume(rows(report(), report()), "s", "c", "run").count() == 1
    assert records.guard_resume(rows(report("single", model="m", folder="x"), report("single", model="m")), "s", "c", "run").count() == 1
    none = rows(F.when(F.lit(False), report()), report())
    assert records.guard_resume(none, "s", "c", "run").count() == 1
    for s, why in ((report("single"), "evaluation mode"), (report(folder="e"), "method folder"), (report(split="x"), "protocol")):
        with pytest.raises(Exception, match=f"report of r1 uses a different {why}"):
            records.guard_resume(rows(s, report()), "s", "c", "run").collect()
    with pytest.raises(Exception, match="different model"):
        records.guard_resume(rows(report("single", model="m"), report("single", model="n")), "s", "c", "run").collect()


def test_report_of_both_modes(spark):
    rows = [("M2", "full", 5, 12.3456, 1.0, 9, 3.0, 2.0), ("F1", "lora", 7, 10.0, None, None, None, None)]
    models = spark.createDataFrame(rows, "speaker string, model_type string, p_samples int, p_wer double, p_cer double, q_samples int, q_wer double, q_cer double")
    targets = [("p", "P", "own."), ("q", "Q", "kept.")]
    text = [r.line for r in records.report_lines(models, "loso", "m/x", targets).orderBy("line_no").collect()]
    assert text == [
        "# LOSO retention evaluation: m/x", "", "WER/CER are percentages. The method average is an unweighted macro average over completed LOSO models.", "",
        "| Held-out model | Model type | P samples | P WER | P CER | Q samples | Q WER | Q CER |", "|---|---|---:|---:|---:|---:|---:|---:|",
        "| F1 | lora | 7 | 10.000 | — | — | — | — |", "| M2 | full | 5 | 12.346 | 1.000 | 9 | 3.000 | 2.000 |",
        "| **Method macro average** | — | — | **12.346** | **1.000** | — | **3.000** | **2.000** |", "", "- P: own.", "- Q: kept.", ""]
    none = [r.line for r in records.report_lines(models.where("false"), "loso", "m", targets).orderBy("line_no").collect()]
    assert none[6] == "| **Method macro average** | — | — | **—** | **—** | — | **—** | **—** |"
    one = models.limit(1).withColumn("speaker", F.lit(None).cast("string"))
    single = [r.line for r in records.report_lines(one, "single", "m", targets).orderBy("line_no").collect()]
    assert single[0] == "# Single-model evaluation: m" and single[6].startswith("| all | full | 5 |") and len(single) == 11
    with pytest.raises(ValueError, match="unknown"):
        records.report_lines(models, "k-fold", "m", targets)


def test_method_names(spark):
    options = {"lora_rank": "8", "lora_alpha": "16", "lora_target_modules": "q_proj, v_proj,q_proj", "adapter_dim": "64", "adapter_encoder_layers": " ALL ",
               "adapter_decoder_layers": "0,1", "train_encoder_layers": "None", "train_decoder_layers": "last,2", "train_components": "layernorm,attn"}
    df = spark.createDataFrame([(s, options) for s in ("full", "lora", "adapter", "components", "partial")], "scope string, o map<string,string>")
    assert [r[0] for r in df.select(paths.method_name(F.col("scope"), F.col("o"))).collect()] == [
        "full-finetune", "lora-r8-a16-q_proj_v_proj", "adapter-dim64-encall-dec0_1", "component-finetune-layernorm_attn-encnone-declast_2",
        "partial-finetune-encnone-declast_2"]
    for bad in ("", "a,,b", " , "):
        with pytest.raises(Exception, match="invalid module list"):
            spark.range(1).select(paths.module_list(F.lit(bad))).collect()
    flags = spark.createDataFrame([("/x/checkpoint-40/",), ("checkpoint-1/final",), ("org/distil-small.en",)], "m string")
    assert [tuple(r) for r in flags.select(paths.checkpoint_folder(F.col("m")), paths.distilled(F.col("m"))).collect()] == [
        (True, False), (False, False), (False, True)]
