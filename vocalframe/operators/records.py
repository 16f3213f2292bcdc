"""Logs, run documents, protocols and reports of evaluation runs as tables
(S15, S16, S18, A6, A12, J8).

Training logs hold entries of differing fields, so an entry is a VARIANT: no schema
is inferred over all logs, and a field is read where it is asked for. Documents are
assembled from one row per speaker or model; the tables behind them stay tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.text import format_metric
from vocalframe.operators.numbering import number_rows


# training logs

def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, pos, entry) of every trainer state document under ``path`` (a glob is allowed): the
    run is the document's folder, ``pos`` the entry's place in ``log_history``, ``entry`` a VARIANT.
    A document without a log has no rows; one that is no JSON object raises."""
    raw = spark.read.text(path, wholetext=True)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return log_entries(raw.select(run.alias("run"), "value"), "value")


def log_entries(docs: DataFrame, value: str) -> DataFrame:
    """(run, pos, entry) of the documents ``value`` (JSON text) of each ``run``."""
    doc = F.when(F.json_object_keys(value).isNotNull(), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit("log is not a JSON object: "), F.col("run"))))
    log = F.variant_get(F.parse_json(doc), "$.log_history", "array<variant>")
    return docs.select("run", F.posexplode(log).alias("pos", "entry"))


def has_field(entry: Column, name: str) -> Column:
    """Whether the entry has the field, null or not."""
    return F.coalesce(F.map_contains_key(entry.cast("map<string,variant>"), name), F.lit(False))


def number(entry: Column, name: str) -> Column:
    return F.variant_get(entry, f"$.{name}", "double")


def last_eval(entries: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, last): the last entry of each run that has ``eval_wer``, as wer, cer, eval_loss (null if
    it has none), epoch and step; null for a run without one. ``runs`` adds runs without any entry.
    An evaluation without ``eval_cer`` raises. A run's entries are combined before the shuffle."""
    e = F.col("entry")
    needed = F.when(has_field(e, "eval_cer"), number(e, "eval_cer")).otherwise(
        F.raise_error(F.concat(F.lit("evaluation without eval_cer in run "), F.col("run").cast("string"))).cast("double"))
    record = F.when(has_field(e, "eval_wer"), F.struct(
        number(e, "eval_wer").alias("wer"), needed.alias("cer"), number(e, "eval_loss").alias("eval_loss"),
        number(e, "epoch").alias("epoch"), F.variant_get(e, "$.step", "bigint").alias("step")))
    last = entries.select("run", "pos", record.alias("r")).groupBy("run").agg(
        F.max_by("r", F.when(F.col("r").isNotNull(), F.col("pos"))).alias("last"))
    return last if runs is None else runs.select("run").distinct().join(last, "run", "left")


# run documents

def speaker_aggregates(per: DataFrame) -> DataFrame:
    """A6 + A7 as one row: overall_macro and severity_macro (a map by tier, in their order) of the table (speaker,
    severity, sev_pos, wer, cer, num_samples). An empty table raises."""
    means = lambda: F.struct(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"))
    overall = per.agg(means().alias("overall_macro"), F.count(F.lit(1)).alias("_n"))
    tiers = per.groupBy("severity").agg(F.struct(
        F.coalesce(F.min("sev_pos"), F.lit(1 << 30)).alias("place"), F.col("severity").alias("severity"), F.avg("wer").alias("wer"),
        F.avg("cer").alias("cer"), F.count(F.lit(1)).alias("num_speakers"), F.sum("num_samples").cast("bigint").alias("num_samples")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["severity"], t.dropFields("place", "severity")))
    listed = tiers.agg(F.map_from_entries(ordered)).scalar()               # a row per tier
    some = F.when(F.col("_n") > 0, F.col("overall_macro")).otherwise(
        F.raise_error(F.lit("cannot aggregate an empty table of speakers")).cast("struct<wer:double,cer:double>"))
    return overall.select(some.alias("overall_macro"), listed.alias("severity_macro"))


def macro_overall(per: DataFrame) -> DataFrame:
    """The unweighted means of the speakers' rates; no speakers raise."""
    return speaker_aggregates(per.withColumns({"severity": F.lit(""), "sev_pos": F.lit(None).cast("int")})).select("overall_macro.*")


def _by_speaker(rows: DataFrame, value: Column, order: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(order, F.col("speaker").alias("k"), value.alias("v"))))
    return rows.agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))).scalar()


def result_document(per: DataFrame, head: Mapping[str, Column], created_at: Column) -> DataFrame:
    """The result document of a run as one row ``document`` (JSON): schema version, time, ``head``
    (mode, model and so on), the selected speakers in order, their severities, metrics and folds, and the
    aggregates. ``per`` has a row per speaker: speaker, fold_no, severity, sev_pos, wer, cer, num_samples and
    ``fold`` (a struct); it is read as a table and only its maps, one entry a speaker, meet in the document."""
    metrics = F.struct("wer", "cer", "num_samples", "severity")
    selected = per.agg(F.transform(F.sort_array(F.collect_list(F.struct("fold_no", "speaker"))), lambda s: s["speaker"])).scalar()
    doc = speaker_aggregates(per).select(
        F.lit(1).alias("schema_version"), created_at.alias("created_at"), *[c.alias(k) for k, c in head.items()],
        selected.alias("selected_speakers"), _by_speaker(per, F.col("severity"), "fold_no").alias("speaker_severity"),
        _by_speaker(per, metrics, "fold_no").alias("speaker_metrics"), _by_speaker(per, F.col("fold"), "fold_no").alias("folds"),
        "overall_macro", "severity_macro")
    return doc.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def last_epoch_document(last: DataFrame, severity: DataFrame, head: Mapping[str, Column], created_at: Column) -> DataFrame:
    """The document of the final epochs: per speaker (``run``) the last evaluation with its severity, or null."""
    rows = last.withColumnRenamed("run", "speaker").join(severity.select("speaker", "severity"), "speaker")
    folds = _by_speaker(rows, F.when(F.col("last").isNotNull(), F.struct("last.*", "severity")), "speaker")
    doc = last.sparkSession.range(1).select(
        F.lit(1).alias("schema_version"), created_at.alias("created_at"), *[c.alias(k) for k, c in head.items()],
        F.lit("trainer_state.log_history").alias("source"), folds.alias("folds"))
    return doc.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


# protocols

#: What a protocol says about selection and aggregation, per mode.
PROTOCOL = {
    "loso": ("speaker matching the held-out-* model", "same retention set for every LOSO model", "unweighted macro average over LOSO models"),
    "single": (None, "retention set for the single selected model", "single model; no model-level averaging"),
}
NORMALIZATION = "Whisper BasicTextNormalizer"


def protocol(mode: Column, primary: tuple[Column, Column], retention: tuple[Column, Column], max_audio_seconds: Column, max_samples: Column,
             held_out_speaker: Column | None = None, all_speakers: str = "all filtered speakers") -> Column:
    """The whole protocol of an evaluation as a struct. ``primary`` and ``retention`` are (dataset, split); in
    mode ``single`` the primary selection is the held-out speaker or ``all_speakers``. An unknown mode raises."""
    known = F.when(mode.isin(*PROTOCOL), mode).otherwise(F.raise_error(F.concat(F.lit("unknown evaluation mode: "), mode)).cast("string"))
    loso, single = PROTOCOL["loso"], PROTOCOL["single"]
    held = F.lit(None).cast("string") if held_out_speaker is None else F.nullif(held_out_speaker, F.lit(""))
    pick = lambda a, b: F.when(mode == "loso", a).otherwise(b)
    part = lambda source, selection: F.struct(source[0].alias("dataset"), source[1].alias("split"), selection.alias("selection"))
    return F.struct(known.alias("evaluation_mode"), part(primary, pick(F.lit(loso[0]), F.coalesce(held, F.lit(all_speakers)))).alias("primary"),
                    part(retention, pick(F.lit(loso[1]), F.lit(single[1]))).alias("retention"),
                    max_audio_seconds.alias("max_audio_seconds"), max_samples.alias("max_samples"),
                    F.lit(NORMALIZATION).alias("metric_normalization"), pick(F.lit(loso[2]), F.lit(single[2])).alias("result_aggregation"))


def fingerprint(value: Column) -> Column:
    """A protocol's hash: of its JSON, nulls kept, so no two different ones are alike."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def resume_verdict(stored: Column, current: Column) -> Column:
    """What forbids to go on with a stored report, else null. ``stored`` and ``current`` are structs of mode,
    method_dir, model_source and protocol; the checks come in this order."""
    same = lambda f: stored[f].eqNullSafe(current[f])
    return (F.when(~same("mode"), "different evaluation mode")
            .when((current["mode"] == "loso") & ~same("method_dir"), "different method folder")
            .when((current["mode"] != "loso") & ~same("model_source"), "different model")
            .when(fingerprint(stored["protocol"]) != fingerprint(current["protocol"]), "different protocol"))


def guard_resume(pairs: DataFrame, stored: str, current: str, run: str) -> DataFrame:
    """The rows of ``pairs`` whose stored report may be completed; a row that may not raises when it is read,
    with its run and the reason. Rows without a stored report pass."""
    why = F.when(F.col(stored).isNotNull(), resume_verdict(F.col(stored), F.col(current)))
    said = F.raise_error(F.concat(F.lit("stored report of "), F.col(run).cast("string"), F.lit(" uses a "), why)).cast("boolean")
    return pairs.where(F.when(why.isNull(), F.lit(True)).otherwise(said))


# reports

#: The report's words.
TITLES = {"loso": "LOSO retention evaluation", "single": "Single-model evaluation"}
FIRST_COLUMN = {"loso": "Held-out model", "single": "Model selection"}
INTRO = {"loso": "WER/CER are percentages. The method average is an unweighted macro average over completed LOSO models.",
         "single": "WER/CER are percentages. Exactly one model is evaluated."}
DASH = "—"


def report_lines(models: DataFrame, mode: str, method: str, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(line_no, line) of the markdown report. ``models``: a row per model with speaker, model_type and, per target
    (column prefix, name, note), ``<prefix>_samples``, ``<prefix>_wer`` and ``<prefix>_cer`` (null: not evaluated). The models
    are sorted by speaker; mode ``loso`` ends with the averages over the models that have both rates."""
    if mode not in TITLES:
        raise ValueError(f"unknown evaluation mode {mode!r}")
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    cells = [F.coalesce("speaker", F.lit("all")), F.col("model_type")]
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    foot = [F.lit("**Method macro average**"), F.lit(DASH)]
    for p, *_ in targets:
        cells += [F.coalesce(F.col(f"{p}_samples").cast("string"), F.lit(DASH)), format_metric(F.col(f"{p}_wer")), format_metric(F.col(f"{p}_cer"))]
        done = F.col(f"{p}_wer").isNotNull() & F.col(f"{p}_cer").isNotNull()
        foot += [F.lit(DASH), *[bold(format_metric(F.avg(F.when(done, F.col(f"{p}_{m}"))))) for m in ("wer", "cer")]]
    names = [FIRST_COLUMN[mode], "Model type", *[f"{n} {x}" for _, n, _ in targets for x in ("samples", "WER", "CER")]]
    fixed = [(0, f"# {TITLES[mode]}: {method}"), (1, ""), (2, INTRO[mode]), (3, ""), (4, "| " + " | ".join(names) + " |"),
             (5, "|---|---|" + "---:|" * (3 * len(targets)))]
    after = [(8, ""), *[(9 + i, f"- {n}: {note}") for i, (_, n, note) in enumerate(targets)], (9 + len(targets), "")]
    lines = models.sparkSession.createDataFrame([(a, "", t) for a, t in fixed + after], "part int, key string, line string")
    lines = lines.unionByName(models.select(F.lit(6).alias("part"), F.coalesce("speaker", F.lit("")).alias("key"), row(cells).alias("line")))
    if mode == "loso":
        lines = lines.unionByName(models.agg(row(foot).alias("line")).select(F.lit(7).alias("part"), F.lit("").alias("key"), "line"))
    return number_rows(lines, ["part", "key"], "line_no").select("line_no", "line")
