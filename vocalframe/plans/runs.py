"""Run tables: model x target results, catalogue, pending work, upserts,
resume guard, training logs, checkpoints, latency, reports
(A8, A9, A11-A16, A18, J5-J9, W5, W6, P15, S15, T6, T7, T10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalframe.functions.paths import iso_utc
from vocalframe.functions.text import format_metric
from vocalframe.operators import metrics, records, runs
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.plans.scoring import scored_lines
from vocalframe.session import cut_lineage
from vocalframe.sources import fixtures
from vocalframe.sources.tables import table

# the catalogue also lists a target no model has results for yet
TARGETS = ["en", "fr", "de", "es", "it"]
LOG_FLUSH = 50
KEEP_CHECKPOINTS = 2


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: one record per (model = source, target = language)."""
    rec = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker", "lang"])
    # a few rows per model; written once, so a report that reads them often scores the corpus once
    return cut_lineage(rec.select(F.col("speaker").alias("model"), F.col("lang").alias("target"),
                                  "wer", "cer", "num_samples"))


_RES = V.with_views(V.SCORED) + f""",
res AS (SELECT speaker AS model, lang AS target, {V.rates()} FROM err GROUP BY speaker, lang)
"""


@register("model_average", ("A8", "A4"), _RES + """
SELECT target, round(avg(wer), 9) AS wer, round(avg(cer), 9) AS cer, count(*)::BIGINT AS num_models,
       array_to_string(list_sort(list_distinct(list(num_samples))), ',') AS num_samples_per_model
FROM res GROUP BY target""")
def model_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    avg = metrics.model_average(model_results(spark, sf_dir))
    return avg.select("target", F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"),
                      F.col("num_models").cast("bigint").alias("num_models"),
                      F.array_join("num_samples_per_model", ",").alias("num_samples_per_model"))


def _fold_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalframe.plans.splits import _folds
    return _folds(spark, sf_dir).select(F.col("held_out").alias("model"), "fold_no")


_FOLDS = """f AS (SELECT speaker AS model,
             (row_number() OVER (ORDER BY regexp_extract(speaker, '(\\d+)$', 1)::INTEGER, speaker))::BIGINT AS fold_no
      FROM sevd WHERE lower(severity) <> 'normal')"""


@register("evaluation_plan", ("J5", "W6"), V.with_views(V.LINES, V.SEV, _FOLDS) + """,
own AS (SELECT speaker AS model, count(*)::BIGINT AS num_rows FROM lines GROUP BY speaker),
ret AS (SELECT count(*)::BIGINT AS num_rows FROM lines WHERE lang = 'en')
SELECT f.model, 'own_speaker' AS target, own.num_rows, f.fold_no, (SELECT count(*) FROM f)::BIGINT AS num_models
FROM f JOIN own USING (model)
UNION ALL
SELECT f.model, 'retention' AS target, ret.num_rows, f.fold_no, (SELECT count(*) FROM f)::BIGINT AS num_models
FROM f, ret""")
def evaluation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold model is evaluated on its own speaker's rows and on the whole
    retention corpus (here: English lines). Sizes come from grouped counts joined
    to the small model table -- no model x row product is materialised."""
    lines = fixtures.lines(spark, sf_dir)
    models = _fold_models(spark, sf_dir)
    models = models.withColumn("num_models", models.agg(F.count(F.lit(1))).scalar())
    own = lines.groupBy(F.col("speaker").alias("model")).agg(
        F.count(F.lit(1)).alias("own_rows"))
    retention = lines.where(F.col("lang") == "en").agg(F.count(F.lit(1))).scalar()
    own = own.withColumn("retention_rows", retention)
    j = models.join(own, "model")
    tgt = F.explode(F.array(
        F.struct(F.lit("own_speaker").alias("target"), F.col("own_rows").alias("num_rows")),
        F.struct(F.lit("retention").alias("target"), F.col("retention_rows").alias("num_rows"))))
    return j.select("model", "fold_no", "num_models", tgt.alias("_t")).select(
        "model", "_t.target", "_t.num_rows", "fold_no", "num_models")


@register("pending_work", ("J6", "P14"), _RES + f""", cat AS (
  SELECT speaker AS model, unnest({TARGETS!r}::VARCHAR[]) AS target FROM (SELECT DISTINCT speaker FROM lines))
SELECT model, target FROM cat WHERE NOT EXISTS (
  SELECT 1 FROM res WHERE res.model = cat.model AND res.target = cat.target)""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = fixtures.lines(spark, sf_dir).select(F.col("speaker").alias("model")).distinct()
    cat = models.select("model", F.explode(F.array(*[F.lit(t) for t in TARGETS])).alias("target"))
    return runs.pending_work(cat, model_results(spark, sf_dir), ["model", "target"])


@register("result_upsert", ("J7", "T13"), _RES + """,
old AS (SELECT model, target, wer, cer, num_samples, 'held-out-' || model AS fold_dir FROM res WHERE target IN ('en', 'fr')),
new AS (SELECT model, target, CASE WHEN target = 'fr' THEN NULL ELSE round(wer / 2, 9) END AS wer,
               round(cer / 2, 9) AS cer, NULL::BIGINT AS num_samples FROM res WHERE target IN ('fr', 'de'))
SELECT coalesce(new.model, old.model) AS model, coalesce(new.target, old.target) AS target,
       CASE WHEN new.model IS NULL THEN old.wer ELSE new.wer END AS wer,
       CASE WHEN new.model IS NULL THEN old.cer ELSE new.cer END AS cer,
       CASE WHEN new.model IS NULL THEN old.num_samples ELSE new.num_samples END AS num_samples, old.fold_dir AS fold_dir
FROM old FULL OUTER JOIN new ON old.model = new.model AND old.target = new.target""")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report (en, fr) with a field of its own, overlaid by a new one (fr, de) with explicit nulls."""
    res = model_results(spark, sf_dir)
    old = res.where(F.col("target").isin("en", "fr")).withColumn("fold_dir", F.concat(F.lit("held-out-"), "model"))
    new = res.where(F.col("target").isin("fr", "de")).select(
        "model", "target",
        F.when(F.col("target") == "fr", F.lit(None).cast("double")).otherwise(F.round(F.col("wer") / 2, 9)).alias("wer"),
        F.round(F.col("cer") / 2, 9).alias("cer"), F.lit(None).cast("bigint").alias("num_samples"))
    return runs.upsert(old, new, ["model", "target"])


@register("resume_guard", ("J8", "T13"), """
SELECT n_name AS run, sha256('{"mode":"loso","max_s":30,"n_regionkey":' || n_regionkey || ',"source":' || to_json(n_name)::VARCHAR || '}') AS protocol_sha,
       (n_regionkey % 2 = 0) AS resumable FROM nation""")
def resume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored protocol fingerprint per run vs the current one; runs whose
    current protocol differs (odd regions here) must not resume."""
    runs_t = table(spark, sf_dir, "nation", "n_name", "n_regionkey").select(
        F.col("n_name").alias("run"), F.lit("loso").alias("mode"), F.lit(30).alias("max_s"),
        "n_regionkey", F.col("n_name").alias("source"))
    stored = runs_t.select("run", runs.protocol_hash("mode", "max_s", "n_regionkey", "source").alias("protocol_sha"))
    current = runs_t.withColumn("max_s", F.when(F.col("n_regionkey") % 2 == 1, F.lit(20)).otherwise(F.col("max_s")))
    current = current.select("run", runs.protocol_hash("mode", "max_s", "n_regionkey", "source").alias("_cur"))
    return stored.join(current, "run").select("run", "protocol_sha",
                                               (F.col("protocol_sha") == F.col("_cur")).alias("resumable"))


@register("speaker_set_difference", ("J9", "P13"), V.with_views(V.LINES, V.SEV, _FOLDS) + """
SELECT DISTINCT speaker FROM lines WHERE lang = 'de' AND speaker NOT IN (SELECT model FROM f)""")
def speaker_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers requested (those with German lines) that are not fold models."""
    req = fixtures.lines(spark, sf_dir).where(F.col("lang") == "de").select("speaker").distinct()
    folds = _fold_models(spark, sf_dir).select(F.col("model").alias("speaker"))
    return req.join(folds, "speaker", "left_anti")


@register("running_macro", ("A11", "A6"), V.with_views(V.SCORED, V.SEV, _FOLDS) + f""",
spk AS (SELECT speaker AS model, {V.rates()} FROM err GROUP BY speaker),
pf AS (SELECT f.model, f.fold_no, spk.wer, spk.cer FROM f JOIN spk USING (model))
SELECT model, fold_no,
       round(avg(wer) OVER (ORDER BY fold_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_wer,
       round(avg(cer) OVER (ORDER BY fold_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_cer,
       count(*) OVER (ORDER BY fold_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS folds_done
FROM pf""")
def running_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker"]).withColumnRenamed("speaker", "model")
    pf = _fold_models(spark, sf_dir).join(per, "model").select("model", "fold_no", "wer", "cer")
    r = runs.running_macro(pf)
    return r.select("model", "fold_no", F.round("running_wer", 9).alias("running_wer"),
                    F.round("running_cer", 9).alias("running_cer"), "folds_done")


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log view over ``events``: run = user, step = event id; an
    'error' event is an evaluation (value = eval WER), 'purchase' an eval loss,
    'view' and 'click' the two training loss components."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    v, t = F.col("value"), F.col("event_type")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"),
                    F.when(t == "error", v).alias("eval_wer"),
                    F.when(t == "purchase", v).alias("eval_loss"),
                    (F.col("event_id") / 100.0).alias("epoch"),
                    F.when(t == "view", v).alias("ce_loss"),
                    F.when(t == "click", v).alias("consistency_loss"))


_LOG = """log AS (SELECT user_id AS run, event_id AS step,
  CASE WHEN event_type = 'error' THEN value END AS eval_wer,
  CASE WHEN event_type = 'purchase' THEN value END AS eval_loss,
  event_id / 100.0::DOUBLE AS epoch,
  CASE WHEN event_type = 'view' THEN value END AS ce_loss,
  CASE WHEN event_type = 'click' THEN value END AS consistency_loss FROM events)"""


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, pos, entry): every event as a log entry, with the fields of its kind: evaluations ('error')
    have both rates and, at times, a loss; the others have a training loss."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    v, i = F.col("value"), F.col("event_id")
    fields = [(i / 100.0).alias("epoch"), i.alias("step")]
    entry = (F.when((F.col("event_type") == "error") & (i % 3 == 0), F.to_json(F.struct(
                 v.alias("eval_wer"), (v / 2).alias("eval_cer"), (v / 4).alias("eval_loss"), *fields)))
             .when(F.col("event_type") == "error", F.to_json(F.struct(v.alias("eval_wer"), (v / 2).alias("eval_cer"), *fields)))
             .otherwise(F.to_json(F.struct(v.alias("loss"), *fields))))
    return e.select(F.col("user_id").alias("run"), i.alias("pos"), F.parse_json(entry).alias("entry"))


@register("last_eval_metrics", ("A12", "S16"), """
WITH e AS (SELECT user_id AS run, event_id AS step, event_type, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, event_id DESC) AS r FROM events)
SELECT run, CASE WHEN event_type = 'error' THEN value END AS wer, CASE WHEN event_type = 'error' THEN value / 2 END AS cer,
       CASE WHEN event_type = 'error' AND step % 3 = 0 THEN value / 4 END AS eval_loss,
       CASE WHEN event_type = 'error' THEN step / 100.0::DOUBLE END AS epoch, CASE WHEN event_type = 'error' THEN step END AS step,
       event_type = 'error' AS evaluated FROM e WHERE r = 1""")
def last_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last evaluation of every run, from entries of differing fields; a run without one has a null record."""
    last = records.last_eval(log_entries(spark, sf_dir))
    return last.select("run", "last.*", F.col("last").isNotNull().alias("evaluated"))


_PERF = """perf AS (SELECT s.speaker, s.severity, s.sev_pos, r.wer, r.cer, r.num_samples
  FROM sevd s JOIN (SELECT speaker, """ + V.rates() + """ FROM err GROUP BY speaker) r USING (speaker))"""


@register("result_document", ("S18", "A6", "A7"), V.with_views(V.SCORED, V.SEV, _FOLDS, _PERF) + """
SELECT p.speaker, f.fold_no, p.severity, round(p.wer, 9) AS wer, round(p.cer, 9) AS cer, p.num_samples, 'fold-' || f.fold_no AS fold,
       (SELECT round(avg(wer), 9) FROM perf JOIN f ON f.model = perf.speaker) AS overall_wer,
       round(avg(p.cer) OVER (PARTITION BY p.severity), 9) AS severity_cer,
       count(*) OVER (PARTITION BY p.severity)::BIGINT AS num_speakers, '2024-01-02T03:04:05+00:00' AS created_at, 1 AS schema_version
FROM perf p JOIN f ON f.model = p.speaker""")
def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document of a run over the held-out speakers, written as JSON and taken apart again."""
    per = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker"]).join(fixtures.severity_dimension(spark, sf_dir), "speaker")
    per = per.join(_fold_models(spark, sf_dir).withColumnRenamed("model", "speaker"), "speaker")
    per = cut_lineage(per.select("speaker", "fold_no", "severity", "sev_pos", "wer", "cer", "num_samples",
                                 F.struct(F.concat(F.lit("fold-"), "fold_no").alias("name")).alias("fold")))       # a row a speaker
    doc = records.result_document(per, {"mode": F.lit("finetune"), "model_name": F.lit("org/model")},
                                  iso_utc(F.lit("2024-01-02T03:04:05Z").cast("timestamp")))
    metric = "struct<wer:double,cer:double,num_samples:bigint,severity:string>"
    tier = "struct<wer:double,cer:double,num_speakers:bigint,num_samples:bigint>"
    back = doc.select(F.from_json("document", f"schema_version int, created_at string, selected_speakers array<string>, "
                                  f"speaker_severity map<string,string>, speaker_metrics map<string,{metric}>, folds map<string,struct<name:string>>, "
                                  f"overall_macro struct<wer:double,cer:double>, severity_macro map<string,{tier}>").alias("d"))
    back = back.select("d.*", F.posexplode("d.selected_speakers").alias("at", "speaker"))
    m, s = F.element_at("speaker_metrics", F.col("speaker")), F.element_at("speaker_severity", F.col("speaker"))
    t = F.element_at("severity_macro", s)
    return back.select("speaker", (F.col("at") + 1).cast("bigint").alias("fold_no"), s.alias("severity"), F.round(m["wer"], 9).alias("wer"),
                       F.round(m["cer"], 9).alias("cer"), m["num_samples"].alias("num_samples"), F.element_at("folds", F.col("speaker"))["name"].alias("fold"),
                       F.round("overall_macro.wer", 9).alias("overall_wer"), F.round(t["cer"], 9).alias("severity_cer"), t["num_speakers"].alias("num_speakers"),
                       "created_at", "schema_version")


REPORT_TARGETS = [("en", "English", "each model on its own lines."), ("fr", "French", "the same retention lines.")]


def _report_sql(mode: str) -> str:
    """The expected lines, spelled out."""
    m = lambda c: f"coalesce(format('{{:.3f}}', round({c}, 3)), '—')"
    cells = "".join(f" || ' | ' || coalesce({p}_samples::VARCHAR, '—') || ' | ' || {m(p + '_wer')} || ' | ' || {m(p + '_cer')}" for p, *_ in REPORT_TARGETS)
    foot = "".join(f" || ' | — | **' || {m(f'avg({p}_wer)')} || '** | **' || {m(f'avg({p}_cer)')} || '**'" for p, *_ in REPORT_TARGETS)
    title, first, intro = (("LOSO retention evaluation", "Held-out model", "WER/CER are percentages. The method average is an unweighted macro "
                            "average over completed LOSO models.") if mode == "loso" else
                           ("Single-model evaluation", "Model selection", "WER/CER are percentages. Exactly one model is evaluated."))
    fixed = [(0, f"# {title}: study"), (1, ""), (2, intro), (3, ""), (4, f"| {first} | Model type | English samples | English WER | English CER | "
              "French samples | French WER | French CER |"), (5, "|---|---|---:|---:|---:|---:|---:|---:|"), (8, ""),
             (9, "- English: each model on its own lines."), (10, "- French: the same retention lines."), (11, "")]
    sql = " UNION ALL ".join(f"SELECT {k} AS part, '' AS key, '{t}' AS line" for k, t in fixed)
    sql += f" UNION ALL SELECT 6, speaker, '| ' || speaker || ' | full'{cells} || ' |' FROM wide" + (" WHERE speaker = 'src3'" if mode == "single" else "")
    if mode == "loso":
        sql += f" UNION ALL SELECT 7, '', '| **Method macro average** | —'{foot} || ' |' FROM wide"
    return f"SELECT '{mode}' AS mode, (row_number() OVER (ORDER BY part, key) - 1)::BIGINT AS line_no, line FROM ({sql})"


@register("retention_report", ("S15", "T11", "W4"), _RES + """,
wide AS (SELECT model AS speaker, any_value(num_samples) FILTER (target = 'en') AS en_samples, any_value(wer) FILTER (target = 'en') AS en_wer,
                any_value(cer) FILTER (target = 'en') AS en_cer, any_value(num_samples) FILTER (target = 'fr') AS fr_samples,
                any_value(wer) FILTER (target = 'fr') AS fr_wer, any_value(cer) FILTER (target = 'fr') AS fr_cer FROM res GROUP BY model)
""" + _report_sql("loso") + " UNION ALL " + _report_sql("single"))
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of both modes: title, notes, both targets side by side, averages."""
    res = model_results(spark, sf_dir)
    of = lambda p, c: F.any_value(F.when(F.col("target") == p, F.col(c)), True)
    wide = res.groupBy(F.col("model").alias("speaker")).agg(
        *[of(p, c).alias(f"{p}_{n}") for p, *_ in REPORT_TARGETS for c, n in (("num_samples", "samples"), ("wer", "wer"), ("cer", "cer"))])
    wide = wide.withColumn("model_type", F.lit("full"))
    out = records.report_lines(wide, "loso", "study", REPORT_TARGETS).withColumn("mode", F.lit("loso"))
    return out.unionByName(records.report_lines(wide.where("speaker = 'src3'"), "single", "study", REPORT_TARGETS).withColumn("mode", F.lit("single")))


@register("best_checkpoint", ("A13",), V.with_views(_LOG) + """
SELECT run, step, eval_wer FROM (
  SELECT run, step, eval_wer, row_number() OVER (PARTITION BY run ORDER BY eval_wer, step) AS r
  FROM log WHERE eval_wer IS NOT NULL) WHERE r = 1""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_checkpoint(training_log(spark, sf_dir))


@register("loss_buckets", ("A14", "P15", "M11"), V.with_views(_LOG) + f"""
SELECT run, floor((step - 1) / {LOG_FLUSH})::BIGINT AS flush, round(avg(ce_loss), 9) AS ce_loss,
       round(avg(consistency_loss), 9) AS consistency_loss,
       round(avg(CASE WHEN isnan(sqrt(ce_loss - 5)) THEN 0 ELSE sqrt(ce_loss - 5) END), 9) AS guarded,
       round(avg(0.5 * (ce_loss + ce_loss) + 1.0 * consistency_loss), 9) AS combined
FROM log GROUP BY run, floor((step - 1) / {LOG_FLUSH})""")
def loss_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 with P15 (a NaN-producing loss guarded to 0) and M11 (loss combine)."""
    from vocalframe.operators.spectral import combine_loss
    log = training_log(spark, sf_dir)
    b = F.floor((F.col("step") - 1) / LOG_FLUSH).cast("bigint")
    return log.groupBy("run", b.alias("flush")).agg(
        F.round(F.avg("ce_loss"), 9).alias("ce_loss"),
        F.round(F.avg("consistency_loss"), 9).alias("consistency_loss"),
        F.round(F.avg(runs.finite_or_zero(F.sqrt(F.col("ce_loss") - 5))), 9).alias("guarded"),
        F.round(F.avg(combine_loss(F.col("ce_loss"), F.col("ce_loss"), F.col("consistency_loss"), 1.0, guard=False)), 9).alias("combined"))


@register("newest_checkpoints", ("W5",), V.with_views(_LOG) + f"""
SELECT run, step FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r
                       FROM log WHERE eval_wer IS NOT NULL) WHERE r <= {KEEP_CHECKPOINTS}""")
def newest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = training_log(spark, sf_dir).where(F.col("eval_wer").isNotNull()).select("run", "step")
    return runs.newest_checkpoints(ck, KEEP_CHECKPOINTS)


@register("latency_table", ("A16", "A15"), """
WITH t AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'cuda' ELSE 'cpu' END AS device,
                  value AS seconds, event_id,
                  row_number() OVER (PARTITION BY event_type, CASE WHEN user_id % 2 = 0 THEN 'cuda' ELSE 'cpu' END
                                     ORDER BY event_id) AS r FROM events)
SELECT model, device, round(avg(seconds), 9) AS mean_seconds, count(*)::BIGINT AS runs,
       round(sum(seconds), 9) AS runtime, round(count(*) / sum(seconds), 9) AS samples_per_second
FROM t WHERE r > 1 GROUP BY model, device""")
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 latency per (model, device) over recorded timings (events), warm-up
    run dropped; A15 runtime and samples/second on the same rows."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").select(
        F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "cuda").otherwise("cpu").alias("device"),
        F.col("value").alias("seconds"), "event_id")
    return runs.latency_table(e, ["model", "device"], "seconds", "event_id")


@register("agreement_cer", ("A18", "A2"), V.with_views(V.SCORED) + """
SELECT speaker, CASE WHEN sum(length(hs)) > 0 THEN 100.0::DOUBLE * sum(char_errors) / sum(length(hs)) END AS agreement_cer
FROM err GROUP BY speaker""")
def agreement_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CER between two prediction sets on paired rows, the first set taken
    as the reference (edit distance is symmetric, lengths are not)."""
    from vocalframe.functions.text import words
    s = scored_lines(spark, sf_dir)
    s = s.withColumn("_hl", F.char_length(F.array_join(words(F.col("hyp_norm")), " ")))
    return s.groupBy("speaker").agg(
        F.when(F.sum("_hl") > 0, F.lit(100.0) * F.sum("char_errors") / F.sum("_hl")).alias("agreement_cer"))


@register("markdown_report", ("S15", "T11", "W4"), _RES + """,
avgs AS (SELECT target, avg(wer) AS wer, avg(cer) AS cer FROM res GROUP BY target),
body AS (
  SELECT target, 1 AS part, model AS sort_key,
         '| ' || model || ' | ' || coalesce(format('{:.3f}', round(wer, 3)), '—') || ' | ' ||
         coalesce(format('{:.3f}', round(cer, 3)), '—') || ' | ' || num_samples::VARCHAR || ' |' AS line FROM res
  UNION ALL SELECT target, 0, '', '| model | WER | CER | samples |' FROM avgs
  UNION ALL SELECT target, 2, '', '| **macro** | **' || coalesce(format('{:.3f}', round(wer, 3)), '—') || '** | **' ||
         coalesce(format('{:.3f}', round(cer, 3)), '—') || '** | |' FROM avgs)
SELECT target, (row_number() OVER (PARTITION BY target ORDER BY part, sort_key) - 1)::BIGINT AS line_no, line FROM body""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target a markdown table -- header, one row per model (sorted),
    bold macro row. Lines are numbered per target; one task per target holds only
    that target's model rows (bounded by the model count)."""
    res = model_results(spark, sf_dir)
    avgs = res.groupBy("target").agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"))
    body = res.select("target", F.lit(1).alias("part"), F.col("model").alias("sort_key"), F.concat(
        F.lit("| "), F.col("model"), F.lit(" | "), format_metric(F.col("wer")), F.lit(" | "),
        format_metric(F.col("cer")), F.lit(" | "), F.col("num_samples").cast("string"), F.lit(" |")).alias("line"))
    head = avgs.select("target", F.lit(0).alias("part"), F.lit("").alias("sort_key"),
                       F.lit("| model | WER | CER | samples |").alias("line"))
    foot = avgs.select("target", F.lit(2).alias("part"), F.lit("").alias("sort_key"), F.concat(
        F.lit("| **macro** | **"), format_metric(F.col("wer")), F.lit("** | **"),
        format_metric(F.col("cer")), F.lit("** | |")).alias("line"))
    allr = head.unionByName(body).unionByName(foot)
    w = Window.partitionBy("target").orderBy("part", "sort_key")
    return allr.select("target", (F.row_number().over(w) - 1).cast("bigint").alias("line_no"), "line")
