"""Scalar functions over ``pages.url`` and ``events`` (T4-T10, T12, T13, P1,
P6, P7, P11, P14, S8, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions import paths as P
from vocalframe.plans.registry import register
from vocalframe.sources.tables import table

_SPK = ", ".join(f"'{s}'" for s in P.SPEAKERS)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio-file-like names derived from pages: '<host letter><nn>_<last part>'
    (every 7th page gets a lowercase, pattern-less prefix)."""
    pg = table(spark, sf_dir, "pages", "page_id", "url")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    stem = F.concat(F.upper(F.substring(host, 1, 1)), F.lpad((F.col("page_id") % 6).cast("string"), 2, "0"))
    name = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string")))\
        .otherwise(stem)
    return pg.select("page_id", "url", F.concat(F.lit("/data/audio/"), name, F.lit("_"),
                                               P.basename(F.col("url"))).alias("path"))


@register("path_functions", ("T4", "T5", "T6", "T7", "T8", "P6", "P7", "P1", "T12"), f"""
WITH f AS (
  SELECT page_id, url, '/data/audio/' ||
         CASE WHEN page_id % 7 = 0 THEN 'x' || page_id::VARCHAR
              ELSE upper(substr(regexp_extract(url, '^https?://([^/]+)', 1), 1, 1)) || lpad((page_id % 6)::VARCHAR, 2, '0') END
         || '_' || string_split(url, '/')[-1] AS path FROM pages),
s AS (SELECT *, string_split(path, '/')[-1] AS base FROM f),
k AS (SELECT *, coalesce(nullif(regexp_extract(base, '^([A-Z]C?\\d{{2}})_', 1), ''), string_split(base, '_')[1]) AS speaker FROM s),
g AS (SELECT *, regexp_replace(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '[^\\pL\\pN_-]', '-', 'g'), '^-+|-+$', '', 'g') AS slug0 FROM k)
SELECT page_id, base AS basename,
       CASE WHEN starts_with(path, '/data/') THEN substr(path, 7) ELSE path END AS relative,
       speaker, speaker IN ({_SPK}) AS known_speaker,
       regexp_extract('held-out-' || speaker, '^held-out-(.+)$', 1) AS fold_speaker,
       coalesce(nullif(slug0, ''), 'model') || '-' || speaker AS slug,
       replace(lower(trim('  ' || (page_id % 4)::VARCHAR || ',' || (page_id % 4 + 4)::VARCHAR || ' ')), ',', '_') AS layers,
       (contains(lower(url), '.en') OR ends_with(lower(url), '-en')) AS english_only,
       coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'none') AS ref
FROM g""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = file_names(spark, sf_dir)
    path, url = F.col("path"), F.col("url")
    spk = P.speaker_from_name(path)
    layers = F.concat(F.lit("  "), (F.col("page_id") % 4).cast("string"), F.lit(","),
                      (F.col("page_id") % 4 + 4).cast("string"), F.lit(" "))
    from vocalframe.functions.text import or_default
    return f.select(
        "page_id", P.basename(path).alias("basename"), P.relative_to(path, "/data").alias("relative"),
        spk.alias("speaker"), P.known_speaker(spk).alias("known_speaker"),
        P.fold_speaker(F.concat(F.lit(P.FOLD_PREFIX), spk)).alias("fold_speaker"),
        P.output_slug(url, spk).alias("slug"), P.layer_slug(layers).alias("layers"),
        P.english_only(url).alias("english_only"),
        or_default(F.regexp_extract(url, r"[?&]ref=([^&#]*)", 1), "none").alias("ref"))


@register("json_time_functions", ("T9", "T10", "T13", "S8", "S9", "P14", "P11"), """
WITH e AS (SELECT event_id, ts, event_type, props, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS ts_iso,
  k,
  CASE WHEN event_type = 'view' THEN '99' ELSE k END AS overlaid,
  coalesce(CASE WHEN event_type = 'click' THEN 'override' END, k) AS base_model,
  'max_new_tokens=225' || CASE WHEN event_type NOT IN ('signup') AND event_type <> 'auto' THEN ';language=' || event_type ELSE '' END
     || CASE WHEN event_id % 2 = 0 THEN ';task=transcribe' ELSE '' END AS options,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END::BIGINT AS n_targets
FROM e""")
def json_time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
    required = {"event_id", "ts", "props"}
    missing = required - set(ev.columns)  # P11
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    props = P.json_object(F.col("props"))
    cfg = F.regexp_replace(props, '"k"', '"base_model_name_or_path"')
    lang = F.when(F.col("event_type") != "signup", F.col("event_type"))
    task = F.when(F.col("event_id") % 2 == 0, F.lit("transcribe"))
    opts = P.generation_options(225, lang, task, F.lit(False))
    order = F.array(F.lit("max_new_tokens"), F.lit("language"), F.lit("task"))
    opts_txt = F.array_join(F.transform(F.filter(order, lambda k: F.element_at(opts, k).isNotNull()),
                                        lambda k: F.concat(k, F.lit("="), F.element_at(opts, k))), ";")
    overlay = F.map_concat(F.create_map(F.lit("k"), F.get_json_object(props, "$.k")),
                           F.when(F.col("event_type") == "view", F.create_map(F.lit("k"), F.lit("99")))
                           .otherwise(F.create_map().cast("map<string,string>")))
    targets = P.expand_targets(F.when(F.col("event_type") == "error", F.lit("both")).otherwise(F.lit("primary")))
    return ev.select(
        "event_id", P.iso_utc(F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")).alias("ts_iso"), F.get_json_object(props, "$.k").alias("k"),
        F.element_at(overlay, F.lit("k")).alias("overlaid"),
        P.base_model(F.when(F.col("event_type") == "click", F.lit("override")), cfg).alias("base_model"),
        opts_txt.alias("options"), F.size(targets).cast("bigint").alias("n_targets"))
