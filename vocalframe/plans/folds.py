"""Run folders over the speakers of the corpus: written by Spark, read back as a
catalogue, and model sources resolved (S4, S6, S7, S8, P12, D7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.operators import splits
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.session import checkpoint_dir
from vocalframe.sources import files, fixtures, folds
from vocalframe.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_folds(spark: SparkSession, sf_dir: str) -> str:
    """A run folder per speaker (source), with its document counts; every third one holds an adapter,
    a bottleneck model or a full model, and every other config names its model."""
    per = table(spark, sf_dir, "documents", "source").groupBy(F.col("source").alias("speaker")).agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumns({"all": per.agg(F.sum("c")).scalar(), "n": F.regexp_extract("speaker", r"(\d+)$", 1).cast("int")})
    model = F.when(F.col("n") % 2 == 0, F.concat(F.lit("org/model-"), F.col("n")))
    config = F.to_json(F.struct(F.col("speaker").alias("held_out_speaker"), (F.col("all") - F.col("c")).alias("train_samples"),
                                F.col("c").alias("validation_samples"), F.struct(model.alias("model_name")).alias("parameters")))
    adapter = F.create_map(F.lit(folds.ADAPTER_CONFIG), F.concat(F.lit('{"base_model_name_or_path": "base-'), F.col("n"), F.lit('"}')),
                           F.lit(folds.MODEL_CONFIG), F.lit("{}"))
    other = F.create_map(F.lit(folds.MODEL_CONFIG), F.when(F.col("n") % 3 == 1, f'{{"{folds.BOTTLENECK_KEY}": 8}}').otherwise('{"d": 1}'))
    root = _folder(spark, "runs")
    folds.write_run_folders(per.select("speaker", config.alias("run_config"), F.when(F.col("n") % 3 == 0, adapter).otherwise(other).alias("files")),
                            root).agg(F.sum("folders")).collect()
    return root


_PER = """per AS (SELECT source AS speaker, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS n, count(*)::BIGINT AS c FROM documents GROUP BY source),
kinds AS (SELECT speaker, n, c, CASE n % 3 WHEN 0 THEN 'lora_adapter' WHEN 1 THEN 'bottleneck_adapter' ELSE 'whisper_finetuned' END AS model_type FROM per)"""


@register("fold_catalogue", ("S6", "S7", "S8", "T5"), V.with_views(_PER) + f"""
SELECT speaker, 'held-out-' || speaker AS fold, model_type,
       CASE WHEN n % 2 = 0 THEN 'org/model-' || n ELSE '{folds.DEFAULT_MODEL}' END AS base_model,
       ((SELECT sum(c) FROM per) - c)::BIGINT AS train_samples, c AS validation_samples
FROM kinds""")
def fold_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speaker's run folder, found and checked by the data source."""
    cat = folds.fold_catalogue(spark, written_folds(spark, sf_dir))
    count = lambda k: F.get_json_object("run_config", f"$.{k}").cast("bigint").alias(k)
    return cat.select("speaker", F.substring_index("fold_dir", "/", -1).alias("fold"), "model_type", "base_model",
                      count("train_samples"), count("validation_samples"))


@register("model_sources", ("S7", "S8"), V.with_views(_PER) + """
SELECT 'final-model' AS source, speaker, model_type, CASE WHEN n % 4 = 0 THEN 'given-' || n
       WHEN model_type = 'lora_adapter' THEN 'base-' || n ELSE 'held-out-' || speaker || '/final-model' END AS base_model FROM kinds
UNION ALL
SELECT 'org/model-' || n, speaker, 'whisper_pretrained', CASE WHEN n % 4 = 0 THEN 'given-' || n ELSE 'org/model-' || n END FROM kinds""")
def model_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and base model of every fold's folder and of a pretrained name per speaker; every fourth has an override."""
    cat = folds.fold_catalogue(spark, written_folds(spark, sf_dir))
    n = F.regexp_extract("speaker", r"(\d+)$", 1).cast("int")
    both = cat.select("speaker", F.explode(F.array(F.col("model_dir"), F.concat(F.lit("org/model-"), n))).alias("at"))
    got = folds.model_sources(both, F.col("at"), F.when(n % 4 == 0, F.concat(F.lit("given-"), n)))
    below = lambda c, k: F.when(F.col(c).contains("/runs-"), F.substring_index(c, "/", -k)).otherwise(F.col(c))
    return got.select(below("at", 1).alias("source"), "speaker", "model_type", below("base_model", 2).alias("base_model"))


@register("speaker_resolution", ("P12", "D7", "S4"), V.with_views(V.SEV) + """,
d AS (SELECT speaker, severity, regexp_extract(speaker, '(\\d+)$', 1)::INTEGER AS n FROM sevd)
SELECT 'default' AS mode, speaker AS held_out, severity, row_number() OVER (ORDER BY n DESC, speaker DESC)::BIGINT AS fold_no
FROM d WHERE lower(severity) <> 'normal'
UNION ALL
SELECT 'all', speaker, severity, row_number() OVER (ORDER BY n DESC, speaker DESC)::BIGINT FROM d
UNION ALL
SELECT 'requested', speaker, severity, CASE speaker WHEN 'src5' THEN 1 WHEN 'src0' THEN 2 ELSE 3 END::BIGINT FROM d
WHERE speaker IN ('src5', 'src0', 'src2')""")
def speaker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers to hold out, from a severity file that Spark writes in falling order: by default, with
    the normal ones, and as requested (with a repeat)."""
    dim = fixtures.severity_dimension(spark, sf_dir).withColumn("n", F.regexp_extract("speaker", r"(\d+)$", 1).cast("int"))
    pairs = F.sort_array(F.collect_list(F.struct("n", "speaker", "severity")), asc=False)      # the file: one document
    body = F.array_join(F.transform(pairs, lambda p: F.format_string('"%s": "%s"', p["speaker"], p["severity"])), ", ")
    at = _folder(spark, "severity")
    dim.agg(F.concat(F.lit('{"_about": "x", '), body, F.lit(', "order_for_lora": ["Mild"]}')).alias("value")).coalesce(1).write.text(at)
    sev = files.load_severity_map(spark, at)
    parts = [splits.resolve_speakers(sev).withColumn("mode", F.lit("default")),
             splits.resolve_speakers(sev, include_normal=True).withColumn("mode", F.lit("all")),
             splits.resolve_speakers(sev, ["src5", "src0", "src5", "src2"]).withColumn("mode", F.lit("requested"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
