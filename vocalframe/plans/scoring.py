"""Scoring plans over the test corpus: normalise, edit distances, corpus and
macro rates (T1-T3, U5, A1-A7, J3, J4, W3, T11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.text import format_metric, light_normalize, with_normalized, word_count
from vocalframe.operators import metrics
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.sources import fixtures


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its derived prediction and per-pair error counts."""
    utt = fixtures.with_prediction(fixtures.lines(spark, sf_dir))
    return metrics.pair_errors(utt, ref="text", hyp="prediction", ref_norm="norm")


def speaker_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_rates(scored_lines(spark, sf_dir), by="speaker")


@register("speaker_error_rates", ("A1", "A2", "A3", "T1", "U5", "P10"),
          V.with_views(V.SCORED) + f"""
SELECT CASE WHEN grouping(speaker) = 1 THEN 'overall' ELSE speaker END AS speaker, {V.rates()}
FROM err GROUP BY ROLLUP (speaker)""")
def speaker_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: corpus WER/CER per speaker plus ``overall``."""
    return speaker_rates(spark, sf_dir)


@register("utterance_errors", ("A1", "A2", "T1"),
          V.with_views(V.SCORED) + """
SELECT idx, speaker, word_errors, ref_words, char_errors, ref_chars FROM err""")
def utterance_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select(
        "idx", "speaker", "word_errors", "ref_words", "char_errors", "ref_chars")


@register("normalized_text", ("T1", "U5"),
          V.with_views(V.LINES) + f"SELECT idx, {V.t1('text')} AS norm FROM lines")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_normalized(fixtures.lines(spark, sf_dir), "text", "norm").select("idx", "norm")


@register("light_normalized_text", ("T2", "T3", "T12"),
          V.with_views(V.LINES) + f"""
SELECT idx, {V.light('text')} AS light,
       len(CASE WHEN {V.light('text')} = '' THEN []::VARCHAR[] ELSE string_split({V.light('text')}, ' ') END)::INTEGER AS n_words
FROM lines""")
def light_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return fixtures.lines(spark, sf_dir).select(
        "idx", light_normalize(t).alias("light"), word_count(t).alias("n_words"))


@register("unnormalized_error_rates", ("A5", "A1", "A2"),
          V.with_views(V.LINES) + f""",
tok AS (SELECT *, string_split(regexp_replace(trim(text), ' +', ' ', 'g'), ' ') AS w FROM lines),
p AS (SELECT speaker, w, list_transform(list_filter(w, lambda x, i: i % 7 <> 0),
                           lambda x, k: CASE WHEN k % 5 = 0 THEN 'zz' ELSE x END) AS hw FROM tok),
err AS (SELECT speaker, (len(w) // 7 + (len(w) - len(w) // 7) // 5)::BIGINT AS word_errors,
               len(w)::BIGINT AS ref_words FROM p)
SELECT CASE WHEN grouping(speaker) = 1 THEN 'overall' ELSE speaker END AS speaker,
       CASE WHEN sum(ref_words) > 0 THEN 100.0::DOUBLE * sum(word_errors) / sum(ref_words) END AS wer,
       count(*)::BIGINT AS num_samples
FROM err GROUP BY ROLLUP (speaker)""")
def unnormalized_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 variant of the older scripts: raw (un-normalised) text, WER only.

    Predictions are derived from the raw words of the line; the 'zz' filler never
    occurs as a raw token either, so the oracle's counting argument still holds.
    """
    from vocalframe.functions.text import words
    utt = fixtures.lines(spark, sf_dir)
    utt = utt.withColumn("prediction", F.array_join(fixtures.corrupt(words(F.col("text"))), " "))
    scored = metrics.pair_errors(utt, ref="text", hyp="prediction", normalize=False)
    return metrics.corpus_rates(scored, by="speaker").select("speaker", "wer", "num_samples")


@register("prediction_alignment", ("J3", "A4"),
          V.with_views(V.SCORED) + f"""
SELECT lang AS target, {V.rates()} FROM err GROUP BY lang""")
def prediction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions arrive as their own (idx, prediction) table and are aligned
    to references by key (an equi-join), then scored per target (A4)."""
    utt = fixtures.lines(spark, sf_dir)
    preds = fixtures.predictions(spark, sf_dir)
    joined = utt.join(preds, "idx", "inner")
    scored = metrics.pair_errors(joined, ref="text", hyp="prediction")
    return metrics.metric_record(scored, ["lang"]).withColumnRenamed("lang", "target")


_SPK = V.with_views(V.SCORED, V.SEV) + f""",
spk AS (SELECT speaker, {V.rates()} FROM err GROUP BY speaker)
"""


@register("macro_overall", ("A6",), _SPK + """
SELECT round(avg(wer), 9) AS wer, round(avg(cer), 9) AS cer, count(*)::BIGINT AS num_speakers,
       sum(num_samples)::BIGINT AS num_samples FROM spk""")
def macro_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker"])
    m = metrics.macro_average(per)
    return m.select(F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"),
                    "num_speakers", "num_samples")


@register("severity_macro", ("A7", "J4", "W3"), _SPK + """
SELECT severity, round(avg(wer), 9) AS wer, round(avg(cer), 9) AS cer,
       count(*)::BIGINT AS num_speakers, sum(num_samples)::BIGINT AS num_samples,
       row_number() OVER (ORDER BY coalesce(min(sev_pos), 1073741824), severity)::INTEGER AS tier_rank
FROM spk JOIN sevd USING (speaker) GROUP BY severity""")
def severity_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker"])
    dim = fixtures.severity_dimension(spark, sf_dir)
    tiers = metrics.severity_macro(per, dim)
    # the tier table is one row per tier: a global window over it is trivial
    from pyspark.sql import Window
    w = Window.orderBy(F.coalesce(F.col("sev_pos"), F.lit(1 << 30)), F.col("severity"))
    return tiers.select("severity", F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"),
                        "num_speakers", "num_samples",
                        F.row_number().over(w).cast("int").alias("tier_rank"))


@register("metric_text", ("T11", "A3"), V.with_views(V.SCORED) + f"""
, r AS (SELECT speaker, {V.rates()} FROM err GROUP BY speaker)
SELECT speaker, coalesce(format('{{:.3f}}', round(wer, 3)), '—') AS wer_text,
       coalesce(format('{{:.3f}}', round(cer, 3)), '—') AS cer_text FROM r""")
def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.metric_record(scored_lines(spark, sf_dir), ["speaker"])
    return per.select("speaker", format_metric(F.col("wer")).alias("wer_text"),
                      format_metric(F.col("cer")).alias("cer_text"))
