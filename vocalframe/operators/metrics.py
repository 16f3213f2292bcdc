"""Error-rate aggregation.

Every rate is carried as integral (errors, length) pairs until the final
division, so corpus rates are exact ratios of sums and macro averages are
means of per-group ratios, as in the reference's metric definitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.functions import edits
from vocalframe.functions.bind import bind
from vocalframe.functions.text import normalized_words, with_normalized, words


def pair_errors(df: DataFrame, ref: str = "reference", hyp: str = "prediction",
                normalize: bool = True, ref_norm: str | None = None) -> DataFrame:
    """A1 + A2 per row: word/char edit distance and reference lengths.

    ``normalize=False`` scores raw text (the older scripts' variant, A5).
    ``ref_norm`` names an already-normalised reference column to reuse.
    Adds ``ref_norm, hyp_norm, word_errors, ref_words, char_errors, ref_chars``.
    Each intermediate is its own projection (computed once per row).
    """
    out = df
    if normalize:
        todo = {hyp: "hyp_norm"} if ref_norm is not None else {ref: "ref_norm", hyp: "hyp_norm"}
        out = with_normalized(out, todo)
    else:
        out = out.withColumns({"ref_norm": F.coalesce(F.col(ref), F.lit("")),
                               "hyp_norm": F.coalesce(F.col(hyp), F.lit(""))})
    if ref_norm is not None:
        out = out.withColumn("ref_norm", F.col(ref_norm))
    tok = normalized_words if normalize else words
    out = bind(out, {"_rw": tok(F.col("ref_norm")), "_hw": tok(F.col("hyp_norm"))})
    out = bind(out, {"_rs": F.array_join("_rw", " "), "_hs": F.array_join("_hw", " ")})
    # long: a big DP table, or more words than one pair dictionary can code (an
    # upper bound on its size); only short pairs build the dictionary
    long = ((F.size("_rw") + F.size("_hw") > edits.MAX_DICT)
            | (F.char_length("_rs").cast("bigint") * F.char_length("_hs") > edits.LONG_PAIR_CELLS))
    out = bind(out, {"_long": long})
    out = bind(out, {"_d": F.when(~F.col("_long"), edits.pair_dictionary(F.col("_rw"), F.col("_hw")))})
    lp = edits.long_pair_udf(*[F.when(F.col("_long"), F.col(c)) for c in ("_rs", "_hs")])
    out = bind(out, {"_lp": lp})
    short = ~F.col("_long")
    out = out.withColumns({
        "word_errors": F.coalesce(
            F.when(short, edits.word_edit_distance(F.col("_rw"), F.col("_hw"), F.col("_d"))).cast("bigint"),
            F.col("_lp.word_errors")),
        "ref_words": F.size("_rw").cast("bigint"),
        "char_errors": F.coalesce(
            F.when(short, edits.char_edit_distance(F.col("_rs"), F.col("_hs"))).cast("bigint"),
            F.col("_lp.char_errors")),
        "ref_chars": F.char_length("_rs").cast("bigint"),
    })
    return out.drop("_rw", "_hw", "_rs", "_hs", "_d", "_long", "_lp")


def _rate(err: Column, length: Column) -> Column:
    """100 * errors / length; NULL when the reference side is empty."""
    return F.when(length > 0, F.lit(100.0) * err / length)


def rate_columns(prefix: str = "") -> list[Column]:
    we, rw = F.sum("word_errors"), F.sum("ref_words")
    ce, rc = F.sum("char_errors"), F.sum("ref_chars")
    return [
        _rate(we, rw).alias(f"{prefix}wer"),
        _rate(ce, rc).alias(f"{prefix}cer"),
        F.count(F.lit(1)).alias("num_samples"),
        we.alias("word_errors"), rw.alias("ref_words"),
        ce.alias("char_errors"), rc.alias("ref_chars"),
    ]


def corpus_rates(scored: DataFrame, by: str = "speaker", overall_label: str = "overall") -> DataFrame:
    """A3: corpus WER/CER per group plus one ``overall`` row (grouping sets).

    Partial aggregation runs map-side, so a hot speaker costs one combined row
    per task, never a skewed reducer.
    """
    return (scored.rollup(by).agg(*rate_columns(), F.grouping(by).alias("_g"))
            .select(F.when(F.col("_g") == 1, F.lit(overall_label))
                    .otherwise(F.col(by).cast("string")).alias(by),
                    "wer", "cer", "num_samples", "word_errors", "ref_words",
                    "char_errors", "ref_chars"))


def metric_record(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A4: ``wer, cer, num_samples`` (plus the integral sums) per key set."""
    return scored.groupBy(*keys).agg(*rate_columns())


def macro_average(per_group: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of per-speaker rates (over ``keys`` groups)."""
    aggs = [F.avg("wer").alias("wer"), F.avg("cer").alias("cer"),
            F.count(F.lit(1)).alias("num_speakers"),
            F.sum("num_samples").cast("bigint").alias("num_samples")]
    return per_group.groupBy(*keys).agg(*aggs)


def severity_macro(per_speaker: DataFrame, dimension: DataFrame) -> DataFrame:
    """A7 + J4: per severity tier, mean WER/CER over its speakers, speaker count,
    sample sum; tiers in the dimension's order, unlisted tiers after, by name.

    Whether the dimension is broadcast is left to its measured size. Speakers missing from it raise, as the reference's lookup does.
    """
    j = per_speaker.join(dimension, "speaker", "left")
    j = j.withColumn("severity", F.coalesce(
        F.col("severity"),
        F.raise_error(F.concat(F.lit("speaker missing from severity map: "), F.col("speaker")))
        .cast("string")))
    return (j.groupBy("severity").agg(
        F.avg("wer").alias("wer"), F.avg("cer").alias("cer"),
        F.count(F.lit(1)).alias("num_speakers"),
        F.sum("num_samples").cast("bigint").alias("num_samples"),
        F.min("sev_pos").alias("sev_pos")))


def ordered_tiers(df: DataFrame) -> DataFrame:
    """Listed order first, the rest alphabetically."""
    return df.orderBy(F.coalesce(F.col("sev_pos"), F.lit(1 << 30)), F.col("severity"))


def model_average(results: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Macro over models per target; only completed (non-null wer/cer) records;
    sorted distinct sample counts; nothing completed -> null rates."""
    done = F.col("wer").isNotNull() & F.col("cer").isNotNull()
    return results.groupBy(*keys).agg(
        F.avg(F.when(done, F.col("wer"))).alias("wer"),
        F.avg(F.when(done, F.col("cer"))).alias("cer"),
        F.count(F.when(done, F.lit(1))).alias("num_models"),
        F.array_sort(F.collect_set(F.when(done, F.col("num_samples")))).alias("num_samples_per_model"),
    )
