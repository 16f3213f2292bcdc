"""Deduplication and transcript pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalframe.functions.bind import bind
from vocalframe.functions.text import words


def dedup_per_speaker(df: DataFrame, speaker: str = "speaker", text: str = "text",
                      short_word_max_words: int = 2, idx: str = "idx") -> DataFrame:
    """Keep the first row (lowest ``idx``) per (speaker, short/long class,
    lightly normalised text); rows whose normalised text is empty are dropped.

    Returns (speaker, idx) of the kept rows. ``min`` aggregates map-side, so a
    hot speaker or a hot text is combined before the shuffle.
    """
    # one tokenisation serves both the light normal form and the word count
    # (lowercasing never changes whitespace)
    toks = bind(df.select(F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("speaker"),
                          F.col(idx).alias("idx"), F.col(text).alias("_t")),
                {"_w": words(F.lower(F.col("_t")))}, drop=("_t",))
    keyed = toks.select("speaker", "idx", F.array_join("_w", " ").alias("_norm"),
                        (F.size("_w") <= short_word_max_words).alias("_short"))
    return (keyed.where(F.col("_norm") != "")
            .groupBy("speaker", "_short", "_norm").agg(F.min("idx").alias("idx"))
            .select("speaker", "idx"))


def pair_transcripts(df: DataFrame, control: str, patient: str, key: str,
                     speaker: str = "speaker", idx: str = "idx", keyed=None) -> DataFrame:
    """Every control row whose ``key`` text also occurs for the patient is
    paired with the patient's lowest-idx row of that text; unmatched control rows
    are dropped; several controls may share one partner.

    The patient side is reduced to one row per text before the equi-join, so a
    hot text cannot fan out. ``keyed`` (DataFrame -> DataFrame adding ``key``) is
    applied after each side's speaker filter, so only the two speakers' rows
    pay for deriving the key.
    """
    def side(who):
        d = df.where(F.col(speaker) == who)
        return keyed(d) if keyed is not None else d
    pat = side(patient).groupBy(key).agg(F.min(idx).alias("patient_idx"))
    ctl = side(control).select(F.col(idx).alias("control_idx"), key)
    return ctl.join(pat, key, "inner").select("control_idx", "patient_idx")


def first_appearance(df: DataFrame, value: str, idx: str = "idx") -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(idx).alias("first_idx"))
