"""Views that map the driver test tables onto the reference's data model.

* ``lines``: every non-blank line of every document is one utterance;
  ``idx = doc_id * 2^32 + line position``, ``speaker = source``.
* ``predictions``: a deterministic hypothesis per utterance derived from its
  normalised words: every 7th word dropped, then every 5th remaining word
  replaced by ``zz`` (a token absent from the corpus).
* ``severity_dimension``: the distinct sources, assigned a tier by rule.

All of them are whole-table derivations: their work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.text import normalized_words, with_normalized
from vocalframe.session import spread
from vocalframe.sources.tables import table

LINE_STRIDE = 1 << 32  # a text has fewer lines than this, being shorter than 2^31 bytes

# The reference's severity tiers in their listed order.
SEVERITY_ORDER = ["Normal", "Mild", "Moderate", "Mod-Sev", "Severe"]
# Our rule for the test speakers: tier = TIERS[n % 6] for source "src<n>"; the
# sixth tier is deliberately absent from the order list (it sorts last).
TIERS = SEVERITY_ORDER + ["Unlisted"]

DROP_EVERY = 7
REPLACE_EVERY = 5
FILLER = "zz"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    docs = spread(docs, "doc_id")
    parts = docs.select("doc_id", "source", "lang",
                        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return (parts.where(F.trim("line") != "")
            .select((F.col("doc_id") * LINE_STRIDE + F.col("pos")).alias("idx"),
                    "doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("source").alias("speaker"), "lang",
                    F.col("line").alias("text")))


def corrupt(ws):
    """Hypothesis words from reference words (0-based indices in Spark lambdas)."""
    kept = F.filter(ws, lambda w, i: (i + 1) % DROP_EVERY != 0)
    return F.transform(kept, lambda w, k: F.when((k + 1) % REPLACE_EVERY == 0, F.lit(FILLER))
                       .otherwise(w))


def predictions(spark: SparkSession, sf_dir: str, utt: DataFrame | None = None) -> DataFrame:
    """(idx, prediction): what a recogniser would have returned for each line."""
    utt = utt if utt is not None else lines(spark, sf_dir)
    return with_prediction(utt).select("idx", "prediction")


def with_prediction(utt: DataFrame, norm: str = "norm") -> DataFrame:
    """Adds the normalised reference ``norm`` and the derived ``prediction``."""
    if norm not in utt.columns:
        utt = with_normalized(utt, "text", norm)
    return utt.withColumn("prediction", F.array_join(corrupt(normalized_words(F.col(norm))), " "))


def severity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(speaker, severity, sev_pos) for every source present in ``documents``.

    One row per speaker: bounded by the speaker domain, safe to broadcast.
    """
    src = table(spark, sf_dir, "documents", "source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    tiers = F.array(*[F.lit(t) for t in TIERS])
    order = F.array(*[F.lit(t) for t in SEVERITY_ORDER])
    sev = F.element_at(tiers, (n % len(TIERS)) + 1)
    return src.select(F.col("source").alias("speaker"), sev.alias("severity")).withColumn(
        "sev_pos", F.nullif(F.array_position(order, F.col("severity")), F.lit(0)).cast("int"))
