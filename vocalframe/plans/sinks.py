"""Prediction documents of every shape, written by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.text import with_normalized
from vocalframe.operators.numbering import number_rows
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.session import checkpoint_dir
from vocalframe.sources import documents, fixtures

COLUMNS = ("shape", "idx", "audio_path", "speaker", "prediction", "reference", "prediction_norm", "reference_norm")


def _predicted(utt: DataFrame) -> DataFrame:
    utt = fixtures.with_prediction(utt).withColumn("prediction", F.concat("prediction", F.lit("!")))
    return with_normalized(utt, "prediction", "pn")


@register("prediction_documents", ("S11", "S10", "U5"), V.with_views(V.LINES, V.UTT, V.TOK, V.HYP, "np AS (SELECT *, array_to_string(hw, ' ') AS hs FROM hyp)") + f""",
p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS k, speaker, text, norm, hs || '!' AS pred, {V.t1("hs || '!'")} AS pn,
             speaker || '/' || idx || '.wav' AS audio FROM np)
SELECT 'array' AS shape, NULL::BIGINT AS idx, audio AS audio_path, NULL AS speaker, pred AS prediction, NULL AS reference,
       NULL AS prediction_norm, NULL AS reference_norm FROM p
UNION ALL SELECT 'lines', NULL, NULL, speaker, pred, text, pn, norm FROM p
UNION ALL SELECT 'samples', NULL, NULL, NULL, pred, text, NULL, NULL FROM p
UNION ALL SELECT 'indexed', k, NULL, NULL, pred, text, pn, norm FROM p""")
def prediction_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four prediction documents over every line, each one file, and their records."""
    # one table in order and numbered, for all documents; texts are normalised after the shuffle
    utt = number_rows(fixtures.lines(spark, sf_dir).select("idx", "speaker", "text"), ["idx"], "position", then=_predicted)
    df = utt.select("idx", "position", "speaker", "prediction", F.col("text").alias("reference"), F.col("text").alias("transcription"),
                    F.concat("speaker", F.lit("/"), F.col("idx"), F.lit(".wav")).alias("audio_path"),
                    *[F.col("pn").alias(c) for c in ("pred_normalized", "normalized_prediction")],
                    *[F.col("norm").alias(c) for c in ("trans_normalized", "normalized_reference")])
    root = f"{checkpoint_dir(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    named = {"trans_normalized": "reference_norm", "normalized_reference": "reference_norm", "pred_normalized": "prediction_norm",
             "normalized_prediction": "prediction_norm", "transcription": "reference"}
    out = None
    for shape, (*_, fields) in documents.SHAPES.items():
        documents.write_predictions(df, f"{root}/{shape}.json", shape, position="position")
        got = documents.read_document(spark, f"{root}/{shape}.json", ", ".join(f"{f} {'bigint' if f == 'idx' else 'string'}" for f in fields))
        got = got.withColumnsRenamed(named).withColumn("shape", F.lit(shape))
        got = got.select(*[F.col(c) if c in got.columns else F.lit(None).cast("bigint" if c == "idx" else "string").alias(c) for c in COLUMNS])
        out = got if out is None else out.unionByName(got)
    return out
