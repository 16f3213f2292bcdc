"""Arrow batch jobs over the test tables, checked rows-only (no SQL form):
log-mel features, waveform augmentation, batched user-model prediction
(X3, X4, X6-X9, X11-X14, D8, D9, U1-U4)."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.operators import audio, infer, splits
from vocalframe.operators import waveform as X
from vocalframe.operators.numbering import number_rows
from vocalframe.plans import oracle_views as V
from vocalframe.plans.arrays import mel, wave
from vocalframe.plans.registry import register
from vocalframe.session import checkpoint_dir, cut_lineage, written
from vocalframe.sources import fixtures, remote
from vocalframe.sources.tables import table

SEED = 42
EPOCHS = 2


@register("log_mel_features", ("X6", "X3", "P2"))
def log_mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every waveform resampled to 16 kHz (X3) and turned into 80-channel log-mel
    frames (X6) in an Arrow job; summarised per row."""
    w = wave(spark, sf_dir).withColumn("s16", X.resample(F.col("samples"), F.col("sampling_rate")))
    feats = audio.log_mel_job(w, "vec_id", "s16", pad_seconds=None)
    flat = F.flatten("features")
    return feats.select(F.col("key").alias("vec_id"), F.size("features").alias("n_mels"),
                        F.size(F.element_at("features", 1)).alias("n_frames"),
                        F.round(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v) / F.size(flat), 6).alias("mean"))


@register("augmented_waveforms", ("X7", "X8", "X9", "X11", "X12", "X13", "X14", "X4", "D8", "D9"))
def augmented_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of seeded augmentation over every waveform; each row's impulse
    response is drawn from all waveforms."""
    w = number_rows(wave(spark, sf_dir), ["vec_id"], "position")      # written once: three consumers
    n = w.count()
    ep = splits.epochs(w, EPOCHS).withColumn(
        "seed", splits.sample_seed(SEED, F.col("epoch"), n, F.col("position")))
    ep = audio.with_response(ep, "seed", w, "vec_id", "samples")
    out = audio.augment_job(ep, "vec_id", "samples", "sampling_rate", "seed", "epoch", "ir")
    return out.select(F.col("key").alias("vec_id"), "epoch", F.size("samples").alias("n_samples"),
                      F.round(audio.rms(F.col("samples")), 6).alias("rms"))


def _prediction_length(g: pd.DataFrame) -> dict[str, float]:
    """A user metric, as additive partial sums over any batch of a group."""
    return {"chars": float(g["prediction"].str.len().sum()), "rows": float(len(g))}


@register("batch_predictions", ("U1", "U2", "U3", "U4"))
def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model applied in batches of 8 to every feature matrix (U1); a user
    row map (U2/U3); a per-batch user metric from additive partials (U4)."""
    w = wave(spark, sf_dir).withColumn("mel", mel(F.col("samples")))
    w = infer.map_rows(w, lambda d: d.withColumn("mel", F.transform("mel", lambda r: F.reverse(r))))
    # written once: the metric below and the output both read it, the model runs once per row
    p = cut_lineage(infer.predict_batches(w, infer.toy_model, "mel", batch_size=8).select("vec_id", "batch_id", "prediction"))
    per = infer.group_metric(p.select("batch_id", "prediction"), ["batch_id"], _prediction_length, ["chars", "rows"])
    return p.select("vec_id", "batch_id", "prediction").join(per, "batch_id")


@register("group_metrics", ("U4",), V.with_views(V.LINES) + """
SELECT speaker, median(length(text))::DOUBLE AS median_chars, count(DISTINCT length(text))::DOUBLE AS lengths FROM lines GROUP BY speaker""")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two user metrics that are no sums, from mergeable states: the median line length of every speaker
    and the number of different lengths."""
    rows = written(fixtures.lines(spark, sf_dir).select("speaker", F.length("text").alias("chars")))
    median = infer.group_metrics(rows, ["speaker"], infer.median_of("chars"), "median_chars")
    return median.join(infer.group_metrics(rows, ["speaker"], infer.distinct_of("chars"), "lengths"), "speaker")


@register("tensor_predictions", ("U1",), """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings),
e AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS j FROM x),
s AS (SELECT label, j, sum(v) AS v FROM e GROUP BY label, j),
w AS (SELECT label, list(v ORDER BY j) AS w FROM s GROUP BY label),
scored AS (SELECT vec_id, w.label, list_dot_product(x, w) AS score,
                  row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(x, w) DESC, w.label) AS r FROM x, w)
SELECT vec_id, label::INTEGER AS label, (score + vec_id % 7)::DOUBLE AS score FROM scored WHERE r = 1""")
def tensor_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model with named tensor inputs and a struct result: class sums of the embeddings as weights,
    in a file that each worker reads once."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    rows = rows.withColumn("x", F.transform("embedding", lambda c: F.floor(64 * c.cast("double")).cast("double")))
    sums = rows.select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.sum("v").alias("v"))
    per = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("w"))
    classes = per.orderBy("label").collect()                    # a row of weights per class
    uri = f"{checkpoint_dir(spark).rstrip('/')}/weights-{uuid.uuid4().hex}.json"
    remote.write_text(uri, json.dumps({"classes": [r["label"] for r in classes], "weights": [r["w"] for r in classes]}))
    got = infer.predict_tensors(rows, infer.linear_classes(uri), {"x": F.col("x"), "offset": (F.col("vec_id") % 7).cast("double")},
                                "struct<label:int,score:double>", {"x": [len(classes[0]["w"]) if classes else 0]})
    return got.select("vec_id", "prediction.label", "prediction.score")
