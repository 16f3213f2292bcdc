"""Run bookkeeping as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.operators.numbering import running_sums

SPLITS = ("train", "validation", "test")


def speaker_counts(df: DataFrame, speaker: str = "speaker", split: str = "split") -> DataFrame:
    """A10: speaker x split counts with zeros and a total (speakers sorted at the sink)."""
    p = df.groupBy(speaker).pivot(split, list(SPLITS)).count().na.fill(0)
    cols = [F.col(s).cast("bigint").alias(s) for s in SPLITS]
    total = sum((F.col(s) for s in SPLITS), F.lit(0)).cast("bigint").alias("total")
    return p.select(speaker, *cols, total)


def pending_work(catalogue: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(model, target) pairs of the catalogue without a stored result."""
    return catalogue.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field-level overlay -- every field of a new record replaces the stored one, an
    explicit null included; stored fields that new records do not have are kept;
    unmatched records of both sides survive (full outer join)."""
    stored = [c for c in old.columns if c not in keys]
    fresh = [c for c in new.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in stored])
    n = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in fresh])
    j = o.join(n, list(keys), "full_outer")

    def field(c: str) -> F.Column:
        if c not in fresh:
            return F.col(f"_o_{c}").alias(c)
        if c not in stored:
            return F.col(f"_n_{c}").alias(c)
        return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
    return j.select(*keys, *[field(c) for c in [*stored, *[c for c in fresh if c not in stored]]])


def protocol_hash(*cols: str) -> F.Column:
    """Canonical protocol fingerprint: the hash of the fields as JSON, nulls kept, so
    neither a separator in a value nor a null can make two protocols alike."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def running_macro(per_fold: DataFrame, order: str = "fold_no") -> DataFrame:
    """Macro average after each finished fold, by sums per range of folds and a scan inside each
    (``numbering.running_sums``). A fold without a rate counts as done and leaves the average as it is."""
    marked = per_fold.withColumns({"_one": F.lit(1), "_wn": F.col("wer").isNotNull().cast("int"), "_cn": F.col("cer").isNotNull().cast("int")})
    r = running_sums(marked, [order], {"_ws": "wer", "_wc": "_wn", "_cs": "cer", "_cc": "_cn", "folds_done": "_one"})
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    return r.select(*per_fold.columns, mean("_ws", "_wc").alias("running_wer"), mean("_cs", "_cc").alias("running_cer"), "folds_done")


def best_checkpoint(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Lowest eval_wer, earliest step on ties."""
    e = log.where(F.col("eval_wer").isNotNull())
    return e.groupBy(run).agg(F.min_by(F.struct(step, "eval_wer"),
                                       F.struct("eval_wer", step)).alias("_b")).select(run, "_b.*")


def loss_buckets(log: DataFrame, logging_steps: int, run: str = "run", step: str = "step") -> DataFrame:
    """Mean of each loss component since the previous log flush."""
    b = F.floor((F.col(step) - 1) / logging_steps).cast("bigint")
    return log.groupBy(run, b.alias("flush")).agg(F.avg("ce_loss").alias("ce_loss"),
                                                   F.avg("consistency_loss").alias("consistency_loss"))


def newest_checkpoints(ckpt: DataFrame, keep: int, run: str = "run", step: str = "step") -> DataFrame:
    """The newest ``keep`` checkpoints per run. The rank filter lets Spark
    apply a partial per-task top-k before the shuffle (window group limit), so a
    hot run does not ship all its rows."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    return ckpt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def finite_or_zero(c: F.Column) -> F.Column:
    """NaN or +-inf -> 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def latency_table(timings: DataFrame, keys: Sequence[str], seconds: str, order: str) -> DataFrame:
    """A16 (+ A15): mean seconds per (model, device) after dropping each pair's
    first (warm-up) run; total runtime and runs per second on the same rows.

    The warm-up row is found with a partial ``min`` aggregate (one row per
    pair) and removed by an anti-join, so no (model, device) group is ever
    gathered into one task."""
    first = timings.groupBy(*keys).agg(F.min(order).alias(order))
    kept = timings.join(first, [*keys, order], "left_anti")
    n = F.count(F.lit(1))
    return kept.groupBy(*keys).agg(
        F.round(F.avg(seconds), 9).alias("mean_seconds"), n.alias("runs"),
        F.round(F.sum(seconds), 9).alias("runtime"),
        F.round(n / F.sum(seconds), 9).alias("samples_per_second"))


def refresh_averages(results: DataFrame, mode: str) -> DataFrame:
    """``loso`` -> per-target averages over models (A8); ``single`` -> the one
    model's results copied through (no averages). The caller stamps updated_at."""
    from vocalframe.operators.metrics import model_average
    if mode == "loso":
        return model_average(results)
    if mode == "single":
        return results.select("target", "wer", "cer", F.lit(1).cast("bigint").alias("num_models"),
                              F.array(F.col("num_samples")).alias("num_samples_per_model"))
    raise ValueError(f"unknown evaluation mode {mode!r}")


def check_resume(stored: DataFrame, current: DataFrame, keys: Sequence[str], fingerprint: str) -> None:
    """Refuse to resume when a stored run's protocol fingerprint differs from
    the current one (compares one row per run; raises naming the runs)."""
    j = stored.select(*keys, F.col(fingerprint).alias("_s")).join(
        current.select(*keys, F.col(fingerprint).alias("_c")), list(keys), "inner")
    bad = j.where(F.col("_s") != F.col("_c")).select(*keys).collect()
    if bad:
        raise ValueError(f"stored results were produced with a different protocol: {[tuple(r) for r in bad]}")
