"""Splits, folds, seeds and batches (D1-D11) as column expressions and joins.

No operator here copies rows per fold: a fold is a role *expression* over the
utterance table, and fold sizes come from per-speaker counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.operators.numbering import number_rows
from vocalframe.operators.permute import permuted


def loso_role(df: DataFrame, held_out: str | Column, speaker: str = "speaker") -> DataFrame:
    """D1 for one fold: validation = the held-out speaker's rows, train = all other
    rows (normal speakers included)."""
    h = F.lit(held_out) if isinstance(held_out, str) else held_out
    return df.withColumn("role", F.when(F.col(speaker) == h, "validation").otherwise("train"))


def loso_summary(df: DataFrame, folds: DataFrame, seed: int, speaker: str = "speaker") -> DataFrame:
    """D1 + D7 for all folds at once without materialising fold copies.

    ``folds``: (held_out, fold_no) -- one row per fold, bounded by the speaker
    domain. Validation size = rows of the held-out speaker; train = total - that.
    A held-out speaker without rows raises (as the reference does).
    """
    per = df.groupBy(F.col(speaker).alias("held_out")).agg(F.count(F.lit(1)).alias("validation_samples"))
    total = per.agg(F.coalesce(F.sum("validation_samples"), F.lit(0))).scalar()
    j = folds.join(per, "held_out", "left").withColumn("_total", total)
    v = F.coalesce(F.col("validation_samples"), F.raise_error(
        F.concat(F.lit("speaker not present in the dataset: "), F.col("held_out"))).cast("bigint"))
    return j.select("held_out", "fold_no",
                    (F.lit(seed) + F.col("fold_no") - 1).alias("fold_seed"),
                    (F.col("_total") - v).alias("train_samples"),
                    v.alias("validation_samples"))


def resolve_speakers(severity: DataFrame, requested: Sequence[str] | None = None, include_normal: bool = False,
                     order: Sequence[str] = ("file_pos",)) -> DataFrame:
    """P12 + D7: (held_out, severity, fold_no from 1) of the speakers to hold out.

    Requested speakers keep the order of the request, repeats dropped, whatever their tier; unknown
    ones raise. Without a request: every speaker whose tier is not 'normal' (any case), or every one,
    in the order of the severity file (``order`` must be unique)."""
    if requested:
        wanted = list(dict.fromkeys(requested))
        known = severity.where(F.col("speaker").isin(wanted))
        if missing := sorted(set(wanted) - {r["speaker"] for r in known.select("speaker").collect()}):   # at most the request
            raise ValueError(f"speakers missing from the severity map: {missing}")
        place = F.array_position(F.array(*[F.lit(s) for s in wanted]), F.col("speaker"))
        return known.select(F.col("speaker").alias("held_out"), "severity", place.cast("bigint").alias("fold_no"))
    held = severity if include_normal else severity.where(F.lower("severity") != "normal")
    held = number_rows(held.select(*dict.fromkeys(["speaker", "severity", *order])), list(order), "_no")
    return held.select(F.col("speaker").alias("held_out"), "severity", (F.col("_no") + 1).alias("fold_no"))


def speaker_split(df: DataFrame, validation: str, test: str, speaker: str = "speaker") -> DataFrame:
    """D3: one column instead of three filtered copies."""
    s = F.col(speaker)
    return df.withColumn("split", F.when(s == validation, "validation")
                         .when(s == test, "test").otherwise("train"))


def phrase_split(df: DataFrame, text: str, every: int, idx: str = "idx") -> DataFrame:
    """Number distinct texts by first appearance (0-based); a row is
    validation iff its text's number is divisible by ``every``.

    The phrase table is dealt by ranges and numbered (no single-task
    window) and joined back on the text; a hot text is one row on the phrase side.
    """
    keyed = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))   # a missing transcript reads as ''
    phrases = keyed.groupBy("_t").agg(F.min(idx).alias("_first"))
    numbered = number_rows(phrases, ["_first"], name="phrase_no")
    out = keyed.join(numbered, "_t", "inner").drop("_t")
    return out.withColumn("split", F.when(F.col("phrase_no") % every == 0, "validation")
                          .otherwise("train")).drop("_first")


def hash_draw(*parts: Column | str) -> Column:
    """Deterministic 32-bit draw from md5 of '|'-joined parts (same in DuckDB)."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def ratio_split(df: DataFrame, seed: int, ratios: Sequence[float] = (0.8, 0.1, 0.1),
                idx: str = "idx") -> DataFrame:
    """D5 ``ratio``: number the rows, shuffle the positions by the seed, then cut exact
    counts (floor(r*n) for train and validation, the rest test). Unlike randomSplit the
    counts are exact and do not depend on partitioning; nothing is sorted by a hash."""
    numbered = number_rows(df, [idx], name="_p")
    n = numbered.count()
    return numbered.withColumn("split", ratio_role(F.col("_p"), n, seed, ratios)).drop("_p")


def ratio_role(position: Column, n: int, seed: int, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> Column:
    """The split of a 0-based position among ``n`` rows, as an expression."""
    train, validation = int(ratios[0] * n), int(ratios[1] * n)
    r = permuted(position, n, seed)
    # one evaluation of the shuffle, whatever the number of splits
    return F.transform(F.array(r), lambda q: F.when(q < train, "train").when(q < train + validation, "validation").otherwise("test"))[0]


def shuffled_batch(position: Column, n: int, seed: int, size: int) -> Column:
    """D11 + D10: the batch of a 0-based position when ``n`` rows are shuffled by ``seed``."""
    return batch_id(permuted(position, n, seed), size)


def first_n(df: DataFrame, n: int | None, idx: str = "idx") -> DataFrame:
    """The first ``n`` rows by position; None or n >= size keeps all.
    ``orderBy().limit()`` plans as a distributed top-k (no full sort)."""
    return df if n is None else df.orderBy(idx).limit(n)


def epochs(df: DataFrame, count: int) -> DataFrame:
    """One copy of each row per epoch (a generator, not a join)."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def sample_seed(seed: int, epoch: Column, size: int | Column, position: Column) -> Column:
    """Seed + epoch * N + position."""
    return F.lit(seed) + epoch * size + position


def batch_id(position: Column, size: int) -> Column:
    """Fixed-size batches in position order."""
    return F.floor(position / F.lit(size)).cast("bigint")


def split_dataset(df: DataFrame, method: str, seed: int = 42,
                  ratios: Sequence[float] = (0.8, 0.1, 0.1),
                  loso_test_speaker: str | None = None, loso_val_speaker: str | None = None,
                  speaker: str = "speaker", idx: str = "idx") -> DataFrame:
    """The split dispatcher -- ``ratio`` (seeded, exact counts) or ``loso``
    (test and validation speakers, the rest train); adds a ``split`` column.
    The index manifest is ``df.select("split", idx)`` (see files.write_split_manifest)."""
    if method == "ratio":
        if abs(sum(ratios) - 1.0) > 1e-9:
            raise ValueError(f"ratios must sum to 1, got {list(ratios)}")
        return ratio_split(df, seed, ratios, idx)
    if method == "loso":
        if not loso_test_speaker or not loso_val_speaker:
            raise ValueError("loso split needs a test and a validation speaker")
        return speaker_split(df, loso_val_speaker, loso_test_speaker, speaker)
    raise ValueError(f"unknown split method {method!r}; expected 'ratio' or 'loso'")
