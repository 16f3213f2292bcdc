"""Label sequences (L1-L5): vocabulary-table encoding, batch padding, start
token handling and decoding, all as joins and window expressions.

A pretrained subword tokenizer is not data work (see README); transcripts are
encoded with a word vocabulary *table*, which scales as a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.functions.text import words
from vocalframe.operators.numbering import number_rows

# Fixed ids of the special tokens of our vocabulary table.
PAD, START, END, UNK = 0, 1, 2, 3
FIRST_WORD_ID = 4
IGNORE = -100


def build_vocabulary(texts: DataFrame, col: str) -> DataFrame:
    """(word, id): distinct words of ``col`` numbered in byte order after the
    special tokens (numbered by ranges, no single-task window)."""
    ws = texts.select(F.explode(words(F.col(col))).alias("word")).distinct()
    return number_rows(ws, ["word"], name="_o").select(
        "word", (F.col("_o") + FIRST_WORD_ID).cast("int").alias("id"))


def encode(df: DataFrame, col: str, vocab: DataFrame, key: str = "idx",
           with_start: F.Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """L1: words -> ids (unknown -> UNK) in order, optional start token first; the columns ``keep``
    (all of ``df``) and ``ids``.

    Words are exploded, joined to the vocabulary (broadcast by AQE when small),
    and regrouped per utterance -- a group is one utterance, bounded by its length. A word travels
    as one long, its position and below it its id; of the row, only what is kept does.
    """
    ex = df.select(key, F.posexplode(words(F.col(col))).alias("pos", "word"))
    part = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.coalesce("id", F.lit(UNK)).cast("bigint"))
    j = ex.join(vocab, "word", "left").select(key, part.alias("_part"))
    ids = j.groupBy(key).agg(F.array_sort(F.collect_list("_part")).alias("_p"))
    ids = ids.select(key, F.transform("_p", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("ids"))
    keep = list(keep or df.columns)
    # the start mark is settled before the join, so that it carries no text
    out = df.select(*keep, (F.lit(False) if with_start is None else with_start).alias("_start")).join(ids, key, "left")
    full = F.coalesce("ids", F.array().cast("array<int>"))
    return out.select(*keep, F.when(F.col("_start"), F.concat(F.array(F.lit(START)), full)).otherwise(full).alias("ids"))


def pad_batch(df: DataFrame, ids: str = "ids", batch: str = "batch_id") -> DataFrame:
    """L2 + L3: pad every sequence to its batch's longest with -100, then drop
    the first position iff every sequence of the batch starts with START.
    Batches are small fixed-size groups, so the batch window is bounded."""
    w = Window.partitionBy(batch)
    out = df.withColumns({
        "_mx": F.max(F.size(ids)).over(w),
        "_all_start": F.bool_and(F.coalesce(F.get(F.col(ids), 0) == START, F.lit(False))).over(w),
    })
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(IGNORE), F.col("_mx") - F.size(ids)))
    labels = F.when(F.col("_all_start") & (F.col("_mx") > 0),
                    F.slice(padded, 2, F.greatest(F.col("_mx") - 1, F.lit(0)))).otherwise(padded)
    return out.withColumns({"labels": labels, "drop_start": F.col("_all_start")}).drop("_mx", "_all_start")


def ignore_to_pad(labels: str = "labels") -> F.Column:
    """L4: -100 -> pad id."""
    return F.transform(F.col(labels), lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x))


def decode(df: DataFrame, ids: str, vocab: DataFrame, key: str = "idx") -> DataFrame:
    """Ids -> text, special ids skipped, order kept."""
    ex = df.select(key, F.posexplode(ids).alias("pos", "id")).where(F.col("id") >= FIRST_WORD_ID)
    j = ex.join(vocab, "id", "left")
    txt = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
    txt = txt.select(key, F.array_join(F.transform("_w", lambda s: s["word"]), " ").alias("text"))
    return df.select(key).join(txt, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
