"""Edit distances (A1, A2).

Short pairs stay on the JVM: word sequences are turned into short strings by
giving every distinct word of a pair one BMP code point (a per-pair
dictionary), then Spark's built-in ``levenshtein`` (which counts code points)
does the work. Long pairs -- where the O(n*m) built-in becomes a straggler --
go to one Arrow UDF running the bit-parallel Levenshtein recurrence (Myers 1999,
Hyyrö 2001): O(n * ceil(m/64)) machine-word operations per pair, vectorised over
the pairs of a few Arrow batches (:mod:`vocalframe.functions.bitparallel`). Only long
pairs send data to Python; other rows send nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalframe.functions.bitparallel import levenshtein_bits, levenshtein_many  # noqa: F401

# Code points 0x0100 .. 0xD7FF are usable: 55,040 distinct words per pair.
CODE_BASE = 0x100
MAX_DICT = 0xD800 - CODE_BASE
# Pairs whose character DP table exceeds this many cells go to the Arrow job.
LONG_PAIR_CELLS = 2_000
# Arrow batches are gathered up to about this many characters; a row counts as some.
GATHER_CHARS, ROW_CHARS = 12_000_000, 64


def pair_dictionary(ref_words: Column, hyp_words: Column) -> Column:
    return F.array_distinct(F.concat(ref_words, hyp_words))


def encode_words(ws: Column, dictionary: Column) -> Column:
    """Each word -> one UTF-16 code unit (its dictionary position), joined."""
    hexed = F.transform(
        ws, lambda w: F.lpad(F.hex(F.array_position(dictionary, w) + (CODE_BASE - 1)), 4, "0"))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-16BE")


def word_edit_distance(ref_words: Column, hyp_words: Column, d: Column | None = None) -> Column:
    """Levenshtein distance between two word arrays (S + D + I).

    Pass ``d`` (the pair dictionary) as a materialised column when available."""
    d = pair_dictionary(ref_words, hyp_words) if d is None else d
    return F.levenshtein(encode_words(ref_words, d), encode_words(hyp_words, d))


def char_edit_distance(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp)


def _numbered_words(texts: list[str]) -> list[np.ndarray]:
    """The words of space-joined token strings as numbers, equal words alike."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    number = pc.dictionary_encode(words.values).indices.to_numpy().astype(np.int64)
    at = words.offsets.to_numpy()
    return [number[at[i]:at[i + 1]] if t else number[:0] for i, t in enumerate(texts)]


def _long_pairs(rs: pd.Series, hs: pd.Series) -> pd.DataFrame:
    """Word and character distances of space-joined token strings for the rows
    that carry them (others are null); all of them are scored at once by
    the batched bit-parallel kernel. Words are re-split here, so only two
    strings per row cross the Arrow boundary."""
    live = [i for i, c in enumerate(rs) if c is not None]
    we = pd.array([None] * len(rs), dtype="Int64")
    ce = pd.array([None] * len(rs), dtype="Int64")
    if live:
        refs, hyps = rs.tolist(), hs.tolist()
        a = [refs[i] for i in live]
        b = [hyps[i] if hyps[i] is not None else "" for i in live]
        words = _numbered_words(a + b)
        apart = levenshtein_many(words[:len(a)], words[len(a):])
        we[live] = apart
        # an edited word costs about its letters and a space; some more, as a low guess costs a second run
        size = [max(len(x), len(y)) for x, y in zip(a, b)]
        count = [max(len(x), len(y), 1) for x, y in zip(words[:len(a)], words[len(a):])]
        ce[live] = levenshtein_many(a, b, apart * (np.array(size) + 1) * 5 // (4 * np.array(count)) + 8)
    return pd.DataFrame({"word_errors": we, "char_errors": ce})


@F.pandas_udf(T.StructType([T.StructField("word_errors", T.LongType()), T.StructField("char_errors", T.LongType())]))
def long_pair_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``_long_pairs`` of a few Arrow batches at a time: the kernel's steps cost about the same for more pairs."""
    held, size = [], 0
    for rs, hs in batches:
        held.append((rs, hs))
        size += ROW_CHARS * len(rs) + sum(len(t) for side in (rs, hs) for t in side if t is not None)
        if size >= GATHER_CHARS:
            yield _long_pairs(*(pd.concat(side, ignore_index=True) for side in zip(*held)))
            held, size = [], 0
    if held:
        yield _long_pairs(*(pd.concat(side, ignore_index=True) for side in zip(*held)))
