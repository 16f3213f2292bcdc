"""Target-distribution importance resampling by bit-sliced sums (operator 11).

Features are the runs of 1 to ``longest`` consecutive words of a text, repeats
counted; a feature's bucket is its CRC-32 modulo ``buckets``. A bucket's gain is the
logarithm of how much likelier the target texts hold it than the corpus, in
thousandths, an integer. A document's weight is the sum of the gains of its features.

The weights are exact integer sums over bit planes. Plane i of a document holds bit i
of every bucket's count, ``buckets`` bits wide; the gains are cut in planes likewise,
positive and negative ones apart. The weight is the sum over pairs of planes of
2^(i + j) * popcount(count plane i AND gain plane j), positive minus negative.

A CRC-32 of joined words follows from those of its words: the checksum of the first
part is carried over the second part's length (a linear map of 32 bits, applied by
table) and the second part's checksum is added. So each word is read once.

Scale: the texts are read twice where they lie and never shuffled. The first pass sends
at most ``buckets`` counters a task; the driver holds ``buckets`` gains. The draw deals
(document, score) rows by ranges of the score and numbers them by per-range offsets.
No draw comes from a sample: counts, weights and ranks are those of all rows.

Nulls and odd input: a null or wordless text has no features and weight 0, and is not
drawn while ``least_words`` is above 0; a null id draws as the empty string and comes
last among ties; repeated rows are scored alike and each counts; an empty corpus gives
no rows and an empty target the gains of its smoothing alone. Other columns are ignored,
so their names may clash with anything.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.llm.order import part_offsets, ranged
from vocalframe.llm.store import keep, spread
from vocalframe.llm.tokens import Words, slices, words_of

#: The reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Documents whose count planes are built together.
DOCS = 64


class Carry:
    """The map of a CRC-32 over n following bytes, for arrays of checksums and lengths.

    ``tables[d][k]`` is the map over k * 256^d bytes, as four tables of a byte each."""

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
        places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.tables = [self._powers((places >> 8) ^ byte[places & 0xFF])]

    @staticmethod
    def _map(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]

    def _powers(self, once: np.ndarray) -> np.ndarray:
        out = np.empty((256, 4, 256), np.uint32)
        out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for k in range(1, 256):
            out[k] = self._map(once, out[k - 1])
        return out

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        lengths, d = lengths.copy(), 0
        while True:
            digit = lengths & 0xFF
            t = self.tables[d].reshape(-1)                      # [digit][place][byte]
            base = digit * 1024
            crc = (t[base + (crc & 0xFF)] ^ t[base + 256 + ((crc >> 8) & 0xFF)]
                   ^ t[base + 512 + ((crc >> 16) & 0xFF)] ^ t[base + 768 + (crc >> 24)])
            lengths >>= 8
            if not lengths.any():
                return crc
            d += 1
            if d == len(self.tables):
                last = self.tables[-1]
                self.tables.append(self._powers(self._map(last[255], last[1])))


_carry: list[Carry] = []


def feature_buckets(w: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of the documents in ``w``."""
    if not _carry:
        _carry.append(Carry())
    carry = _carry[0]
    low = memoryview(np.ascontiguousarray(w.low))
    own = np.fromiter((zlib.crc32(low[a:b]) for a, b in zip(w.starts.tolist(), w.ends.tolist())), np.uint32, len(w.starts))
    doc = w.doc
    lengths = w.ends - w.starts
    blank = np.full(len(own), zlib.crc32(b" "), np.uint32)
    joined = carry(blank, lengths) ^ own if longest > 1 and len(own) else own   # a blank and the word
    docs, out, state, at = [doc], [own % np.uint32(buckets)], own, np.arange(len(own))
    for n in range(2, longest + 1):
        at = at[at + n - 1 < len(own)]
        at = at[doc[at] == doc[at + n - 1]]                     # first words of the runs of n words
        last = at + n - 1
        grown = np.zeros(len(own), np.uint32)
        grown[at] = carry(state[at], lengths[last] + 1) ^ joined[last]
        state = grown
        docs.append(doc[at])
        out.append(state[at] % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def bucket_totals(texts: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many features of all ``texts`` fall in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in slices(batch, 0):
                total += np.bincount(feature_buckets(words_of(some.column(0)), longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": total[at]})

    own = spread(texts.select(F.col(text).alias("text"))).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():        # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed shares)) of every bucket."""
    b, t_all, s_all = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of integers >= 0: [plane][row][64-bit word]."""
    wide = -(-values.shape[1] // 64) * 64
    out = np.zeros((int(values.max(initial=0)).bit_length(), len(values), wide // 8), np.uint8)
    for i in range(len(out)):
        bits = np.packbits(((values >> i) & 1).astype(np.uint8), axis=1)
        out[i, :, :bits.shape[1]] = bits
    return out.view(np.uint64)


class GainPlanes:
    """The gains as planes, positive and negative apart, and the weights of count rows."""

    def __init__(self, gain: np.ndarray):
        signed = [(sign, planes(np.maximum(sign * gain, 0)[None, :])[:, 0]) for sign in (1, -1)]
        self.bits = np.concatenate([p for _, p in signed])
        self.worth = np.concatenate([sign * (1 << np.arange(len(p), dtype=np.int64)) for sign, p in signed])

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Sum of count times gain over the buckets, for each row of ``counts``."""
        out = np.zeros(len(counts), np.int64)
        for i, plane in enumerate(planes(counts)):
            for bits, worth in zip(self.bits, self.worth.tolist()):
                out += np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64) * (worth << i)
        return out


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 3) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) per row; ``tie`` is a hash of the text."""
    buckets = len(gain)
    source = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = dict(source.dtypes)["doc_id"]
    rows = source.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = GainPlanes(gain)
        for batch in batches:
            for some in slices(batch, 2):
                w = words_of(some.column(2))
                doc, bucket = feature_buckets(w, longest, buckets)
                order = np.argsort(doc, kind="stable")
                doc, bucket = doc[order], bucket[order]
                cuts = np.searchsorted(doc, np.arange(some.num_rows + 1))
                weights = np.zeros(some.num_rows, np.int64)
                for a in range(0, some.num_rows, DOCS):
                    b = min(a + DOCS, some.num_rows)
                    x, y = cuts[a], cuts[b]
                    counts = np.bincount((doc[x:y] - a) * buckets + bucket[x:y], minlength=(b - a) * buckets)
                    weights[a:b] = sliced.weights(counts.reshape(b - a, buckets))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "tie": some.column(1), "n_words": np.diff(w.ptr),
                                                  "n_features": np.diff(cuts), "weight": weights})

    return rows.mapInArrow(run, f"doc_id {kind}, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str, seed: int):
    """floor of 1000 times a Gumbel draw that depends on the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             longest: int = 3, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight, score, rank) per row of ``docs``.

    ``rank`` numbers the floor(percent * N / 100) rows of the highest scores from 1, where N
    counts the rows of at least ``least_words`` words; it is null elsewhere. Ties go to the
    smaller id, then to the smaller hash of the text."""
    gain = gains(bucket_totals(target, target_text, longest, buckets), bucket_totals(docs, text, longest, buckets))
    scored = weigh(docs, gain, doc_id, text, longest)
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = keep(scored)
    able = scored.where(F.col("n_words") >= least_words)
    few = able.count() * percent // 100
    able = able.withColumns({"down": -F.col("score"), "absent": F.col("doc_id").isNull()})
    dealt = ranged(able, "down", "absent", "doc_id", "tie")
    within = F.row_number().over(Window.partitionBy("part").orderBy("down", "absent", "doc_id", "tie"))
    before = F.broadcast(part_offsets(dealt.withColumn("one", F.lit(1)), before="one"))        # one row a range
    numbered = dealt.withColumn("rank", within).join(before, "part").withColumn("rank", (F.col("rank") + F.col("before")))
    rank = F.when(F.col("rank") <= few, F.col("rank")).cast("bigint").alias("rank")
    return (numbered.select(*scored.columns, rank)
            .unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of rows that repeat an id
    and a text, as many as were drawn."""
    ranks = resample(docs, target, doc_id=doc_id, text=text, **options)
    ranks = keep(ranks.groupBy("doc_id", "tie").agg(F.count("rank").alias("drawn"), F.count(F.lit(1)).alias("rows")).where("drawn > 0"))
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    at = F.col(names[doc_id]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(names[text])) == F.col("tie"))
    out = own.join(ranks.where("drawn = rows"), at, "left_semi")
    for r in ranks.where("drawn < rows").collect():             # equal rows rank side by side: one group at most
        same = F.col(names[doc_id]).eqNullSafe(F.lit(r["doc_id"])) & (F.xxhash64(F.col(names[text])) == r["tie"])
        out = out.unionByName(own.where(same).limit(r["drawn"]))
    return out.select(*[F.col(v).alias(k) for k, v in names.items()])
