"""Text quality by a factorisation machine (operator 6).

A text becomes a sparse vector: its distinct words hashed to ``WORD_BINS`` bins
(square roots of counts, length one together), and one active bucket for each of a
fixed list of structure statistics and for the metadata field n_chars. The machine
adds a bias, a linear weight per feature and all pairwise interactions through
rank-``K`` factors, scored in linear time by
    sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2.

Training takes at most ``max_rows`` labelled rows, the first by a hash of their id
(the bound is a parameter; whole texts are read), and runs on the driver; scoring
runs over all documents in tasks, without a shuffle. Labels, language, source and
id are never features.

Nulls and odd input: a null or empty text has the buckets of zero words and is
scored like any other; a null n_chars has a bucket of its own; labels that are null
teach nothing; without labels of both kinds the score is the labels' mean (0.5
without labels); repeated rows get equal scores. Columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.store import free_name, spread
from vocalframe.llm.tokens import slices, words_of

WORD_BINS = 1 << 15
BUCKETS = 16
K = 6
#: Structure statistics, each cut at these fixed edges.
SHARES = (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)
STATISTICS: dict[str, tuple[float, ...]] = {
    "words": (1, 3, 8, 20, 40, 80, 150, 300, 600, 1200, 2500, 5000, 10000, 20000),
    "word_length": (1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12),
    "upper": SHARES, "digits": SHARES, "symbols": SHARES, "stops": SHARES, "blanks": SHARES, "lines": SHARES,
    "non_ascii": SHARES, "distinct": SHARES, "top_word": SHARES, "echo": SHARES, "distinct_triples": SHARES,
    "n_chars": (1, 20, 60, 150, 300, 600, 1000, 2000, 4000, 8000, 16000, 32000, 64000, 128000),
}
SIZE = WORD_BINS + BUCKETS * len(STATISTICS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,?;:'-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,?;:"]] = True


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return (sums[off[1:]] - sums[off[:-1]]).astype(np.float64)


def _runs(keys: np.ndarray, shift: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys (document above ``shift`` bits): distinct keys, their counts, and per
    document the number of distinct keys and the largest count."""
    uniq, n = np.unique(keys, return_counts=True)
    doc = (uniq >> np.uint64(shift)).astype(np.int64)
    kinds = np.bincount(doc, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, doc, n)
    return uniq, n, kinds, top


def features(text: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) entries, sorted by document. ``n_chars`` is NaN where null."""
    w = words_of(text)
    docs = len(w.ptr) - 1
    n = np.diff(w.ptr).astype(np.float64)
    size = np.diff(w.off).astype(np.float64)
    one = np.maximum(size, 1)
    doc = w.doc.astype(np.uint64)
    keys = (doc << np.uint64(40)) | (w.hashes >> np.uint64(24))
    uniq, counts, kinds, top = _runs(keys, 40, docs)
    same_doc = doc[1:] == doc[:-1]
    echo = np.bincount(doc[1:][same_doc & (w.hashes[1:] == w.hashes[:-1])].astype(np.int64), minlength=docs)
    h = w.hashes
    triple = h[:-2] + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(h) > 2 else h[:0]
    inside = doc[2:] == doc[:-2]
    triples = _runs((doc[2:][inside] << np.uint64(40)) | (triple[inside] >> np.uint64(24)), 40, docs)[2]
    many = np.maximum(n, 1)
    stats = {
        "words": n, "word_length": np.add.reduceat(np.append(w.ends - w.starts, 0), np.minimum(w.ptr[:-1], len(w.starts))) * (n > 0) / many if docs else n,
        "upper": _per_doc((w.raw >= 65) & (w.raw <= 90), w.off) / one, "digits": _per_doc((w.raw >= 48) & (w.raw <= 57), w.off) / one,
        "symbols": _per_doc(_SYMBOL[w.raw], w.off) / one, "stops": _per_doc(_STOP[w.raw], w.off) / one,
        "blanks": _per_doc(w.raw <= 32, w.off) / one, "lines": _per_doc(w.raw == 10, w.off) / many,
        "non_ascii": _per_doc(w.raw >= 128, w.off) / one, "distinct": kinds / many, "top_word": top / many,
        "echo": echo / many, "distinct_triples": triples / np.maximum(n - 2, 1), "n_chars": n_chars,
    }
    parts_doc, parts_at, parts_value = [(uniq >> np.uint64(40)).astype(np.int64)], [], []
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(parts_doc[0], counts, docs))
    parts_at.append((uniq & np.uint64(WORD_BINS - 1)).astype(np.int64))
    parts_value.append(value / np.maximum(norm[parts_doc[0]], 1))
    for k, (name, edges) in enumerate(STATISTICS.items()):
        x = stats[name]
        bucket = np.where(np.isnan(x), BUCKETS - 1, np.searchsorted(edges, np.nan_to_num(x), "right"))
        parts_doc.append(np.arange(docs))
        parts_at.append(WORD_BINS + BUCKETS * k + bucket)
        parts_value.append(np.ones(docs))
    d, at, v = np.concatenate(parts_doc), np.concatenate(parts_at), np.concatenate(parts_value)
    order = np.argsort(d, kind="stable")
    return d[order], at[order], v[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray       # [SIZE, K]

    def logits(self, doc: np.ndarray, at: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Linear in the number of entries, by the sum-of-squares identity."""
        if not docs:
            return np.zeros(0)
        starts = np.searchsorted(doc, np.arange(docs))      # every document has entries
        first = np.add.reduceat(self.linear[at] * value, starts)
        vx = self.factors[at] * value[:, None]
        both = np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + first + 0.5 * both.sum(1)

    def gradients(self, doc, at, value, docs, error):
        """Gradients of the mean log loss, given ``error`` = probability - label per document."""
        starts = np.searchsorted(doc, np.arange(docs))
        vx = self.factors[at] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        e = (error / docs)[doc] * value
        g = (sums[doc] - vx) * e[:, None]
        uniq, inv = np.unique(at, return_inverse=True)
        return uniq, np.bincount(inv, e, len(uniq)), np.stack([np.bincount(inv, g[:, f], len(uniq)) for f in range(g.shape[1])], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train_machine(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 128, rate: float = 0.08,
                  l2: float = 1e-5, seed: int = 17) -> Machine:
    """Adagrad on the log loss; ``rows`` are (label, features, values)."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], np.float64)
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or mean in (0.0, 1.0):
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(p / (1 - p))), np.zeros(SIZE), np.zeros((SIZE, K)))
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, K)))
    hist_bias, hist_linear, hist_factors = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, K), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = [rows[j] for j in order[i:i + batch]]
            doc = np.repeat(np.arange(len(some)), [len(r[1]) for r in some])
            at, value = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
            error = sigmoid(m.logits(doc, at, value, len(some))) - y[order[i:i + batch]]
            uniq, gl, gf = m.gradients(doc, at, value, len(some), error)
            gl, gf = gl + l2 * m.linear[uniq], gf + l2 * m.factors[uniq]
            hist_linear[uniq] += gl ** 2
            hist_factors[uniq] += gf ** 2
            hist_bias += error.mean() ** 2
            m.linear[uniq] -= rate * gl / np.sqrt(hist_linear[uniq])
            m.factors[uniq] -= rate * gf / np.sqrt(hist_factors[uniq])
            m.bias -= rate * error.mean() / np.sqrt(hist_bias)
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
        label: str = "quality", max_rows: int = 8000) -> Machine:
    """Fit on at most ``max_rows`` labelled rows (the first in a hash order of the id). The
    chosen ids are at most that many, so they are broadcast to the documents."""
    chosen = (labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
              .withColumn("_o", F.xxhash64("_id", F.lit(3))).orderBy("_o", "_id", "_label").limit(max_rows).drop("_o"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(n_chars).cast("double").alias("_n"))
    rows = rows.join(F.broadcast(chosen), "_id").select("_label", "_n", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                doc, at, value = features(some.column(2), _floats(some.column(1)))
                cuts = np.searchsorted(doc, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_pydict({
                    "label": some.column(0).cast(pa.int32()),
                    "at": pa.array([at[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    "value": pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    got = rows.mapInArrow(run, "label int, at binary, value binary").collect()      # at most max_rows
    got.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["value"])))
    return train_machine([(r["label"], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64))
                          for r in got])


def _floats(column: pa.Array) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in column.to_pylist()], np.float64)


def score(docs: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars", result: str = "score") -> DataFrame:
    """``docs`` (without the text) with the probability of label 1 in ``result``; a column of that name is replaced."""
    cast = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in docs.columns if c not in (text, result)]
    source = spread(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(n_chars).cast("double").alias(free_name(docs, "n")),
                                F.col(text).alias(free_name(docs, "words"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns
            for some in slices(batch, k - 1):
                doc, at, value = features(some.column(k - 1), _floats(some.column(k - 2)))
                p = sigmoid(cast.value.logits(doc, at, value, some.num_rows))
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], pa.array(p, pa.float64())], [*kept, result])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in source.dtypes[:-2]], f"`{result}` double"])
    return source.mapInArrow(run, schema)
