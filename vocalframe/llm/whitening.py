"""Whitening of embeddings (operator 13).

Vectors become integers, floor(scale * entry) + shift, and every sum over the rows is
exact: sums per dimension first, then products of the rows centred at the rounded
mean, as whole numbers that stay below 2^53 inside a task and are added as decimals.
The covariance follows by one exact division, so it depends neither on the order of
the rows nor on how they are dealt, and a large common offset costs no digits.

The covariance (dimensions x dimensions, never rows) is reduced to tridiagonal form by
Householder reflections; the leading eigenvalues are found by bisection on Sturm
counts, all at once, and their vectors by inverse iteration with reorthogonalisation
inside clusters of close eigenvalues. The components are broadcast and tasks project
the rows where they lie; no vector is shuffled.

Nulls and odd input: a row whose vector is null, or holds a null or an entry that is
not finite, is dropped; so are vectors of another length than the commonest one (the
longest of equally common ones). Entries beyond 2^40 count as 2^40. A null id is kept,
and repeated rows count each. Directions in which the vectors do not vary (eigenvalue
below 1e-12 of the largest) are no components, so equal vectors, a single vector or an
empty table give no rows. Other columns are ignored, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.store import spread

#: Entries are clipped here, so that products of integers stay inside a decimal.
LIMIT = float(1 << 40)
EXACT = float(1 << 53)
#: Rows of a block product, and of an output batch.
ROWS = 2048


# eigenvectors of a symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, off-diagonal, unit reflection vectors) of the Householder reduction of ``a``."""
    a, vectors = np.array(a, float), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        scale = np.abs(v).max()
        if scale == 0 or not np.abs(v[1:]).any():              # already in form
            vectors.append(None)
            continue
        norm = scale * np.linalg.norm(v / scale)
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k + 1, k] - 2 * v[0] * (v @ a[k + 1:, k])
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    least = max(np.finfo(float).tiny * 1e20, np.finfo(float).eps ** 2 * float((e * e).max(initial=0)))
    q, n = d[0] - at, np.zeros(len(at), np.int64)
    for i in range(len(d)):
        if i:
            q = d[i] - at - e[i - 1] * e[i - 1] / q
        q = np.where(np.abs(q) < least, -least, q)              # a zero pivot counts as negative
        n += q < 0
    return n


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` largest eigenvalues, falling, by bisection to double precision."""
    reach = np.abs(np.concatenate(([0], e))) + np.abs(np.concatenate((e, [0])))
    low, high = float((d - reach).min()), float((d + reach).max())
    slack = 4 * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    below = len(d) - 1 - np.arange(n)                          # eigenvalues under the wanted one
    lo, hi = np.full(n, low - slack), np.full(n, high + slack)
    while True:
        mid = lo + (hi - lo) / 2
        if np.all(hi - lo <= np.finfo(float).eps * np.maximum(np.abs(lo), np.abs(hi)) + slack * 1e-6):
            break
        under = sturm_counts(d, e, mid) <= below
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo + (hi - lo) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of (T - shift[j]) x = b[j], by elimination with row exchanges, all j at once."""
    n, m = len(d), len(shift)
    least = np.finfo(float).eps * (np.abs(d).max() + 2 * np.abs(e).max(initial=0)) + np.finfo(float).tiny
    pivot, one, two, b = np.empty((n, m)), np.zeros((n, m)), np.zeros((n, m)), b.T.copy()
    u, s = d[0] - shift, np.full(m, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        low, diag, after = e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0
        swap = np.abs(u) < abs(low)
        u = np.where(~swap & (np.abs(u) < least), least, u)
        pivot[i] = np.where(swap, low, u)
        one[i], two[i] = np.where(swap, diag, s), np.where(swap, after, 0.0)
        f = np.where(swap, u, low) / pivot[i]
        u = np.where(swap, s, diag) - f * one[i]
        s = np.where(swap, 0.0, after) - f * two[i]
        b[i], b[i + 1] = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        b[i + 1] -= f * b[i]
    pivot[n - 1] = np.where(np.abs(u) < least, least, u)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            b[i] -= one[i] * b[i + 1]
        if i + 2 < n:
            b[i] -= two[i] * b[i + 2]
        b[i] /= pivot[i]
        big = np.abs(b[i]) > 1e100                              # the direction matters, not the size
        if big.any():
            b[:, big] /= np.abs(b[i, big])
    return b.T


def leading_components(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as rows) of the ``n`` leading components of ``a``. A vector's
    entry of the largest size is positive."""
    d, e, reflections = tridiagonal(a)
    values = leading_eigenvalues(d, e, n)
    close = 1e-3 * (np.abs(d).max() + 2 * np.abs(e).max(initial=0))
    first = np.arange(n)                                        # the first one of each cluster
    for j in range(1, n):
        if values[j - 1] - values[j] <= close:
            first[j] = first[j - 1]
    y = np.random.default_rng(0).standard_normal((n, len(d)))
    for _ in range(5):
        y = solve_shifted(d, e, values, y / np.linalg.norm(y, axis=1, keepdims=True))
        for j in range(n):
            y[j] /= np.abs(y[j]).max()
            for _ in range(2):
                own = y[first[j]:j]
                y[j] -= (own @ y[j]) @ own
                y[j] /= np.linalg.norm(y[j])
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if v is not None:
            y[:, k + 1:] -= 2 * np.outer(y[:, k + 1:] @ v, v)
    y *= np.sign(y[np.arange(n), np.abs(y).argmax(axis=1)])[:, None]
    return values, y


# the rows

def whole(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(scale * np.clip(vectors, -LIMIT, LIMIT)).astype(np.int64) + shift


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector has finite entries only."""
    own = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return own.where(fine)


def table_sums(rows: DataFrame, per_task, kind: str = "bigint") -> dict[int, int]:
    """Sums over all rows of what ``per_task(batches)`` yields as (index, whole number) arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x in per_task(batches):
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "x": x})

    got = rows.mapInArrow(run, f"at int, x {kind}").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return {r["at"]: int(r["x"]) for r in got.collect()}        # dimensions, or pairs of dimensions


@dataclass
class Whitener:
    """A fitted transform; ``sums`` are exact, ``components`` are unit rows, ``values`` fall."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """The rounded mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def project(self, u: np.ndarray) -> np.ndarray:
        """Whitened rows of integer rows centred at ``middle``."""
        off = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.middle)])
        return (u - off) @ self.components.T / np.sqrt(self.values)


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64,
        shift: int = 1_000_000) -> Whitener | None:
    """The whitening transform of all usable rows; None if there are none."""
    own = usable(rows, vec_id, vector).select("v")
    common = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return None
    d, n = common[0]["d"], common[0]["count"]
    own = spread(own.where(F.size("v") == d))

    def add(batches):
        total = np.zeros(d, object)                             # whole numbers of any size
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                total += whole(matrix(batch.column(0).slice(i, ROWS)), scale, 0).sum(axis=0).astype(object)
        yield np.arange(d), pa.array([int(x) for x in total], pa.decimal128(38, 0))

    got = table_sums(own, add, "decimal(38,0)")
    out = Whitener(n, [got[i] + n * shift for i in range(d)], np.zeros(0), np.zeros((0, d)), 0.0, scale, shift)
    middle = out.middle
    upper = np.triu_indices(d)

    def products(batches):
        total, bound = np.zeros((d, d)), 0.0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                u = (whole(matrix(batch.column(0).slice(i, ROWS)), scale, shift) - middle).astype(float)
                most = float(np.abs(u).max()) ** 2
                step = max(1, min(len(u), int(EXACT / max(most, 1.0)) - 1))
                for k in range(0, len(u), step):
                    more = most * len(u[k:k + step])
                    if bound + more >= EXACT:                   # hand on what is exact so far
                        yield np.arange(len(upper[0])), total[upper]
                        total, bound = np.zeros((d, d)), 0.0
                    total += u[k:k + step].T @ u[k:k + step]
                    bound += more
        if bound:
            yield np.arange(len(upper[0])), total[upper]

    got = table_sums(own, products, "double")
    u = [s - n * int(m) for s, m in zip(out.sums, middle)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*upper)):
        v[i, j] = v[j, i] = (n * got.get(k, 0) - u[i] * u[j]) / (n * n)     # whole numbers until this division
    out.trace = float(np.trace(v))
    if out.trace <= 0:
        return out
    values, vectors = leading_components(v, min(components, d))
    real = values > 1e-12 * values[0]
    out.values, out.components = values[real], vectors[real]
    out.identity_error = identity_error(own, out)
    return out


def identity_error(own: DataFrame, w: Whitener) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from all rows."""
    c, middle = len(w.values), w.middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, c))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                p = w.project(whole(matrix(batch.column(0).slice(i, ROWS)), w.scale, w.shift) - middle)
                total += p.T @ p                                # the projected rows are centred
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(c * c), pa.int32()), "x": total.reshape(-1)})

    got = own.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    cov = np.zeros(c * c)
    for r in got:
        cov[r["at"]] = r["x"] / w.n
    return float(np.abs(cov.reshape(c, c) - np.eye(c)).max())


def deviations(u: np.ndarray, w: Whitener) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; null where it passes 64 bits."""
    off = [s - w.n * int(m) for s, m in zip(w.sums, w.middle)]
    rough = ((w.n * u.astype(float) - np.array(off, float)) ** 2).sum(axis=1)
    if rough.max(initial=0) < 9e18:
        return ((w.n * u - np.array(off, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((w.n * x - o) ** 2 for x, o in zip(row, off)) for row in u.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(rows: DataFrame, w: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error."""
    spark, kind = rows.sparkSession, dict(rows.select(F.col(vec_id).alias("id")).dtypes)["id"]
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if w is None or not len(w.values):
        return spark.createDataFrame([], schema)
    c, middle = len(w.values), w.middle
    own = spread(usable(rows, vec_id, vector).where(F.size("v") == len(w.sums)))
    fitted = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fitted.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                u = whole(matrix(some.column(1)), w.scale, w.shift) - middle
                p, rep = w.project(u), np.repeat(np.arange(len(u)), c)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": some.column(0).take(pa.array(rep)), "component": pa.array(np.tile(np.arange(1, c + 1), len(u)), pa.int32()),
                    "n": np.full(len(rep), w.n), "deviation": pa.array(deviations(u, w), pa.int64()).take(pa.array(rep)),
                    "whitened": p.reshape(-1), "explained": np.tile(w.values / w.trace, len(u)),
                    "identity_error": np.full(len(rep), w.identity_error)})

    return own.mapInArrow(run, schema)
