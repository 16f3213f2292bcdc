"""User-function surface (U1-U4): batched prediction with a user model, row
maps, on-read transform hooks and skew-safe per-group user metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from inspect import Parameter, Signature

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalframe.sources.remote import read_text


def predict_batches(df: DataFrame, make_predict: Callable[[], Callable[[pd.Series], pd.Series]],
                    col: str, out: str = "prediction", batch_size: int = 8) -> DataFrame:
    """Apply a user model in fixed-size Arrow batches. ``make_predict`` runs
    once per Python worker (load weights there); it returns ``fn(batch) ->
    predictions``. A scalar result per batch is wrapped to one per row."""
    state: dict = {}

    @F.pandas_udf(T.StringType())
    def predict(s: pd.Series) -> pd.Series:
        fn = state.get("fn")
        if fn is None:
            fn = state["fn"] = make_predict()
        parts = []
        for i in range(0, len(s), batch_size):
            chunk = s.iloc[i:i + batch_size]
            res = fn(chunk)
            if isinstance(res, str):
                res = [res]
            parts.append(pd.Series(list(res), index=chunk.index, dtype="object"))
        return pd.concat(parts) if parts else pd.Series([], dtype="object")

    return df.withColumn(out, predict(F.col(col)))


def map_rows(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user transformation attached lazily (runs when the plan runs)."""
    return df.transform(fn)


def group_metric(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], dict[str, float]],
                 fields: list[str]) -> DataFrame:
    """U4: user metric per group without sending a group to one task: the user
    function returns additive partial sums for any batch of a group's rows; Spark
    adds them up per group (so a hot group is combined across tasks)."""
    schema = T.StructType([*[df.schema[k] for k in keys],
                           *[T.StructField(f, T.DoubleType()) for f in fields]])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for gk, g in pdf.groupby(keys, sort=False):
                gk = gk if isinstance(gk, tuple) else (gk,)
                vals = partial(g)
                rows.append([*gk, *[float(vals[f]) for f in fields]])
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    parts = df.mapInPandas(run, schema)
    return parts.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in fields])


@dataclass
class Metric:
    """A user metric as mergeable states. ``state`` makes one from some rows of a group, ``merge`` joins
    two, ``value`` turns one into the result. All must not depend on how the rows are cut or ordered."""

    state: Callable[[pd.DataFrame], bytes]
    merge: Callable[[bytes, bytes], bytes]
    value: Callable[[bytes], float | None]


def group_metrics(df: DataFrame, keys: list[str], metric: Metric, name: str = "metric", salts: int = 32) -> DataFrame:
    """U4 for metrics that are not sums: (keys, name), a row per group, null keys being a group.

    Tasks make a state per batch and group where the rows lie; only states are shuffled. A group's
    states are merged in a tree, first under (group, salt), then under the group, one after the other as
    they stream in, so a hot group is neither read nor merged by one task and a task holds one state
    a group. A group's last task merges at most ``salts`` states."""
    kinds = [df.schema[k] for k in keys]
    states = T.StructType([*kinds, T.StructField("_salt", T.IntegerType()), T.StructField("_state", T.BinaryType())])
    done = T.StructType([*kinds, T.StructField(name, T.DoubleType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            at = pa.array(range(t.num_rows), pa.int64())
            groups = t.select(keys).append_column("_row", at).group_by(keys).aggregate([("_row", "list")])
            made, n = [], n + 1
            for r in groups.column("_row_list").to_pylist():
                made.append(metric.state(t.take(pa.array(r)).to_pandas()))
            if made:
                salt = pa.array([n % salts] * len(made), pa.int32())
                yield pa.RecordBatch.from_arrays([*[groups.column(k).combine_chunks() for k in keys], salt, pa.array(made, pa.binary())],
                                                 [*keys, "_salt", "_state"])

    def merged(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch, bytes]:
        first, out = None, b""
        for batch in batches:
            for x in batch.column("_state").to_pylist():
                first, out = (batch.slice(0, 1), x) if first is None else (first, metric.merge(out, x))
        return first, out

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out = merged(batches)
        yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], first.column("_salt"), pa.array([out], pa.binary())],
                                         [*keys, "_salt", "_state"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out = merged(batches)
        yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], pa.array([metric.value(out)], pa.float64())], [*keys, name])

    parts = df.mapInArrow(make, states).groupBy(*keys, "_salt").applyInArrow(some, states)
    return parts.groupBy(*keys).applyInArrow(last, done)


def counted(column: str) -> tuple[Callable[[pd.DataFrame], bytes], Callable[[bytes, bytes], bytes]]:
    """``state`` and ``merge`` of a numeric column's exact value counts (nulls left out); the state is
    as long as the column has different values."""
    def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
        return values.astype("<f8").tobytes() + counts.astype("<i8").tobytes()

    def state(rows: pd.DataFrame) -> bytes:
        x = rows[column].to_numpy(float, na_value=np.nan)
        return pack(*np.unique(x[~np.isnan(x)], return_counts=True))

    def merge(a: bytes, b: bytes) -> bytes:
        (va, ca), (vb, cb) = unpack_counts(a), unpack_counts(b)
        values, at = np.unique(np.concatenate((va, vb)), return_inverse=True)
        return pack(values, np.bincount(at, np.concatenate((ca, cb)), len(values)).astype(np.int64))
    return state, merge


def unpack_counts(state: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(state) // 2
    return np.frombuffer(state[:half], "<f8"), np.frombuffer(state[half:], "<i8")


def median_of(column: str) -> Metric:
    """The exact median of a column; null for a group without values."""
    def value(state: bytes) -> float | None:
        values, counts = unpack_counts(state)
        if not len(values):
            return None
        ends = np.cumsum(counts)
        low, high = (values[np.searchsorted(ends, k, "right")] for k in ((ends[-1] - 1) // 2, ends[-1] // 2))
        return float((low + high) / 2)
    return Metric(*counted(column), value)


def distinct_of(column: str) -> Metric:
    """How many different values a column has."""
    return Metric(*counted(column), lambda state: float(len(state) // 16))


def predict_tensors(df: DataFrame, make_predict: Callable[[], Callable[..., dict[str, np.ndarray]]], inputs: dict[str, Column],
                    returns: T.DataType | str, shapes: dict[str, list[int]] | None = None, out: str = "prediction", batch_size: int = 64) -> DataFrame:
    """U1 with named tensors: ``make_predict`` runs once per Python worker (read weights there) and returns a
    function of the named input arrays (scalars [batch], arrays [batch, *shape]) that gives a dict of arrays, one
    per field of the struct type ``returns``, or one array for a plain type."""
    names = list(inputs)
    returns = T.DataType.fromDDL(returns) if isinstance(returns, str) else returns
    model = predict_batch_udf(lambda: _positional(make_predict(), names), return_type=returns, batch_size=batch_size,
                              input_tensor_shapes=[(shapes or {}).get(n) for n in names])
    return df.withColumn(out, model(*inputs.values()))


def _positional(fn: Callable[..., dict[str, np.ndarray]], names: list[str]) -> Callable[..., dict[str, np.ndarray]]:
    def predict(*arrays: np.ndarray) -> dict[str, np.ndarray]:
        return fn(**dict(zip(names, arrays)))
    # the batching helper asks for as many parameters as there are inputs
    predict.__signature__ = Signature([Parameter(n, Parameter.POSITIONAL_ONLY) for n in names])
    return predict


def linear_classes(uri: str) -> Callable[[], Callable[..., dict[str, np.ndarray]]]:
    """A user model for tests and examples: a row of weights per class in a file; the class of the highest
    dot product with the input ``x`` (the first one on ties) and that product."""
    def make() -> Callable[..., dict[str, np.ndarray]]:
        held = json.loads(read_text(uri))
        classes, weights = np.array(held["classes"]), np.array(held["weights"], float)

        def predict(x: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
            scores = np.asarray(x, float) @ weights.T
            best = scores.argmax(axis=1)
            return {"label": classes[best].astype(np.int32), "score": scores[np.arange(len(best)), best] + offset}
        return predict
    return make


def toy_model() -> Callable[[pd.Series], pd.Series]:
    """A stand-in user model for tests: 'recognises' a feature matrix as the
    index of its loudest channel per frame, spelled with letters."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def fn(batch: pd.Series) -> pd.Series:
        out = []
        for m in batch:
            a = np.asarray([np.asarray(r, np.float32) for r in m])
            out.append("".join(letters[np.argmax(a, axis=0) % 26]) if a.size else "")
        return pd.Series(out)
    return fn
