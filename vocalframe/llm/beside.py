"""Facts about single rows of a table, brought back to the tasks that scan the table.

A result that is computed from narrow rows (which documents stay, which words of a
document are taken) must meet the texts again. A join would shuffle the texts or
broadcast the facts; both grow with the corpus. Instead a row is named by its Parquet
file and its place in it, the facts are written in that order, and a task that scans
part of a file reads the chunks about the same rows. Texts stay where they are.

The driver holds a line per chunk of ``CHUNK`` facts; a task holds the chunks under
one batch of its rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.files import open_fs
from vocalframe.llm.store import keep, shared_folder

CHUNK = 1 << 16


def positioned(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` as a table of Parquet files, and the columns file (a hash of its path) and row of
    each of its rows. A table that is not read straight from Parquet is written once."""
    def place(df: DataFrame) -> tuple[Column, Column]:
        meta = df.metadataColumn("_metadata")
        return F.xxhash64(meta["file_path"]), meta["row_index"]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            file, row = place(docs)
            docs.select(file, row).schema
            return docs, file, row
        except AnalysisException:       # files of another kind have no row numbers
            pass
    docs = keep(docs)
    return (docs, *place(docs))


class Beside:
    """Facts by (file, row); made by :func:`write`."""

    def __init__(self, chunks: list[tuple[int, int, str, int]]):
        self.chunks = sorted(chunks)                            # (first file, first row, uri, row group)
        self.first = [c[:2] for c in self.chunks]
        self._held: dict[int, pa.Table] = {}

    def __getstate__(self):
        return {"chunks": self.chunks, "first": self.first, "_held": {}}

    def _chunk(self, k: int) -> pa.Table:
        if k not in self._held:
            filesystem, path = open_fs(self.chunks[k][2])
            with filesystem.open_input_file(path) as f:
                self._held[k] = pq.ParquetFile(f).read_row_group(self.chunks[k][3])
        return self._held[k]

    def find(self, file: np.ndarray, row: np.ndarray) -> tuple[pa.Table | None, np.ndarray]:
        """(facts, place of each row's fact in them or -1)."""
        out, parts, base, used = np.full(len(row), -1, np.int64), [], 0, set()
        for f in np.unique(file).tolist():
            at = np.flatnonzero(file == f)
            lo = max(bisect_right(self.first, (f, int(row[at].min()))) - 1, 0)
            for k in range(lo, bisect_right(self.first, (f, int(row[at].max())))):
                t = self._chunk(k)
                used.add(k)
                files, rows = t.column(0).to_numpy(), t.column(1).to_numpy()
                a, b = np.searchsorted(files, f, "left"), np.searchsorted(files, f, "right")
                if a < b:
                    i = a + np.searchsorted(rows[a:b], row[at])
                    i = np.minimum(i, b - 1)
                    hit = rows[i] == row[at]
                    out[at[hit]] = base + i[hit]
                parts.append(t)
                base += t.num_rows
        self._held = {k: self._held[k] for k in used}           # those of the next batch are mostly the same
        return (pa.concat_tables(parts) if parts else None), out


def write(facts: DataFrame) -> Beside:
    """Store ``facts``, whose first two columns are file and row, at most one per row of a table."""
    folder = shared_folder(facts.sparkSession)
    file, row = facts.columns[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, stream, held, n, made = f"{folder}/{uuid.uuid4().hex}.parquet", None, None, [], 0, []

        def flush() -> None:
            t = pa.Table.from_batches(held)
            made.append((t.column(0)[0].as_py(), t.column(1)[0].as_py(), uri, len(made)))
            out.write_table(t, row_group_size=max(1, t.num_rows))
            held.clear()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                filesystem, path = open_fs(uri)
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = filesystem.open_output_stream(path, compression=None)
                out = pq.ParquetWriter(stream, batch.schema)
            for i in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(i, CHUNK))
                n += held[-1].num_rows
                if n >= CHUNK:
                    flush()
                    n = 0
        if held:
            flush()
        if out is not None:
            out.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["file", "row", "uri", "part"])

    dealt = facts.repartitionByRange(file, row).sortWithinPartitions(file, row)
    got = dealt.mapInArrow(run, "file bigint, row bigint, uri string, part int").collect()      # a line per chunk
    return Beside([tuple(r) for r in got])


def absent(places: Beside, file: Column, row: Column) -> Column:
    """Whether a row has no fact."""
    held = places

    @F.arrow_udf("boolean")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for f, r in columns:
            yield pa.array(held.find(f.to_numpy(), r.to_numpy())[1] < 0)

    return run(file, row)
