"""One ordered document from a distributed table.

``ordered_document`` is a Spark data source for writing: tasks write each run of rows
whose places follow each other as a fragment beside the target, and the commit strings
the fragments together, by their first places, into one file that replaces the target.
Rows that already lie in order and know their place (``number_rows``) are not shuffled
for it. No row, task or driver holds the document: rows are written as they come, and
the commit copies a few MB at a time. Fragments of failed attempts are never part of the
document, and an aborted job leaves the old document as it was. Lines of the document are
records, so it can be read back in splits (``read_document``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from vocalframe.operators.numbering import number_rows
from vocalframe.sources.remote import open_fs

COPY_BYTES = 4 << 20


@dataclass
class Fragments(WriterCommitMessage):
    made: list[tuple[int, str]]         # first place, uri


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target = options["path"].rstrip("/")
        self.head, self.foot, self.between = (options.get(k, "") for k in ("head", "foot", "between"))
        self.overwrite = overwrite
        self.folder = f"{self.target}.fragments-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragments:
        made, out, following = [], None, None
        between = self.between.encode()
        for batch in iterator:
            values, places = batch.column(0), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places) != 1) + 1).tolist(), len(places)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if out is not None and places[start] != following:
                    out.close()
                    out = None
                following = places[stop - 1] + 1
                texts = [t.encode() for t in values.slice(start, stop - start).to_pylist() if t is not None]
                if texts and out is None:
                    uri = f"{self.folder}/{uuid.uuid4().hex}"
                    f, path = open_fs(uri)
                    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = f.open_output_stream(path, compression=None)
                    made.append((int(places[start]), uri))
                elif texts:
                    out.write(between)
                if texts:
                    out.write(between.join(texts))
        if out is not None:
            out.close()
        return Fragments(made)

    def commit(self, messages: list[Fragments | None]) -> None:
        f, path = open_fs(self.target)
        if not self.overwrite and f.get_file_info(path).type.name != "NotFound":
            self.abort(messages)
            raise ValueError(f"document exists: {self.target}")
        parts = sorted(part for m in messages if m for part in m.made)
        f.create_dir(path.rsplit("/", 1)[0], recursive=True)
        made = f"{path}.{uuid.uuid4().hex}.tmp"
        with f.open_output_stream(made, compression=None) as out:
            out.write(self.head.encode())
            for i, (_, uri) in enumerate(parts):
                out.write(self.between.encode() if i else b"")
                fragment = open_fs(uri)[1]
                with f.open_input_stream(fragment, compression=None) as src:
                    while piece := src.read(COPY_BYTES):
                        out.write(piece)
                f.delete_file(fragment)         # the rows are never on disk three times
            out.write(self.foot.encode())
        f.move(made, path)
        self.abort(messages)

    def abort(self, messages: list[Fragments | None]) -> None:
        f, path = open_fs(self.folder)
        if f.get_file_info(path).type.name != "NotFound":
            f.delete_dir(path)


class DocumentSink(DataSource):
    """``df.write.format("ordered_document").save(path)``: the first column, a string, row by row in the
    order of the second, the row's place; rows whose places follow each other go on in one fragment."""

    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def schema(self) -> str:
        return "value string, place bigint"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def write_document(df: DataFrame, value: Column, order: Sequence[str], path: str, head: str = "", foot: str = "",
                   between: str = "\n", overwrite: bool = True, position: str | None = None) -> None:
    """Write ``value`` of every row, in ``order`` (null values go), as one file. ``position`` names a
    column of distinct places that the rows already lie by, as ``number_rows`` gives it: it replaces
    ``order``, and nothing is shuffled."""
    spark = df.sparkSession
    spark.dataSource.register(DocumentSink)
    text = value.cast("string").alias("value")
    if position is not None:
        rows = df.select(text, F.col(position).cast("bigint").alias("place"))
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.select(text, *[F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)])
        keys = [f"_order_{i}" for i in range(len(order))]
        rows = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("value", F.monotonically_increasing_id().alias("place"))
    rows.write.format("ordered_document").options(head=head, foot=foot, between=between).mode("overwrite" if overwrite else "append").save(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a document whose lines are JSON objects, between brackets and commas or not."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{") & ~F.trim("value").endswith("["))
    return lines.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), schema).alias("r")).select("r.*")


def _record(**fields: str) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


#: Shapes of prediction files: head, foot, between, and what a record holds (field -> column); fixed values.
SHAPES = {
    "array": ("[\n", "\n]\n", ",\n", {"audio_path": "audio_path", "prediction": "prediction"}),
    "lines": ("", "\n", "\n", {c: c for c in ("speaker", "transcription", "prediction", "pred_normalized", "trans_normalized")}),
    "samples": ('{"samples": [\n', "\n]}\n", ",\n", {"prediction": "prediction", "reference": "reference"}),
    "indexed": ("", "\n", "\n", {c: c for c in ("idx", "prediction", "reference", "normalized_prediction", "normalized_reference")}),
}


def write_predictions(df: DataFrame, path: str, shape: str, order: str = "idx", position: str | None = None) -> None:
    """Predictions as one document in ``order``: an ``array`` of paths and predictions, JSON ``lines``
    with raw and normalised texts, an object of ``samples``, or ``indexed`` JSON lines, whose ``idx`` is the
    row's position. ``position`` names the rows' positions where ``number_rows`` has given them, so that several
    documents of one table need neither a table nor a shuffle each. A missing column raises; an empty table gives
    an empty array, object or file."""
    if shape not in SHAPES:
        raise ValueError(f"unknown prediction shape {shape!r}; expected one of {sorted(SHAPES)}")
    head, foot, between, fields = SHAPES[shape]
    if missing := [c for c in fields.values() if c != "idx" and c not in df.columns]:
        raise ValueError(f"shape {shape!r} needs the columns {missing}")
    if shape == "indexed" and position is not None:
        df = df.withColumn("idx", F.col(position))
    elif shape == "indexed":
        # numbering writes its rows: only what the records hold
        held = df.select(F.col(order).alias("_given"), *[c for c in fields.values() if c != "idx"])
        df = number_rows(held, ["_given"], "idx")
        order = "_given"
    write_document(df, _record(**fields), [order], path, head, foot if shape in ("array", "samples") else "", between, position=position)
