"""Best-fit decreasing packing of documents into sequences (operator 12).

A document's ids are cut into pieces of at most ``capacity`` tokens, the first one
taking the remainder, and pieces are packed by best-fit decreasing: longest first,
each into the open sequence with the least room that still fits it, found by a segment
tree over the remaining capacities in logarithmic time.

Only the number of pieces of each length decides that packing, and there are at most
``capacity`` lengths. So the whole corpus is packed at once, not shard by shard: tasks
tokenize and count lengths, the driver packs the counts (pieces of one length are
placed as runs: so many sequences with room r take q pieces each), and tasks look up
the place of the k-th piece of a length in the runs. The plan has some thousand runs,
bounded by the capacity: a sequence can meet at most about sqrt(2 * capacity) different
lengths, whatever the number of documents.

Scale: the texts are read once where they lie; no text or token is shuffled. Pieces
are written once as narrow rows, numbered within their task and length; the first
number of a task and length comes from prefix sums over the tasks. A frequent length
or source is spread over all tasks that read it.

Nulls and odd input: a null text is empty and still gets the end id; an empty table
gives no rows; repeated rows are packed each on its own; a null id is kept. Other
columns are ignored, so their names may clash with anything.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.llm.store import keep, spread
from vocalframe.llm.tokenfiles import encoder

PIECE = "doc_id {kind}, piece int, start bigint, length int, ids_crc32 bigint, part string, k bigint"


class Rooms:
    """Open sequences by remaining capacity; a segment tree says which capacities are in use."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.size)
        self.ranges: dict[int, deque[tuple[int, int]]] = defaultdict(deque)   # room -> (first sequence, how many)

    def put(self, room: int, first: int, n: int) -> None:
        self.ranges[room].append((first, n))
        at = room + self.size
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def take(self, room: int, most: int) -> tuple[int, int]:
        """At most ``most`` sequences with this room, as a range; they are no longer open."""
        first, n = self.ranges[room].popleft()
        if n > most:
            self.ranges[room].appendleft((first + most, n - most))
            n = most
        elif not self.ranges[room]:
            at = room + self.size
            self.used[at] = 0
            while at > 1 and not self.used[at ^ 1]:
                at >>= 1
                self.used[at] = 0
        return first, n

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` in use."""
        at = length + self.size
        if self.used[at]:
            return length
        while at > 1:                                          # up to the first tree with a used leaf to the right
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces, as runs (length, first piece, first
    sequence, pieces a sequence, room): piece ``first piece + i`` of that length goes to sequence
    ``first sequence + i // q`` behind ``capacity - room + (i % q) * length`` tokens."""
    rooms, made, out = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:                                   # open as many new ones as the rest needs
                room, n = capacity, -(-left // (capacity // length))
                rooms.put(room, made, n)
                made += n
            # a piece leaves less room, so the next equal one goes behind it while it fits
            q = min(room // length, left)
            first, n = rooms.take(room, left // q)
            out.append((length, at, first, q, room))
            at, left = at + n * q, left - n * q
            if room > q * length:
                rooms.put(room - q * length, first, n)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str, text: str, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document; ``k`` numbers those of a task and length from 0."""
    source = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), uuid.uuid4().hex, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                tokens, lengths = enc.encode(some.column("text").to_pylist())
                stops = np.cumsum(lengths + 1)
                flat = np.full(int(stops[-1]), end_id, "<u4")
                inside = np.ones(len(flat), bool)
                inside[stops - 1] = False
                flat[inside] = tokens
                n = -(-(lengths + 1) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = (lengths + 1) - capacity * (n - 1)      # tokens of the first piece
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                long = np.where(piece > 0, capacity, head[row])
                a = (stops - lengths - 1)[row] + start
                view = memoryview(flat.view(np.uint8))
                crc = [zlib.crc32(view[4 * x:4 * y]) for x, y in zip(a.tolist(), (a + long).tolist())]
                order = np.argsort(long, kind="stable")        # number equal lengths in order
                sizes = np.bincount(long, minlength=capacity + 1)
                k = np.empty(len(long), np.int64)
                k[order] = np.arange(len(long)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
                seen += sizes
                cols = {"doc_id": some.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start,
                        "length": pa.array(long, pa.int32()), "ids_crc32": pa.array(crc, pa.int64()),
                        "part": pa.array([part] * len(row)), "k": k}
                if with_ids:                                   # pieces lie one after the other in ``flat``
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(a, len(flat)), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    return source.mapInArrow(run, PIECE.format(kind=kind) + (", ids array<bigint>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece, with ``ids`` if asked.

    ``tokenizer`` is a path that every executor can open. Sequences are numbered from 0."""
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    cut = keep(pieces(docs, tokenizer, capacity, doc_id, text, end_id, with_ids))
    per = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per = keep(per.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # <= capacity rows
    runs = best_fit_runs(counts, capacity)
    table = np.array(runs, np.int64).reshape(-1, 5)
    span = max(counts.values(), default=0) + 1
    plan = docs.sparkSession.sparkContext.broadcast((table[np.lexsort((table[:, 1], table[:, 0]))], span))
    ranked = cut.join(per.select("part", "length", "first"), ["part", "length"]).withColumn("k", F.col("k") + F.col("first"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "k", *(["ids"] if with_ids else []))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, span = plan.value
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, k = batch.column("length").to_numpy().astype(np.int64), batch.column("k").to_numpy()
            at = runs[np.searchsorted(keys, length * span + k, "right") - 1]
            nth, q = k - at[:, 1], at[:, 3]
            rest = batch.columns[6:]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column("length").cast(pa.int64()), batch.column("ids_crc32"),
                 pa.array(at[:, 2] + nth // q), pa.array(capacity - at[:, 4] + nth % q * length), *rest],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if rest else [])])

    kind = dict(cut.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
                                    "offset bigint" + (", ids array<bigint>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, segments): each sequence's tokens in order and the (doc_id, piece, offset,
    length) of its pieces, from :func:`pack` with ids. A group is one sequence, so its size is bounded."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return out.select("sequence_id", F.flatten("rows.ids").alias("ids"),
                      F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["piece"].alias("piece"),
                                                             r["offset"].alias("offset"), r["length"].alias("length"))).alias("segments"))
