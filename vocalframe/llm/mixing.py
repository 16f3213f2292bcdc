"""Mixing sources to target weights by Sainte-Lague apportionment (operator 8).

Sources in code point order (null last) get the weights in turn and share
``share`` times all words; a target stops at ``cap`` times its source's words and
the excess is shared again by weight. The targets become integer numbers of
equal-token blocks: one seat at a time goes to the source with the highest
quotient target / (2 * seats + 1). What a source's seats hold beyond whole copies
of the source is apportioned in the same way to its shards, by their full blocks,
and in each shard a seeded permutation of the block numbers says which blocks are
taken once more than the others.

Words are laid out per (source, shard) in seeded order and cut every ``block``
words, so a block may begin and end inside a document; a document's ``taken`` is
the sum over its blocks of the words inside times the block's copies. The words
behind a shard's last full block are taken with every whole copy, and once more
only where all full blocks are not enough. So a source's words come within about
a block of its target, however small it is, and no block is copied more than
``ceil(cap)`` times.

Scale: only (id, source, size) rows are shuffled. A source has about
sqrt(words / block) / 16 shards, so a source with a third of all rows is dealt over
many groups and a small one is whole. The driver sees one row per source and shard.
The mix itself reads each text where it lies: its words' blocks are found by the
text's file and place (``beside``).

Nulls and odd input: a null or empty text has size 0 and taken 0; a null source
is a source of its own; repeated rows are laid out one after the other, each with
its own words; an empty table gives an empty result. Columns other than those
named are ignored, so they may clash with nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.llm import beside
from vocalframe.llm.store import keep, small_batches, temporary

#: A word of the contract: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Above this many (source, shard) rows the quota table is joined without a broadcast.
BROADCAST_ROWS = 500_000


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap * size``; the excess goes to the others."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            return out
        for i in full:
            out[i] = float(cap * sizes[i])
        left = max(0.0, left - sum(out[i] for i in full))
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1); ties go to the earlier entry.

    ``most`` bounds an entry's seats. The quotient of the last seat is bracketed
    first, so the loop over single seats is at most one per entry."""
    n = len(votes)
    most = list(most) if most is not None else [seats] * n
    got = [0] * n
    if not seats or not any(votes):
        return got
    count = lambda q: [min(m, int((v / q + 1) // 2)) if v > 0 else 0 for v, m in zip(votes, most)]
    lo, hi = max(votes) / (2 * seats + 3), max(votes) * 2     # count(hi) is 0 for all
    if sum(count(lo)) > 0:
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(count(mid)) > seats:
                lo = mid
            else:
                hi = mid
            if hi - lo <= hi * 1e-15:
                break
        got = count(hi)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _permutation(key: str, n: int) -> tuple[int, int]:
    """(a, c) of the seeded permutation i -> (a * i + c) mod n."""
    h = hashlib.sha256(key.encode()).digest()
    a, c = int.from_bytes(h[:8], "big") % max(n, 1), int.from_bytes(h[8:16], "big") % max(n, 1)
    while math.gcd(max(a, 1), n) != 1:
        a += 1
    return max(a, 1) % max(n, 1) or 1, c


def source_plan(sizes: Sequence[int], full: Sequence[Sequence[int]], tails: Sequence[Sequence[int]], targets: Sequence[float],
                cap: float, block: int) -> list[list[tuple[int, int, bool]]]:
    """Per source and shard: (copies of every block, full blocks taken once more, whether the rest is, too).

    ``full`` and ``tails`` are the full blocks and the words behind them of each shard."""
    seats = sainte_lague(targets, round(sum(targets) / block), [math.ceil(cap * n / block) for n in sizes])
    out = []
    for size, blocks, rest, seat in zip(sizes, full, tails, seats):
        words = min(seat * block, int(cap * size))
        base, more = divmod(words, size) if size else (0, 0)
        take = min((more + block // 2) // block, sum(blocks))
        extra = sainte_lague([float(n) for n in blocks], take, blocks)
        left = more - take * block if take == sum(blocks) else 0
        again = []
        for n in rest:
            again.append(0 < n <= left)
            left -= n if again[-1] else 0
        out.append(list(zip([base] * len(blocks), extra, again)))
    return out


PLAN = "_s string, _k int, source_size long, target double, _base long, _more long, _tail long, _a long, _c long, _f long, _n long"


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        block: int = 16, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        place: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_word, copies, block, file, row); the last
    two are the columns of ``place``, null without it.

    ``copies`` lists how often each block under the document is taken and
    ``first_word`` is the document's offset in its first block, so the words of
    copy c are those in blocks with ``copies >= c``. Reruns agree."""
    spark = docs.sparkSession
    file, row = place or (F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    narrow = keep(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("_h"), file.alias("file"), row.alias("row")))

    def met(rows: DataFrame, other: DataFrame, n: int, on) -> DataFrame:
        return rows.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, on)

    words = {r["source"]: r["n"] for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()}     # a row a source
    names = sorted(words, key=lambda s: (s is None, s or ""))
    sizes = [words[s] for s in names]
    shards = [max(1, math.ceil(math.sqrt(n / block) / 16)) for n in sizes]
    counts = spark.createDataFrame(list(zip(names, shards)), "_s string, _shards int")
    laid = met(narrow, counts, len(names), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = laid.withColumn("_shard", F.pmod(F.xxhash64("_h", F.lit("shard")), F.col("_shards")).cast("int")).drop("_shards")
    per = {(r["source"], r["_shard"]): r["n"] for r in laid.groupBy("source", "_shard").agg(F.sum("size").alias("n")).collect()}
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(sizes), cap)
    own = [[per.get((s, k), 0) for k in range(n)] for s, n in zip(names, shards)]
    chosen = source_plan(sizes, [[n // block for n in o] for o in own], [[n % block for n in o] for o in own], targets, cap, block)
    plan = []
    for s, size, target, o, rows in zip(names, sizes, targets, own, chosen):
        for k, (n, (base, more, again)) in enumerate(zip(o, rows)):
            if (s, k) in per:
                full = n // block
                plan.append((s, k, size, target, base, more, base + again, *_permutation(f"{seed}|{s}|{k}", full), full, max(full, 1)))
    p = spark.createDataFrame(plan, PLAN)
    order = (Window.partitionBy("source", "_shard").orderBy("_h", "doc_id")
             .rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    j = met(laid, p, len(plan), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")))
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}")
    copies = F.when(F.col("size") > 0, F.transform(F.sequence(first, last), lambda b: F.when(b >= F.col("_f"), F.col("_tail")).otherwise(
        F.col("_base") + F.when((F.col("_a") * b + F.col("_c")) % F.col("_n") < F.col("_more"), 1).otherwise(0)).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    j = j.withColumn("copies", copies).withColumn("first_word", F.col("_start") % block)
    inside = F.transform(F.col("copies"), lambda c, i: c.cast("bigint") * (
        F.least((i + 1) * block, F.col("first_word") + F.col("size")) - F.greatest(i * block, F.col("first_word"))))
    taken = F.aggregate(inside, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return j.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                    "first_word", "copies", F.lit(block).alias("block"), "file", "row")


def word_ranges(copies: Sequence[int], first_word: int, size: int, block: int, copy: int) -> list[tuple[int, int]]:
    """Word ranges of a document that are in copy number ``copy``."""
    out: list[tuple[int, int]] = []
    for i, c in enumerate(copies):
        if c >= copy:
            a, b = max(0, i * block - first_word), min(size, (i + 1) * block - first_word)
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and copy, its text
    being the words taken (the text as it is where all are, else the taken ranges, a blank
    between them). Documents of which nothing is taken go."""
    docs, file, row = beside.positioned(docs)
    with temporary(docs.sparkSession):
        m = mix(docs, doc_id=doc_id, text=text, source=source, place=(file, row), **options).where("taken > 0")
        taken = beside.write(m.select("file", "row", "first_word", "copies", "block", "size"))
    names = docs.columns
    own = [f"_own_{i}" for i in range(len(names))]
    at = names.index(text)
    word = re.compile(WORD)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, place = taken.find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            hit = np.flatnonzero(place >= 0)
            if not len(hit):
                continue
            batch, facts = batch.take(pa.array(hit)), facts.take(pa.array(place[hit]))
            for i in range(0, batch.num_rows, 500):
                some, about = batch.slice(i, 500), facts.slice(i, 500)
                first, copies, block, size = (about.column(k).to_pylist() for k in range(2, 6))
                texts, rows, out = some.column(2 + at).to_pylist(), [], []
                for r, t in enumerate(texts):
                    spans = None
                    for copy in range(1, max(copies[r]) + 1):
                        ranges = word_ranges(copies[r], first[r], size[r], block[r], copy)
                        if ranges == [(0, size[r])]:
                            out.append(t)
                        else:
                            spans = spans or [x.span() for x in word.finditer(t)]
                            out.append(" ".join(t[spans[a][0]:spans[b - 1][1]] for a, b in ranges))
                        rows.append(r)
                done = some.take(pa.array(rows, pa.int64())).columns[2:]
                done[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(done, own)

    rows = docs.select(file.alias("_file"), row.alias("_row"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)])
    return rows.mapInArrow(run, ", ".join(f"{o} {t}" for o, (_, t) in zip(own, docs.dtypes))).toDF(*names)
