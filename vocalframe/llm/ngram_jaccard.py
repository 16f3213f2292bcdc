"""N-gram Jaccard join with Bayesian candidate pruning (operator 1).

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least ``threshold`` (0.8). Words are those of ``tokens``; a text of
one to four words has its word sequence as one shingle; a text without words is
linked to nothing.

1. Texts with equal word sequences are copies: they share a class and one of them
   (the representative) goes on.
2. Each representative gets 96 MinHash values, in 24 bands of 4. Two texts at
   similarity 0.8 miss each other in all bands with probability 3e-6.
3. In a bucket of up to ``SMALL`` members all pairs are candidates. In a larger one
   every member is paired with the least member (the leader) only.
4. Candidates are compared by 16 MinHash values (8 bits each) at a time. With a
   uniform prior, the posterior probability that the similarity reaches the
   threshold after n comparisons with m matches is a binomial tail; a pair is
   dropped when it falls below ``tolerance``.
5. The others are verified exactly on their texts.
6. The rest of the large buckets: where members of a bucket are still in different
   components, every pair across components is compared in blocks of ``BLOCK``
   members, again by steps 4 and 5, and only links that join components are
   returned, so no link that would join two classes is lost.
7. Classes are the connected components of the links.
8. Links are counted. Every link is inside a class. In a class without members of a
   large bucket all links are known from step 5; in the others every pair of texts is
   compared by steps 4 and 5 in blocks of ``LINK_BLOCK`` members, and a block task
   returns each member's number of links, not the pairs.

Scale: texts are shuffled only for documents with a candidate; hubs are dealt over
several tasks, a task streams one hub text and one member at a time, and a block
task holds two blocks. The rows of every step grow with the members of the buckets,
not with their pairs; a class of n texts that are counted in blocks has n / LINK_BLOCK
rows a text, and its n * n / 2 comparisons are dealt over the block tasks. Nothing but row counts and loop conditions is collected.

Nulls and odd input: null and empty texts are classes of their own; repeated rows are
copies; null ids are allowed (a class of null ids has a null class_id); an empty
table gives an empty result. Columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.llm import beside
from vocalframe.llm.components import connected_components
from vocalframe.llm.store import keep, small_batches, spread, temporary
from vocalframe.llm.tokens import Words, mix64, slices, words_of

SHINGLE = 5
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
SMALL = 48
BLOCK = 512
LINK_BLOCK = 1024       # members of a block in which links are counted,
LINK_WORDS = 1 << 21    # or as many words
BITS = 1 << 16          # shingles that are compared at a time
BROADCAST_IDS = 200_000
HUB_TASK = 200          # members that one task compares with a hub
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each document and the end), repeats included."""
    n = np.diff(w.ptr)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    ptr = np.concatenate(([0], np.cumsum(count)))
    if not ptr[-1]:
        return np.zeros(0, np.uint64), ptr
    at = np.repeat(w.ptr[:-1] - ptr[:-1], count) + np.arange(ptr[-1])
    padded = np.concatenate((w.hashes, np.zeros(SHINGLE, np.uint64)))
    end = np.repeat(w.ptr[1:], count)
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        out += np.where(at + j < end, padded[at + j], np.uint64(0)) * _PLACE[j]
    return mix64(out), ptr


def min_hashes(shingles: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """[documents, VALUES] 32-bit minima; documents without shingles have zeros."""
    docs = len(ptr) - 1
    out = np.zeros((docs, VALUES), np.uint32)
    full = np.diff(ptr) > 0
    starts = ptr[:-1][full]
    if len(starts):
        for k in range(VALUES):
            v = ((shingles * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(v, starts)
    return out


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's word sequence."""
    place = np.arange(len(w.hashes)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))
    full = np.diff(w.ptr) > 0
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = mix64(w.hashes ^ mix64(place.astype(np.uint64) + np.uint64(salt)))
        k = np.zeros(len(full), np.uint64)
        if len(x):
            k[full] = np.add.reduceat(x, w.ptr[:-1][full])
        keys.append(mix64(k + np.diff(w.ptr).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def sketch(docs: DataFrame, doc_id: str, text: str, place: tuple[Column, Column] | None = None) -> DataFrame:
    """(uid, doc_id, thash, file, row, n_words, k1, k2, bands, sig) per row, written once; ``place`` gives
    the file and row, which are null without it."""
    file, row = place or (F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("thash"), file.alias("file"),
                       row.alias("row"), F.col(text).alias("text"))
    rows = rows if place else spread(rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 4, 1 << 19):
                w = words_of(some.column(4))
                k1, k2 = sequence_keys(w)
                mins = min_hashes(*shingles_of(w))
                bands = np.zeros((len(mins), BANDS), np.uint64)
                for j in range(ROWS):
                    bands += mins[:, j::ROWS].astype(np.uint64) * _BAND[:, j]
                bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                sig = mins.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    *some.columns[:4], pa.array(np.diff(w.ptr), pa.int64()), pa.array(k1), pa.array(k2),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel())),
                    pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "thash", "file", "row", "n_words", "k1", "k2", "bands", "sig"])

    out = rows.mapInArrow(run, "doc_id bigint, thash bigint, file bigint, row bigint, n_words bigint, k1 bigint, k2 bigint, bands array<bigint>, sig binary")
    return keep(out.withColumn("uid", F.monotonically_increasing_id()))


def least_matches(threshold: float, tolerance: float, bits: int = 8) -> list[tuple[int, int]]:
    """(n, m): after n comparisons a pair with fewer than m matches is dropped.

    With b-bit values a comparison matches with probability p = J + (1 - J) / 2^b. Under a
    uniform prior on p, P(p >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t = threshold + (1 - threshold) / (1 << bits)
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(pairs: DataFrame, reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Pairs (a, b) whose posterior never falls below the tolerance."""
    sig = reps.select("uid", "sig")
    j = (pairs.join(sig.withColumnsRenamed({"uid": "a", "sig": "sa"}), "a")
         .join(sig.withColumnsRenamed({"uid": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb"))
    steps = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                some = batch.slice(i, 20_000)
                x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("sa", "sb"))
                alive = surviving(x, y, steps)
                if len(alive):
                    yield some.select(["a", "b"]).take(pa.array(alive))

    return j.mapInArrow(run, "a bigint, b bigint")


def surviving(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of the signature matrices that stay alive through all steps."""
    alive, matches = np.arange(len(y)), np.zeros(len(y), np.int64)
    for n, m in steps:
        left = x[alive, n - STEP:n] if len(x) > 1 or len(y) == 1 else x[:, n - STEP:n]
        matches[alive] += (left == y[alive, n - STEP:n]).sum(1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    return alive


def texts_of(members: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(uid, text) of the members' documents. Their ids are broadcast if they are at most
    ``BROADCAST_IDS``, so the corpus is only read; else texts are shuffled once."""
    need = keep(members.select("uid").distinct())
    where = need.join(reps.select("uid", F.col("doc_id").alias("rid"), F.col("thash").alias("rhash")), "uid")
    if need.count() <= BROADCAST_IDS:
        where = F.broadcast(where)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("thash"), F.col(text).alias("text"))
    return keep(rows.join(where, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("thash") == F.col("rhash"))).select("uid", "text"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every pair, exact. A hub's members are dealt over tasks of about
    ``HUB_TASK``; each task reads the hub's text once and then streams the members."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_TASK).alias("tasks"))
    hubs = tasks.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"))
    hubs = hubs.join(texts.withColumnRenamed("uid", "a"), "a").select("a", "task", F.lit(None).cast("bigint").alias("b"), "text")
    members = (pairs.join(tasks, "a").withColumn("task", F.pmod(F.xxhash64("b"), "tasks"))
               .join(texts.withColumnRenamed("uid", "b"), "b").select("a", "task", "b", "text"))
    dealt = (hubs.unionByName(members).repartition(F.col("a"), F.col("task"))
             .sortWithinPartitions("a", "task", F.col("b").asc_nulls_first()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            for some in slices(batch, 3):
                s, ptr = shingles_of(words_of(some.column(3)))
                a, b = some.column(0).to_pylist(), some.column(2).to_pylist()
                got: list[tuple[int, int, float]] = []
                for i, (x, y) in enumerate(zip(a, b)):
                    mine = np.unique(s[ptr[i]:ptr[i + 1]])
                    if y is None:
                        hub, own, last = x, mine, None
                    elif x == hub and y != last:       # a repeated row gives the same text again
                        got.append((x, y, jaccard(own, mine)))
                        last = y
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], ["a", "b", "jaccard"])

    return dealt.mapInArrow(run, "a bigint, b bigint, jaccard double")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return both / (len(x) + len(y) - both)


def candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of buckets: all pairs in small ones, else the leader with each member.
    ``members``: (bucket, n, leader, uid)."""
    small = members.where(F.col("n") <= SMALL).select("bucket", "uid")
    other = small.select(F.col("bucket").alias("bucket2"), F.col("uid").alias("uid2"))
    pairs = small.join(other, (F.col("bucket") == F.col("bucket2")) & (F.col("uid") < F.col("uid2")))
    star = members.where((F.col("n") > SMALL) & (F.col("uid") != F.col("leader")))
    return (pairs.select(F.col("uid").alias("a"), F.col("uid2").alias("b"))
            .unionByName(star.select(F.col("leader").alias("a"), F.col("uid").alias("b"))).distinct())


class Forest:
    """Union-find over component labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(y)] = self.root(x)


def rest_links(members: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float,
               tolerance: float) -> DataFrame:
    """Links that join different components inside large buckets.

    A bucket of n members is cut into n / BLOCK blocks and each pair of blocks is one
    group of rows, so a member is repeated once per block and no pair is a row. A pair
    is looked at only in the first bucket that its two members share (if that one is
    small, the pair was checked there)."""
    m = (members.where(F.col("n") > SMALL).select("bucket", "uid")
         .join(comp.withColumnsRenamed({"node": "uid", "component": "comp"}), "uid", "left")
         .withColumn("comp", F.coalesce("comp", "uid")))
    mixed = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    m = keep(m.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "bucket"))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
                        lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = (m.select("bucket", "uid", "comp", own.alias("own"), F.explode(pairs).alias("p"))
            .select("bucket", "p.i", "p.j", "own", "uid", "comp")
            .join(reps.select("uid", "sig", "bands"), "uid").join(texts.dropDuplicates(["uid"]), "uid"))
    dealt = rows.select("bucket", "i", "j", "own", "uid", "comp", "sig", "bands", "text") \
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "uid")
    steps = least_matches(threshold, tolerance)

    def compare(key: tuple, group: list[tuple]) -> list[tuple[int, int, float]]:
        bucket, i, j = key
        own, uid, comps, sig, bands, sets = zip(*group)
        sig, bands, own = signatures(sig), np.array(bands, np.int64), np.array(own)
        forest, out = Forest(), []
        roots = np.array(comps)
        for x in range(len(uid) - 1):
            other = np.arange(x + 1, len(uid))
            other = other[(roots[other] != roots[x]) & ((own[other] != own[x]) | (i == j))]
            same = bands[other] == bands[x]
            other = other[bands[x][same.argmax(1)] == bucket] if len(other) else other
            if not len(other):
                continue
            for y in other[surviving(sig[x:x + 1], sig[other], steps)].tolist():
                if forest.root(comps[x]) != forest.root(comps[y]) and (s := jaccard(sets[x], sets[y])) >= threshold - 1e-12:
                    out.append((uid[x], uid[y], s))
                    forest.join(comps[x], comps[y])
                    roots = np.array([forest.root(c) for c in comps])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups_of(batches, 3, 8):
            if got := compare(key, group):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], ["a", "b", "jaccard"])

    return dealt.mapInArrow(run, "a bigint, b bigint, jaccard double")


def signatures(values: tuple[bytes, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), VALUES)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int, text: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns: the key, and per row the values of the
    columns up to ``text`` and the sorted distinct shingles of the text."""
    key, group = None, []
    for batch in batches:
        for some in slices(batch, text):
            s, ptr = shingles_of(words_of(some.column(text)))
            cols = [some.column(k).to_pylist() for k in range(text)]
            for r in range(some.num_rows):
                row = tuple(c[r] for c in cols)
                if row[:keys] != key:
                    if group:
                        yield key, group
                    key, group = row[:keys], []
                group.append((*row[keys:], np.unique(s[ptr[r]:ptr[r + 1]])))
    if group:
        yield key, group


def common(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each (x, others): the number of shingles that set x has in common with each other one."""
    kinds, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = np.cumsum(times > 1) - 1                     # a shingle of one set is common to none
    row, place = row[times[at] > 1], place[at[times[at] > 1]]
    out = [np.zeros(len(others), np.int64) for _, others in pairs]
    for low in range(0, int((times > 1).sum()), BITS):
        here = (place >= low) & (place < low + BITS)
        r, c = row[here], place[here] - low
        bits = np.zeros((len(sets), (int(c.max()) >> 6) + 1), np.uint64)
        np.bitwise_or.at(bits, (r, c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        for k, (x, others) in enumerate(pairs):
            if len(others):
                out[k] += np.bitwise_count(bits[others] & bits[x]).sum(1, dtype=np.int64)
    return out


def link_counts(hot: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float,
                tolerance: float) -> DataFrame:
    """(uid, n_links) of every text in the components ``hot``: all its links, from all pairs of
    the component, in groups of two blocks as in ``rest_links``."""
    m = keep(comp.join(hot, "component").select("component", F.col("node").alias("uid"))
             .join(reps.select("uid", "n_words"), "uid").select("component", "uid", "n_words"))
    sizes = keep(m.groupBy("component").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / LINK_BLOCK, F.sum("n_words") / LINK_WORDS)).alias("blocks")))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
                        lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = (m.join(sizes, "component").join(reps.select("uid", "sig"), "uid").join(texts.dropDuplicates(["uid"]), "uid")
            .select("component", "uid", own.alias("own"), F.explode(pairs).alias("p"), "sig", "text"))
    dealt = rows.select("component", "p.i", "p.j", "own", "uid", "sig", "text") \
        .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own")
    steps = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in groups_of(batches, 3, 6):
            own, uid, sig, sets = zip(*group)
            sig, own, uid, size = signatures(sig), np.array(own), np.array(uid), np.array([len(x) for x in sets])
            split = int(np.searchsorted(own, j)) if i < j else len(own)
            pairs = []
            for x in range(split):
                other = np.arange(split if i < j else x + 1, len(own))
                if len(other):
                    pairs.append((x, other[surviving(sig[x:x + 1], sig[other], steps)]))
            n = np.zeros(len(own), np.int64)
            for (x, other), both in zip(pairs, common(sets, pairs)):
                linked = other[both >= (threshold - 1e-12) * (size[other] + size[x] - both)]
                n[linked] += 1
                n[x] += len(linked)
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[n > 0]), pa.array(n[n > 0])], ["uid", "n"])

    return dealt.mapInArrow(run, "uid bigint, n bigint").groupBy("uid").agg(F.sum("n").alias("n_links"))


def similar_links(docs: DataFrame, reps: DataFrame, doc_id: str, text: str, threshold: float,
                  tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, jaccard) of links that join the representatives of each class, the uids in large
    buckets, and (uid, text) of those and of the links. Without large buckets, all links."""
    rows = reps.select("uid", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("leader")).where("n > 1")
    members = keep(rows.join(sizes, "bucket").select("bucket", "n", "leader", "uid"))
    alive = keep(prune(candidates(members), reps, threshold, tolerance))
    large = members.where(F.col("n") > SMALL).select("uid").distinct()
    texts = texts_of(alive.select(F.col("a").alias("uid")).union(alive.select("b")).union(large), reps, docs, doc_id, text)
    links = keep(verify(alive, texts).where(F.col("jaccard") >= threshold - 1e-12))
    if large.limit(1).count() == 0:
        return links, large, texts
    more = rest_links(members, connected_components(links, "a", "b"), reps, texts, threshold, tolerance)
    return links.unionByName(more).dropDuplicates(["a", "b"]), large, texts


def least_row() -> Column:
    """The uid of the row of the least id (null last) and text hash. Rows equal in both differ
    at most in other columns; there the least place decides, then the uid."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "thash", "file", "row", "uid"))["uid"]


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6,
                 count_links: bool = True, place: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, thash (xxhash64 of the text), class_id (the least id of its
    class), rep_id (the least id of the documents with its words), n_copies (their number),
    n_links (links of the representative to other texts; null without ``count_links``), first (one
    row of each class, that of the least id, then text hash), and the columns file and row of ``place``."""
    s = sketch(docs, doc_id, text, place)
    classes = s.where("n_words > 0").groupBy("k1", "k2").agg(least_row().alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    classes = keep(classes)
    reps = keep(s.join(classes.select(F.col("rep").alias("uid")), "uid").select("uid", "doc_id", "thash", "n_words", "bands", "sig"))
    links, large, texts = similar_links(docs, reps, doc_id, text, threshold, tolerance)
    links = keep(links)
    comp = connected_components(links, "a", "b")
    if count_links:
        degree = links.select(F.col("a").alias("uid")).union(links.select("b")).groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
        hot = keep(comp.join(large.withColumnRenamed("uid", "node"), "node").select("component").distinct())
        if hot.limit(1).count():
            counted = keep(link_counts(hot, comp, reps, texts, threshold, tolerance))
            degree = degree.join(counted, "uid", "left_anti").unionByName(counted)
        found = F.coalesce("n_links", F.lit(0))
    else:
        degree, found = reps.select("uid"), F.lit(None).cast("bigint")
    tagged = (s.select("uid", "doc_id", "thash", "file", "row", "n_words", "k1", "k2").join(classes, ["k1", "k2"], "left")
              .withColumn("rep", F.coalesce("rep", "uid")))
    # the representative is one of its copies, so it carries the class on
    info = (tagged.where("uid = rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .join(degree.withColumnRenamed("uid", "rep"), "rep", "left")
            .select("rep", F.coalesce("component", "rep").alias("component"), found.alias("n_links"),
                    F.col("doc_id").alias("rep_id")))
    rows = keep(tagged.select("uid", "doc_id", "thash", "file", "row", "rep", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
                .join(info, "rep"))
    heads = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), least_row().alias("head"))
    return rows.join(heads, "component").select(
        "doc_id", "thash", "class_id", "rep_id", "n_copies", "n_links", (F.col("uid") == F.col("head")).alias("first"), "file", "row")


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least id. The other rows are marked
    by file and place, so the texts that stay are only read."""
    docs, file, row = beside.positioned(docs)
    with temporary(docs.sparkSession):
        out = jaccard_join(docs, doc_id, text, count_links=False, place=(file, row), **options)
        gone = beside.write(out.where("not first").select("file", "row"))
    return docs.where(beside.absent(gone, file, row))
