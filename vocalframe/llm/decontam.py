"""Benchmark decontamination with a suffix automaton of the test items (operator 2).

The normalised words of all items go into one generalised suffix automaton.
Documents stream through it word by word; the state tells the longest suffix read
that occurs in some item. A window is ``window`` consecutive words of an item, or
all words of a shorter one; each word inside any occurrence of a window is hit.
Before a document is streamed, its words are looked up with numpy: only runs whose
neighbouring pairs all occur side by side in some item, and that are as long as the
shortest window, can hold an occurrence, so only those are streamed.

Hit words make spans. A document whose hit share reaches ``coverage`` is
contaminated and dropped; in the others, spans of at least ``span`` words are cut
out of the text.

Scale: documents are never shuffled. Items are read in blocks of at most
``block_words`` words; each block is one automaton, broadcast on its own, and each
further block is one more pass inside the same tasks. All automata pass through the
driver and stay in every worker, about 0.8 KB a benchmark word, so this is for
benchmarks of up to some million words.

Nulls and odd input: null and empty texts have no words and no hits; items without
words have no window; equal items are all reported; repeated documents get equal
rows; empty tables give empty results. Columns of the documents are kept under
their own names; the results are one struct, which replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.store import free_name, spread
from vocalframe.llm.tokens import slices, words_of

WINDOW = 13


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of its windows."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        items = [(i, h) for i, h in items if len(h)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        coded = [(i, np.searchsorted(self.vocabulary, h).tolist()) for i, h in items]
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        pairs = [x * len(self.vocabulary) + y for _, c in coded for x, y in zip(c, c[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, list[tuple[int, str]]] = {}      # state: (words, item) of items below a window
        self.found: dict[int, set[str]] = {}                   # window state: items
        for _, c in coded:
            last = 0
            for x in c:
                last = self._extend(last, x)
        n = len(self.link)
        self.top = list(range(n))                              # the ancestor that holds the window-long suffix
        for v in sorted(range(n), key=self.length.__getitem__):
            up = self.link[v]
            if up >= 0 and self.length[up] >= window:
                self.top[v] = self.top[up]
        for item, c in coded:
            v = 0
            for k, x in enumerate(c, 1):
                v = self.next[v][x]
                if k >= window:
                    self.found.setdefault(self.top[v], set()).add(item)
            if len(c) < window:
                self.short.setdefault(v, []).append((len(c), item))
        self.near = [-1] * n                                   # nearest state, itself or above, that ends a short item
        for v in sorted(range(n), key=self.length.__getitem__):
            self.near[v] = v if v in self.short else self.near[self.link[v]] if self.link[v] >= 0 else -1

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(length)
        self.link.append(self.link[q])
        self.link[q] = len(self.link) - 1
        return self.link[q]

    def _redirect(self, p: int, x: int, q: int, to: int) -> None:
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = to
            p = self.link[p]

    def _extend(self, last: int, x: int) -> int:
        """The state of the current item's words with ``x`` behind them."""
        q = self.next[last].get(x)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            new = self._clone(q, self.length[last] + 1)
            self._redirect(last, x, q, new)
            return new
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                self.link[new] = clone = self._clone(q, self.length[p] + 1)
                self._redirect(p, x, q, clone)
        return new

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges [a, b) in ``codes`` and the items whose windows occur."""
        v = n = 0
        spans, items = [], set()
        for i, x in enumerate(codes, 1):
            while v and x not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if x in self.next[v]:
                v, n = self.next[v][x], n + 1
            if n >= self.window:
                spans.append((i - self.window, i))
                items |= self.found[self.top[v]]
            u = self.near[v]
            while u >= 0:
                for words, item in self.short[u]:
                    if words <= n:
                        spans.append((i - words, i))
                        items.add(item)
                up = self.link[u]
                u = self.near[up] if up >= 0 else -1
        return spans, items

    def runs(self, hashes: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(document, first word, word numbers) of the runs that could hold a window."""
        if not len(self.vocabulary) or not len(hashes):
            return
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == hashes
        if self.shortest > 1:
            key = code[:-1] * len(self.vocabulary) + code[1:]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            ok = known[:-1] & known[1:] & (self.pairs[at] == key)
            cut = ptr[1:-1]
            cut = cut[(cut > 0) & (cut < len(hashes))]
            ok[cut - 1] = False                                # no pair across documents
        else:
            ok = known
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
        first, last = edges[::2], edges[1::2] + (self.shortest > 1)
        long_enough = last - first >= self.shortest
        for a, b in zip(first[long_enough].tolist(), last[long_enough].tolist()):
            while a < b:                                       # single words may run across documents
                d = int(np.searchsorted(ptr, a, "right")) - 1
                stop = min(b, int(ptr[d + 1]))
                if stop - a >= self.shortest:
                    yield d, a - int(ptr[d]), code[a:stop].tolist()
                a = stop


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> list[SuffixAutomaton]:
    """One automaton per block of items; rows come to the driver one by one."""
    out, block, words = [], [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        h = words_of(pa.array([r["t"]], pa.string())).hashes
        if block and words + len(h) > block_words:
            out.append(SuffixAutomaton(block, window))
            block, words = [], 0
        block.append(("" if r["i"] is None else r["i"], h))
        words += len(h)
    return [*out, SuffixAutomaton(block, window)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_words: int = 1_000_000, span: int = 1, result: str = "scan",
         cut: bool = False) -> DataFrame:
    """``docs`` with a struct ``result``: n_words, spans (word ranges), n_hit, items and, if ``cut``, ``clean``:
    the text without its spans of at least ``span`` words, null where there are none. A column named as
    ``result`` is replaced; the others are kept. Only the text is sent to Python."""
    sc = docs.sparkSession.sparkContext
    cast = [sc.broadcast(a) for a in automata(benchmark, item_id, item_text, window, block_words)]
    fields = "n_words:bigint,n_hit:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>,clean:string"
    kinds = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                       ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                       ("items", pa.list_(pa.string())), ("clean", pa.string())])

    @F.arrow_udf(f"struct<{fields}>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [pa.array([], kinds)]
            for some in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0):
                w = words_of(some.column(0))
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for b in cast:
                    automaton = b.value
                    for d, a, codes in automaton.runs(w.hashes, w.ptr):
                        got, names = automaton.stream(codes)
                        if got:
                            spans.setdefault(d, []).extend((a + x, a + y) for x, y in got)
                            items.setdefault(d, set()).update(names)
                rows = []
                for d, n in enumerate(np.diff(w.ptr).tolist()):
                    own = merged(spans.get(d, ()))
                    long = [s for s in own if cut and s[1] - s[0] >= span]
                    rows.append({"n_words": n, "n_hit": sum(b - a for a, b in own), "spans": [{"a": a, "b": b} for a, b in own],
                                 "items": sorted(items.get(d, ())), "clean": cut_spans(w, d, long) if long else None})
                out.append(pa.array(rows, kinds))
            yield pa.concat_arrays(out)

    return spread(docs).withColumn(result, run.asNondeterministic()(F.col(f"`{text}`")))


def cut_spans(w, d: int, spans: list[tuple[int, int]]) -> str:
    """Document ``d`` without the bytes from the first to the last word of each span."""
    out, at, base = [], int(w.off[d]), int(w.ptr[d])
    for a, b in spans:
        out.append(w.raw[at:w.starts[base + a]].tobytes())
        at = int(w.ends[base + b - 1])
    out.append(w.raw[at:w.off[d + 1]].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def contaminated(n_hit, n_words, percent: int = 5):
    """n_hit / n_words reaches ``percent`` percent, in integers."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5, span: int = WINDOW,
                  **options) -> DataFrame:
    """``docs`` without contaminated documents and without the benchmark spans of the others."""
    name = free_name(docs, "scan")
    s = scan(docs, benchmark, text, span=span, result=name, cut=True, **options)
    s = s.where(~contaminated(F.col(f"{name}.n_hit"), F.col(f"{name}.n_words"), percent))
    return s.select(*[F.coalesce(f"{name}.clean", F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
