"""Language identification by interpolated Kneser-Ney character models (operator 7).

A text is read as its letters in words: each word is lower-cased, keeps its letters
only, and is framed by three starts and one end, so every position has three
characters of history. Per language, the counts of all four-grams of the training
texts give the top order; lower orders use continuation counts (distinct left
neighbours), all with absolute discounts, interpolated down to a uniform floor.
The finished probabilities and back-off weights are stored per language in sorted
arrays and found by binary search.

A text is scored by its length-normalised cross-entropy (nats per character) in
every model and gets the language with the lowest, ties to the first in code point
order. ``score`` is the softmax of the negative total over at most
``EVIDENCE`` characters. A text whose best cross-entropy is above the
language's calibrated limit is marked ``rejected``; so is one without letters, whose
language is ``und``.

Scale: counting runs over all training texts. Each Arrow batch is reduced to its
distinct words before its four-grams are taken, and only (language, four-gram,
count) sums are shuffled. Continuation counts, probabilities and back-offs are groupings
and joins of all four-grams; tasks write them as sorted arrays to the shared folder, and
scoring tasks map those files into memory (files of a store that is not a local path are
copied to the worker's temporary folder first). The driver holds a few rows per language
and file. The limits come from all training texts: tasks score them, and a histogram of
cross-entropies per language (steps of 0.0001 nats) gives the percentile.

Nulls and odd input: a null text is ``und`` with score 0; training rows with a null
language or text teach nothing; without any training text everything is ``und``;
characters above U+FFFF share one code; repeated rows count as often as they occur.
Columns of the documents are kept and the result is one struct.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.files import is_local, open_fs
from vocalframe.llm.store import keep, shared_folder, spread, temporary
from vocalframe.llm.tokens import mix64, slices, words_of

START, END = 1, 2
UND = "und"
EVIDENCE = 60
MEMO_WORDS = 150_000


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with frames, word number of each position); starts are positions, too."""
    low = ["".join(filter(str.isalpha, w.lower())) if not w.isalpha() else w.lower() for w in words]
    text = "".join("\x01\x01\x01" + w + "\x02" for w in low)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lengths = np.array([len(w) + 4 for w in low], np.int64)
    return np.minimum(codes, 0xFFFF).astype(np.uint64), np.repeat(np.arange(len(words)), lengths)


def four_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(four-grams packed 16 bits a character, word numbers), one per letter or end;
    words without letters give none."""
    codes, owner = letters_of(words)
    if len(codes) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.uint64(16)
    packed = (codes[:-3] << (s * np.uint64(3))) | (codes[1:-2] << (s + s)) | (codes[2:-1] << s) | codes[3:]
    at = owner[3:]
    real = (codes[3:] != START) & ~((codes[3:] == END) & (codes[2:-1] == START))
    return packed[real], at[real]


def distinct_words(w) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(hashes, number of each word occurrence, first occurrence, spelled words)."""
    hashes, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    raw = w.raw
    return hashes, inverse, first, [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]


def count_grams(train: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): four-gram counts of all training texts."""
    rows = spread(train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                w = words_of(some.column(1))
                if not len(w.hashes):
                    continue
                names, lang_of = np.unique(np.array(some.column(0).to_pylist(), dtype=object), return_inverse=True)
                _, word, _, spelled = distinct_words(w)
                grams, owner = four_grams(spelled)
                for k, name in enumerate(names):
                    times = np.bincount(word[lang_of[w.doc] == k], minlength=len(spelled))
                    n = times[owner]
                    some_grams, at = np.unique(grams[n > 0], return_inverse=True)
                    sums = np.bincount(at, n[n > 0], len(some_grams)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(some_grams), "gram": some_grams.view(np.int64), "n": sums})

    return (rows.mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class KneserNey:
    """One language: per order 1..4, sorted hashes with log probabilities, and sorted
    context hashes with log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    limit: float = float("inf")

    @staticmethod
    def fit(packed: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From four-grams (packed) and their counts."""
        order4 = (packed.astype(np.uint64), counts.astype(np.float64))
        levels = [order4]
        for k in (3, 2, 1):                              # continuation counts: distinct left neighbours
            upper = levels[-1][0]
            suffix = upper & np.uint64((1 << 16 * k) - 1)
            levels.append(tuple(x if i == 0 else x.astype(np.float64) for i, x in enumerate(np.unique(suffix, return_counts=True))))
        levels = levels[::-1]                            # orders 1 to 4
        symbols = len(levels[0][0]) + 1
        below, floor = None, 1.0 / symbols
        grams, contexts = [], []
        for k, (keys, n) in enumerate(levels, 1):
            one, two = float((n == 1).sum()), float((n == 2).sum())
            d = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
            ctx = keys >> np.uint64(16)
            ctx_keys, at, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
            total = np.bincount(at, n)
            weight = d * kinds / total
            low = np.full(len(keys), floor) if below is None else _lookup(below, keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
            p = np.maximum(n - d, 0) / total[at] + weight[at] * low
            below = _sorted(keys, p, k)
            grams.append((below[0], np.log(below[1]).astype(np.float32)))
            c = _sorted(ctx_keys, weight, 16 + k)
            contexts.append((c[0], np.log(c[1]).astype(np.float32)))
        return KneserNey(grams, contexts, float(np.log(floor)))

    def find(self, context: bool, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the keys that are stored, which are) among the k-grams or their contexts."""
        table, values = (self.contexts if context else self.grams)[k - 1]
        at, hit = _find(table, keys, 16 * context + k)
        return values[at[hit]], hit

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        """Natural log probability of each four-gram's last character after the other three."""
        out = np.zeros(len(packed))
        todo = np.arange(len(packed))
        for k in (4, 3, 2, 1):
            keys = packed[todo] & np.uint64((1 << 16 * k) - 1) if k < 4 else packed[todo]
            values, hit = self.find(False, k, keys)
            out[todo[hit]] += values
            todo, keys = todo[~hit], keys[~hit]
            values, hit = self.find(True, k, keys >> np.uint64(16))
            out[todo[hit]] += values
        out[todo] += self.floor
        return out


def _hash(keys: np.ndarray, tag: int) -> np.ndarray:
    return mix64(keys ^ np.uint64(tag * 0x9E3779B97F4A7C15 % (1 << 64)))


def _sorted(keys: np.ndarray, values: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    h = _hash(keys, tag)
    order = np.argsort(h)
    return h[order], values[order]


def _find(table: np.ndarray, keys: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    h = _hash(keys, tag)
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return at, table[at] == h


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, tag: int) -> np.ndarray:
    at, hit = _find(table[0], keys, tag)
    return np.where(hit, table[1][at], 0.0)


_maps: dict[str, np.ndarray] = {}


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A file of numbers, mapped into memory once per process."""
    if uri not in _maps:
        filesystem, path = open_fs(uri)
        if not is_local(filesystem):
            with filesystem.open_input_stream(path, compression=None) as src, tempfile.NamedTemporaryFile(delete=False) as out:
                while piece := src.read(1 << 22):
                    out.write(piece)
            path = out.name
        _maps[uri] = np.memmap(path, kind, "r")
        if not is_local(filesystem):
            os.unlink(path)
    return _maps[uri]


@dataclass
class Stored(KneserNey):
    """A language whose arrays are in files: per table (the order, plus 16 for contexts) the
    pieces (first key, file, first entry, entries), sorted by their keys as signed numbers."""

    pieces: dict[int, list[tuple[int, str, int, int]]] = field(default_factory=dict)

    def find(self, context: bool, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.pieces.get(16 * context + k, [])
        keys = keys.view(np.int64)
        values, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        which = np.searchsorted(np.array([p[0] for p in pieces], np.int64), keys, "right") - 1
        for i in np.unique(which[which >= 0]).tolist():
            _, uri, start, n = pieces[i]
            at = np.flatnonzero(which == i)
            table = _mapped(f"{uri}.keys", "<i8")[start:start + n]
            place = np.searchsorted(table, keys[at])
            place[place == n] = 0
            same = table[place] == keys[at]
            values[at[same]] = _mapped(f"{uri}.values", "<f4")[start:start + n][place[same]]
            hit[at[same]] = True
        return values[hit], hit


class Scorer:
    """All models, with a bounded memory of the words scored last in this worker."""

    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self._forget()

    def _forget(self) -> None:
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.names) + 2))

    def release(self) -> None:
        """Forget words and unmap local files at the end of a task, so that an idle worker holds none;
        copies of remote files stay mapped."""
        self._forget()
        for uri in [u for u in _maps if is_local(open_fs(u)[0])]:
            del _maps[uri]

    def __getstate__(self):
        return {"names": self.names, "models": self.models}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def word_values(self, spelled: list[str]) -> np.ndarray:
        """Per word: summed log probability in each model, positions, letters."""
        grams, owner = four_grams(spelled)
        n = len(spelled)
        uniq, inv = np.unique(grams, return_inverse=True)
        cols = [np.bincount(owner, m.log_prob(uniq)[inv], n) for m in self.models]
        positions = np.bincount(owner, minlength=n)
        return np.stack([*cols, positions, np.maximum(positions - 1, 0)], 1).astype(np.float64)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropies [documents, languages], positions, letters)."""
        w = words_of(column)
        docs, width = len(w.ptr) - 1, len(self.names) + 2
        if not len(w.hashes):
            return np.zeros((docs, len(self.names))), np.zeros(docs), np.zeros(docs)
        hashes, first, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        seen = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        values = np.zeros((len(hashes), width))
        values[seen] = self.values[at[seen]]
        if not seen.all():
            f = first[~seen]
            values[~seen] = self.word_values([w.raw[a:b].tobytes().decode("utf-8", "replace")
                                              for a, b in zip(w.starts[f].tolist(), w.ends[f].tolist())])
            if len(self.known) > MEMO_WORDS:
                self._forget()
                self.known, self.values = hashes, values
            else:
                known = np.concatenate((self.known, hashes[~seen]))
                order = np.argsort(known, kind="stable")
                self.known, self.values = known[order], np.concatenate((self.values, values[~seen]))[order]
        sums = np.zeros((docs, width))
        full = np.diff(w.ptr) > 0
        sums[full] = np.add.reduceat(values[word], w.ptr[:-1][full], axis=0)
        positions = sums[:, -2]
        return -sums[:, :-2] / np.maximum(positions, 1)[:, None], positions, sums[:, -1]


def estimate(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``KneserNey.fit`` of all languages at once, from (lang, gram, n): (lang, kind, key, value) of
    every table of ``Stored``, and (lang, floor)."""
    levels = {4: grams}
    for k in (3, 2, 1):                                  # continuation counts: distinct left neighbours
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        levels[k] = keep(levels[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    floors = keep(levels[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("floor")))
    below, out = None, None
    for k in (1, 2, 3, 4):
        one, two = (F.sum((F.col("n") == i).cast("double")) for i in (1, 2))
        d = F.when(one > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), one / (one + 2 * two)))).otherwise(0.5)
        discounts = levels[k].groupBy("lang").agg(d.alias("d"))                          # a row per language
        rows = levels[k].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        contexts = rows.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = keep(contexts.join(F.broadcast(discounts), "lang")
                        .select("lang", "ctx", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")))
        if k == 1:                                       # one context, the empty one
            rows = rows.join(F.broadcast(contexts), ["lang", "ctx"]).join(F.broadcast(floors.withColumnRenamed("floor", "low")), "lang")
        else:
            rows = (rows.join(contexts, ["lang", "ctx"])
                    .withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
                    .join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["lang", "suffix"]))
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("low")
        below = keep(rows.select("lang", "gram", p.alias("p")))
        for kind, key, value, made in ((k, "gram", "p", below), (16 + k, "ctx", "weight", contexts)):
            some = made.select("lang", F.lit(kind).alias("kind"), F.col(key).alias("key"), F.log(value).cast("float").alias("value"))
            out = some if out is None else out.unionByName(some)
    return out, floors


def store_models(tables: DataFrame, floors: DataFrame) -> dict[str, Stored]:
    """Write the tables as sorted arrays; a model per language knows its pieces of the files."""
    folder = shared_folder(tables.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}"             # of this attempt; the manifest names those that count
        streams, start, pieces = [], 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not streams:
                filesystem, path = open_fs(uri)
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                streams = [filesystem.open_output_stream(f"{path}.{x}", compression=None) for x in ("keys", "values")]
            keys, langs, kinds = batch.column(2).to_numpy(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            streams[0].write(keys.astype("<i8").tobytes())
            streams[1].write(batch.column(3).to_numpy().astype("<f4").tobytes())
            cuts = [0, *[i for i in range(1, len(keys)) if kinds[i] != kinds[i - 1] or langs[i] != langs[i - 1]], len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if pieces and pieces[-1][:2] == [langs[x], kinds[x]]:
                    pieces[-1][5] += y - x
                else:
                    pieces.append([langs[x], kinds[x], int(keys[x]), uri, start + x, y - x])
            start += len(keys)
        for stream in streams:
            stream.close()
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), (
                pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["lang", "kind", "first", "uri", "start", "n"])

    ordered = tables.repartitionByRange("lang", "kind", "key").sortWithinPartitions("lang", "kind", "key")
    manifest = ordered.mapInArrow(run, "lang string, kind int, first bigint, uri string, start bigint, n bigint").collect()
    models = {r["lang"]: Stored([], [], float(np.log(r["floor"]))) for r in floors.collect()}
    for r in sorted(manifest, key=lambda r: r["first"]):
        models[r["lang"]].pieces.setdefault(r["kind"], []).append((r["first"], r["uri"], r["start"], r["n"]))
    return models


def calibrate(rows: DataFrame, scorer: Scorer, part: float) -> dict[str, float]:
    """The percentile ``part`` of the cross-entropies of the (lang, text) rows in their own language's
    model, over the rows that get their own language; over all its rows if a language has none."""
    cast = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = cast.value
        place = {name: i for i, name in enumerate(s.names)}
        for batch in batches:
            for some in slices(batch, 1):
                x, _, letters = s.score(some.column(1))
                own = np.array([place.get(name, -1) for name in some.column(0).to_pylist()])
                at = np.flatnonzero((letters > 0) & (own >= 0))
                value = np.round(x[at, own[at]], 4)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), pa.array(np.argmin(x[at], 1) == own[at]), pa.array(value)],
                                                 ["lang", "right", "value"])
        s.release()

    counts = (spread(rows).mapInArrow(run, "lang string, right boolean, value double")
              .groupBy("lang", "right", "value").agg(F.count(F.lit(1)).alias("n")))
    found = counts.groupBy("lang", "right").agg(F.percentile("value", F.lit(part), F.col("n")).alias("q")).collect()     # two rows a language at most
    return {r["lang"]: r["q"] for r in sorted(found, key=lambda r: r["right"])}


def fit(train: DataFrame, lang: str = "lang", text: str = "text", slack: float = 1.25, margin: float = 0.75) -> Scorer:
    """Train on every row of ``train``; the limit of a language is ``slack`` times the
    99.9th percentile of its training texts' cross-entropy (``calibrate``), plus ``margin`` nats."""
    with temporary(train.sparkSession):                  # the models are files of their own
        models = store_models(*estimate(keep(count_grams(train, lang, text))))
    scorer = Scorer(models)
    if models:
        rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
        for name, q in calibrate(rows, scorer, 0.999).items():
            models[name].limit = slack * q + margin
    return scorer


def identify(docs: DataFrame, scorer: Scorer, text: str = "text", result: str = "language") -> DataFrame:
    """``docs`` with a struct ``result``: lang, score, cross_entropy, rejected. A column of that
    name is replaced; the others are kept. Only the text is sent to Python, and no text comes back."""
    cast = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang:string,score:double,cross_entropy:double,rejected:boolean>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = cast.value
        names = np.array([*s.names, UND], dtype=object)
        limits = np.array([m.limit for m in s.models] or [0.0])
        for column in columns:
            out = [pa.array([], kind)]
            for some in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0):
                x, positions, letters = s.score(some.column(0))
                none = (letters == 0) | (not s.names)
                best = np.argmin(x, 1) if s.names else np.zeros(len(none), np.int64)
                low = x[np.arange(len(x)), best] if s.names else np.zeros(len(none))
                total = -(x - low[:, None]) * np.minimum(positions, EVIDENCE)[:, None]
                score = np.where(none, 0.0, 1.0 / np.maximum(np.exp(total).sum(1), 1.0))
                out.append(pa.StructArray.from_arrays([
                    pa.array(names[np.where(none, len(s.names), best)].tolist(), pa.string()), pa.array(score),
                    pa.array(low, mask=none), pa.array(none | (low > limits[best]))], fields=list(kind)))
            yield pa.concat_arrays(out)
        s.release()

    return spread(docs).withColumn(result, run.asNondeterministic()(F.col(f"`{text}`")))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n
