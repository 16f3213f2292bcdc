"""Token ids as flat unsigned integer files with document offsets (operator 10).

Layout of a folder: per range of documents ``part-NNNNN-<token>.bin`` (the ids,
little-endian, 16 bits when the vocabulary allows and else 32), ``.idx`` (64-bit
token offsets inside the part, one more than documents) and ``.ids`` (64-bit
document ids), and ``manifest.json`` with the parts in order, each with its first
token and first document: prefix sums over the parts. A reader maps the files into
memory where they are local and reads a whole part otherwise.

Documents are dealt by ranges of the document id and sorted inside, so the parts in
order hold the documents in ascending order; a third of all rows from one source
changes nothing, and repeated ids stay side by side in (id, text) order. Each task
writes under a name of its own and only names of tasks that succeeded enter the
manifest, so a retried or speculative task leaves at most an unused file. The
driver sees one row per part.

Nulls and odd input: a null text is empty and still gets the end id; a null id is
written as -2^63 and read back as null; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.llm.files import is_local, open_fs, read_bytes, write_bytes
from vocalframe.llm.store import shared_folder, small_batches

NULL_ID = -(1 << 63)
#: Characters for which the word split below is exact; other texts are encoded whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: Byte-level pre-tokens of plain texts: contractions, letters, digits, the rest, white space.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÿ0-9]+|\s+(?!\S)|\s+")
MEMO_WORDS = 600_000
#: And at most about so many characters in them.
MEMO_CHARS = 12_000_000


class Encoder:
    """Token ids of whole texts, by the tokenizers library.

    A byte-level tokenizer that splits texts into words first gives a word the same
    ids everywhere, so the ids of a word are asked for once, from the library's model, and kept in a table of about
    ``MEMO_WORDS`` words and ``MEMO_CHARS`` characters; a full table drops the words that fewest texts had. Texts with characters
    outside ``PLAIN``, or with a special token's string, are encoded whole, and so is
    every text when the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not spec.get("normalizer") and model.get("type") == "BPE")
        self.model = self.tok.model
        letters = {chr(c): b for c in range(256) if PLAIN.fullmatch(chr(c)) for b in [pre_tokenizers.ByteLevel(
            add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]]} if self.by_word else {}
        self.alphabet = str.maketrans(letters)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.held = 0                                           # characters in it
        self.flat, self.stops = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int32)                 # texts that had the word

    def _shrink(self) -> None:
        """Keep the words of most texts, at most half of the table."""
        words, n = list(self.memo), len(self.memo)
        seen = self.seen[:n]
        least = max(2, int(np.partition(seen, n // 2)[n // 2]) + 1)
        kept = np.flatnonzero(seen >= least)
        first, lengths = self.stops[kept], self.stops[kept + 1] - self.stops[kept]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(first - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self._forget()
        size = 1 << max(16, int(len(kept) + 1).bit_length())
        self.stops, self.seen = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.flat = np.zeros(1 << max(16, int(len(flat)).bit_length()), np.uint32)
        self.flat[:len(flat)] = flat
        self.stops[1:len(kept) + 1] = ends
        self.memo = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.held = sum(map(len, self.memo))
        if self.held > MEMO_CHARS // 2:
            self._forget()

    def _learn(self, words: list[str]) -> None:
        """Add the ids of words, asked from the library's model; its byte alphabet replaces the characters."""
        k, stops = len(self.memo), [int(self.stops[len(self.memo)])]
        ids: list[int] = []
        for w in "\0".join(words).translate(self.alphabet).split("\0"):
            ids.extend([x.id for x in self.model.tokenize(w)])
            stops.append(stops[0] + len(ids))
        while len(self.stops) <= k + len(words):
            self.stops = np.concatenate((self.stops, np.zeros_like(self.stops)))
            self.seen = np.concatenate((self.seen, np.zeros_like(self.seen)))
        while len(self.flat) < stops[-1]:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[stops[0]:stops[-1]] = ids
        self.stops[k + 1:k + 1 + len(words)] = stops[1:]
        self.memo.update(zip(words, range(k, k + len(words))))
        self.held += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the texts, one after the other."""
        plain = [self.by_word and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [SPLIT.findall(t) if p else None for t, p in zip(texts, plain)]
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_CHARS:
            self._shrink()
        # one lookup a word; words not in the table yet are -1, learned together and looked up once more
        ats = [None if s is None else np.fromiter(map(self.memo.get, s, repeat(-1)), np.int64, len(s)) for s in split]
        missing = [None if at is None else np.flatnonzero(at < 0).tolist() for at in ats]
        new = {s[k] for s, ks in zip(split, missing) if ks for k in ks}
        if new:
            self._learn(list(new))
            for s, at, ks in zip(split, ats, missing):
                if ks:
                    at[ks] = [self.memo[s[k]] for k in ks]
        flat, ends = self.flat, self.stops
        out, lengths = [], np.zeros(len(texts), np.int64)
        for i, (t, at) in enumerate(zip(texts, ats)):
            if at is None:
                ids = np.array(self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32)
            elif not len(at):
                ids = np.zeros(0, np.uint32)
            else:
                self.seen[at] += 1
                first, n = ends[at], ends[at + 1] - ends[at]
                total = int(n.sum())
                ids = flat[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)]
            out.append(ids)
            lengths[i] = len(ids)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id",
                 text: str = "text", end_id: int = 0) -> str:
    """Encode ``text`` and write the files; returns the folder. ``tokenizer`` is a
    path that every executor can open."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    dtype = id_type(encoder(tokenizer).vocabulary, end_id)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(spark)
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name, part, ends, ids, total, out = encoder(tokenizer), None, 0, [0], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                name = f"part-{part:05d}-{uuid.uuid4().hex}"
                f, path = open_fs(f"{folder}/{name}")
                f.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = f.open_output_stream(path + ".bin", compression=None)
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                tokens, lengths = enc.encode(some.column("text").to_pylist())
                stops = np.cumsum(lengths + 1)
                flat = np.full(int(stops[-1]), end_id, dtype)
                keep_at = np.ones(len(flat), bool)
                keep_at[stops - 1] = False
                flat[keep_at] = tokens
                out.write(flat.tobytes())
                ends.append(total + stops)
                total += int(stops[-1])
                ids.append(some.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is not None:
            out.close()
            offsets = np.concatenate([np.zeros(1, np.int64), *ends[1:]]).astype("<i8")
            write_bytes(f"{folder}/{name}.idx", offsets.tobytes())
            write_bytes(f"{folder}/{name}.ids", np.concatenate(ids).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name],
                                              "docs": [len(offsets) - 1], "tokens": [total]})

    done = dealt.mapInArrow(write, "part int, name string, docs bigint, tokens bigint").collect()  # one row per part
    parts, doc_base, token_base = [], 0, 0
    for r in sorted(done, key=lambda r: r["part"]):
        parts.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"],
                      "first_doc": doc_base, "first_token": token_base})
        doc_base, token_base = doc_base + r["docs"], token_base + r["tokens"]
    write_bytes(f"{folder}/manifest.json", json.dumps({"dtype": dtype, "parts": parts}).encode())
    return folder


def part_arrays(folder: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of a part; the ids are mapped into memory when local."""
    f, path = open_fs(f"{folder}/{name}")
    offsets = np.frombuffer(read_bytes(f"{folder}/{name}.idx"), "<i8")
    docs = np.frombuffer(read_bytes(f"{folder}/{name}.ids"), "<i8")
    if is_local(f):
        ids = np.memmap(path + ".bin", dtype, "r") if offsets[-1] else np.zeros(0, dtype)
    else:
        ids = np.frombuffer(read_bytes(f"{folder}/{name}.bin"), dtype)
    return ids, offsets, docs


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """One row per document of a token folder: doc_id, start, n_tokens, ids_crc32 and,
    unless ``digest_only``, the token ids. One task per part."""
    manifest = json.loads(read_bytes(f"{folder}/manifest.json"))
    dtype, parts = manifest["dtype"], manifest["parts"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids array<bigint>")
    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p["name"], p["first_token"]) for p in parts], "name string, first_token bigint")
    listed = listed.repartition(max(1, len(parts)), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, offsets, docs = part_arrays(folder, name, dtype)
                for i in range(0, len(docs), 512):
                    a, b = offsets[i:i + 512], offsets[i + 1:i + 513]
                    flat = np.ascontiguousarray(ids[offsets[i]:b[-1]]).astype("<u4")
                    view = memoryview(flat.view(np.uint8))
                    crc = [zlib.crc32(view[4 * (x - a[0]):4 * (y - a[0])]) for x, y in zip(a, b[:len(a)])]
                    own = docs[i:i + 512]
                    cols = {"doc_id": pa.array(own, mask=own == NULL_ID), "start": a[:len(own)] + base,
                            "n_tokens": b - a[:len(own)], "ids_crc32": pa.array(crc, pa.int64())}
                    if not digest_only:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(a[:len(own)], b[-1]) - a[0], pa.int32()),
                                                               pa.array(flat, pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    return listed.mapInArrow(read, schema)
