"""Operators 11 to 13 against brute force: resampling, packing, whitening."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import ODD, frame, prose, words
from vocalframe.llm import packing, resample, whitening
from vocalframe.llm.queries import byte_bpe


# operator 11

def features(text, longest=3):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, bench, percent=5, least_words=20, seed=42):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, word by word."""
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t))
    s, t = count([x for _, x in rows]), count(bench)
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        fs = features(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def resampling_texts():
    rng = np.random.default_rng(3)
    return [*ODD, "ß" * 300 + " " + "中文" * 40000 + " end", prose(9, 30), prose(9, 30),
            *[" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 90))) for _ in range(150)], prose(5, 20000)]


def test_resampling_matches_brute_force(spark):
    texts, bench = resampling_texts(), ["a b c d", None, "", "a b a b A", prose(9, 12)]
    target = spark.createDataFrame([(t, "x") for t in bench], "text string, weight string")
    docs = frame(spark, texts).withColumns({"score": F.lit("clash"), "rank": F.lit("clash"), "tie": F.lit("clash")})
    got = rows_of(resample.resample(docs.repartition(7), target, percent=30))
    assert got == sorted(brute_resample(list(enumerate(texts)), bench, percent=30), key=str)
    assert sum(r[4] is not None for r in got) == 30 * sum(len(words(t)) >= 20 for t in texts) // 100


def test_resampling_ties_nulls_repeats_and_empty(spark):
    rows = [(i % 3 if i % 5 else None, prose(1, 25)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([("abcd",)], "text string")
    got = resample.resample(docs, target, percent=50)
    assert rows_of(got) == sorted(brute_resample(rows, ["abcd"], percent=50), key=str)
    assert resample.resampled(docs, target, percent=50).count() == 20
    assert resample.resample(docs.where("false"), target).count() == 0
    none = resample.resample(docs, target.where("false"), percent=50)
    assert rows_of(none) == sorted(brute_resample(rows, [], percent=50), key=str)


def test_drawn_rows_keep_their_columns(spark):
    texts = resampling_texts()
    docs, target = frame(spark, texts), spark.createDataFrame([("a b c",)], "text string")
    out = resample.resampled(docs, target, percent=20)
    want = {r[0] for r in brute_resample(list(enumerate(texts)), ["a b c"], percent=20) if r[4]}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_checksums_carry_over_long_parts():
    carry, rng = resample.Carry(), np.random.default_rng(0)
    for n in (0, 1, 255, 256, 70000, 1 << 24):
        a, b = rng.bytes(5), bytes(n)
        got = carry(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    gain, counts = rng.integers(-30000, 30000, 10000), rng.integers(0, 5000, (5, 10000)) * (rng.random((5, 10000)) < 0.1)
    assert (resample.GainPlanes(gain).weights(counts) == counts @ gain).all()
    assert (resample.GainPlanes(np.zeros(70, int)).weights(counts[:, :70]) == 0).all()


# operator 12

def naive_best_fit(lengths, capacity):
    """Rooms left after best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_runs_are_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    for most in (1, min(2, capacity), max(1, capacity // 3), capacity):
        lengths = [int(x) for x in rng.integers(1, most + 1, rng.integers(0, 400))] + [capacity] * 3
        counts = Counter(lengths)
        fill = defaultdict(int)
        for length, first, seq, q, room in packing.best_fit_runs(counts, capacity):
            assert room - q * length >= 0
            stop = min([f for ln, f, *_ in packing.best_fit_runs(counts, capacity) if ln == length and f > first], default=counts[length])
            for i in range(stop - first):
                at = seq + i // q
                assert fill[at] == capacity - room + i % q * length         # gapless, in order
                fill[at] += length
        assert sorted(capacity - x for x in fill.values()) == naive_best_fit(lengths, capacity)


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(byte_bpe())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        got = sorted(by_doc[i])
        assert [p for p, *_ in got] == list(range(len(got))) and sum(n for *_, n in got) == len(own)
        assert [a for _, a, _ in got] == np.cumsum([0, *[n for *_, n in got]])[:-1].tolist()
        assert all(n == capacity for *_, n in got[1:])
    for own in by_seq.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= capacity
    assert len(by_seq) == len(naive_best_fit([r.length for r in rows], capacity))


@pytest.mark.parametrize("capacity", [5, 64, 2048])
def test_packing_matches_brute_force(spark, capacity):
    rng = np.random.default_rng(4)
    texts = dict(enumerate([*ODD, *[prose(int(k), int(k)) for k in rng.integers(1, 200, 80)], prose(2, 8000), "same text"] + ["same text"] * 40))
    docs = frame(spark, list(texts.values())).withColumns({c: F.lit("clash") for c in ("piece", "part", "k", "length", "ids")})
    rows = packing.pack(docs.repartition(5), byte_bpe(), capacity).collect()
    check_packing(rows, texts, capacity)


def test_packed_sequences_hold_the_tokens(spark):
    texts = [*ODD, *[prose(k, 3 * k + 1) for k in range(30)]]
    packed = packing.pack(frame(spark, texts), byte_bpe(), 100, with_ids=True)
    tok = Tokenizer.from_file(byte_bpe())
    pieces = {}
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 100
        for s in r.segments:
            pieces[s.doc_id, s.piece] = r.ids[s.offset:s.offset + s.length]
    for i, t in enumerate(texts):
        own = [x for k in sorted(pieces) if k[0] == i for x in pieces[k]]
        assert own == [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing_repeats_null_ids_and_empty(spark):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, None), (1, "x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, byte_bpe(), 4).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 6 and sum(r.doc_id == 1 and r.length == 1 for r in got) >= 2
    assert packing.pack(docs.where("false"), byte_bpe()).count() == 0


# operator 13

def exact_whitening(x, components=32):
    """(eigenvalues, covariance) of whole-number rows, the covariance in fractions."""
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n)
                     for j in range(d)] for i in range(d)])
    return s, cov, np.linalg.eigh(cov)[0][::-1][:components]


VECTORS = "vec_id bigint, embedding array<double>, component string, whitened string, v string"


def vector_frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in enumerate(vectors)], VECTORS)


@pytest.mark.parametrize("dims, rows", [(1, 9), (2, 30), (6, 50), (40, 90)])
def test_whitening_matches_exact_covariance(spark, dims, rows):
    rng = np.random.default_rng(dims)
    good = (rng.standard_normal((rows, dims)) * np.linspace(3, 0.3, dims)).tolist()
    bad = [None, [], [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [0.5] * (dims + 1)]
    df = vector_frame(spark, [*bad, *good, good[0], good[0]])
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in [*good, good[0], good[0]]]
    s, cov, values = exact_whitening(x)
    n, c = len(x), len(values)
    got = defaultdict(dict)
    for r in whitening.whiten(df, whitening.fit(df.repartition(3))).collect():
        assert r.n == n and r.identity_error < 1e-8
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id - len(bad)], s))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        got[r.vec_id][r.component] = r.whitened
    assert sorted(got) == list(range(len(bad), len(bad) + n)) and all(sorted(g) == list(range(1, c + 1)) for g in got.values())
    w = np.array([[got[i + len(bad)][k + 1] for k in range(c)] for i in range(n)])
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :c]
    want = (np.array(x, float) - np.array([a / n for a in s])) @ vectors / np.sqrt(values)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-7


def test_eigenvectors_of_hard_matrices():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    shapes = [np.eye(30), np.diag(np.arange(30.0)), q @ np.diag([5.0] * 10 + [1.0] * 20) @ q.T, np.ones((30, 30)),
              q @ np.diag(2.0 ** -np.arange(30)) @ q.T, np.zeros((3, 3)), np.array([[2.0]]),
              np.kron(np.eye(15), [[2.0, 1.0], [1.0, 2.0]]), 1e-100 * (q @ np.diag(np.arange(30.0)) @ q.T)]
    for a in shapes:
        a = (a + a.T) / 2
        k = min(20, len(a))
        values, v = whitening.leading_components(a, k)
        size = max(np.abs(a).max(), 1e-290)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size * len(a)
        assert np.abs(v @ v.T - np.eye(k)).max() < 1e-12
        assert np.abs(a @ v.T - v.T * values).max() < 1e-12 * size * len(a)


def test_whitening_of_flat_and_empty_tables(spark):
    flat = vector_frame(spark, [[1.0, 2.0]] * 5)
    assert whitening.whiten(flat, whitening.fit(flat)).count() == 0
    none = flat.where("false")
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
    line = vector_frame(spark, [[float(i), 2.0 * i, 7.0] for i in range(10)])
    rows = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1) and rows[0].identity_error < 1e-9


def test_covariance_does_not_depend_on_the_deal(spark):
    rng = np.random.default_rng(8)
    df = vector_frame(spark, (rng.standard_normal((300, 12)) * 1e6 + 1e9).tolist())
    a, b = whitening.fit(df.repartition(1)), whitening.fit(df.repartition(11))
    assert (a.components == b.components).all() and (a.values == b.values).all() and a.sums == b.sums
