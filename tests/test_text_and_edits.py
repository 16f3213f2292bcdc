"""T1-T3 and A1/A2 against hand-made rows and plain-Python restatements."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from vocalframe.functions.edits import levenshtein_bits
from vocalframe.functions.text import light_normalize, with_normalized, word_count, words
from vocalframe.operators.metrics import pair_errors


def py_basic_normalize(s: str) -> str:
    """Plain-Python statement of the public basic normaliser (test oracle)."""
    s = s.lower()
    s = re.sub(r"[<\[][^>\]]*[>\]]", "", s)
    s = re.sub(r"\(([^)]+?)\)", "", s)
    s = "".join(" " if unicodedata.category(c)[0] in "MSP" else c
                for c in unicodedata.normalize("NFKC", s))
    return re.sub(r"\s+", " ", s.lower())


CASES = [
    "Hello, World!", "  two  spaces ", "<noise> the [laugh] cat (um) sat", "ﬁne ＦＵＬＬ width ½",
    "Café déjà vu — naïve", "tab\tand\nnewline", "()empty parens", "a(b)c[d]e<f>g", "",
    "x y z", "é combining", "Ĳssel ŉ ſ", "$100 + 5% = ?", "don't stop",
]


def test_basic_normalize_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r.i: r.n for r in with_normalized(df, "t", "n").collect()}
    for i, t in enumerate(CASES):
        assert got[i] == py_basic_normalize(t), (t, got[i], py_basic_normalize(t))


def test_basic_normalize_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    once = with_normalized(df, "t", "n")
    twice = with_normalized(once, "n", "n2")
    assert all(r.n == r.n2 for r in twice.collect())


def test_light_normalize_and_word_count(spark):
    df = spark.createDataFrame([("  Hello   WORLD ",), (None,), ("",), ("a\tb\nc",)], "t string")
    rows = df.select(light_normalize(F.col("t")).alias("l"), word_count(F.col("t")).alias("n")).collect()
    assert [(r.l, r.n) for r in rows] == [("hello world", 2), ("", 0), ("", 0), ("a b c", 3)]


def test_words_split_like_python(spark):
    df = spark.createDataFrame([(" a  b ",), ("",), ("x",)], "t string")
    assert [r.w for r in df.select(words(F.col("t")).alias("w")).collect()] == [["a", "b"], [], ["x"]]


def test_golden_wer_pair(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sit on mat mat")], "reference string, prediction string")
    r = pair_errors(df).collect()[0]
    assert (r.word_errors, r.ref_words) == (2, 6)


def _dp(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1]


def test_bit_parallel_matches_dp():
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        assert levenshtein_bits(a, b) == _dp(a, b)
        assert levenshtein_bits("".join(a), "".join(b)) == _dp(a, b)


def test_long_and_short_paths_agree(spark):
    """Rows above the long-pair threshold (Arrow job) and below (JVM built-in)
    give the same distances as a plain DP."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        n = 30 if i % 2 else 400
        ref = " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(n))
        hyp = " ".join(w for j, w in enumerate(ref.split()) if j % 6) + " zz"
        rows.append((i, ref, hyp))
    df = spark.createDataFrame(rows, "i int, reference string, prediction string")
    got = {r.i: (r.word_errors, r.char_errors) for r in pair_errors(df).collect()}
    for i, ref, hyp in rows:
        assert got[i] == (_dp(ref.split(), hyp.split()), _dp(ref, hyp)), i


def test_edit_distance_symmetric_and_zero(spark):
    df = spark.createDataFrame([("a b c d", "b c e"), ("x y", "x y")], "reference string, prediction string")
    fwd = [(r.word_errors, r.char_errors) for r in pair_errors(df).collect()]
    rev = [(r.word_errors, r.char_errors) for r in pair_errors(
        df.select(F.col("prediction").alias("reference"), F.col("reference").alias("prediction"))).collect()]
    assert fwd == rev and fwd[1] == (0, 0)


def test_batched_bit_parallel_matches_dp():
    from vocalframe.functions.bitparallel import _bucket_distances, levenshtein_many
    rng = random.Random(11)
    pats, texts = [], []
    for _ in range(120):
        m = rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 200])
        n = m + rng.randint(0, 40)
        pats.append("".join(rng.choice("ab c") for _ in range(m)))
        texts.append("".join(rng.choice("abcd ") for _ in range(n)))
    got = _bucket_distances(pats, texts)  # the numpy path, forced
    assert [int(g) for g in got] == [_dp(p, t) for p, t in zip(pats, texts)]
    toks = [[rng.choice(["aa", "b", "zz"]) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    toks2 = [[rng.choice(["aa", "b", "c"]) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    assert [int(g) for g in levenshtein_many(toks, toks2)] == [_dp(a, b) for a, b in zip(toks, toks2)]


def test_nfkc_fallback_matches_icu(spark, monkeypatch):
    """The Arrow-UDF NFKC path (used where ICU4J is absent) agrees with ICU."""
    from vocalframe.functions import text as TX
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    icu = {r.i: r.n for r in with_normalized(df, "t", "n").collect()}
    monkeypatch.setattr(TX, "icu_available", lambda s: False)
    arrow = {r.i: r.n for r in TX.with_normalized(df, "t", "n").collect()}
    assert icu == arrow
