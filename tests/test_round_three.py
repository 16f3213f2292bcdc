"""Round three: what the findings on time and disk changed."""

import random

import pandas as pd
from pyspark.sql import functions as F


def test_word_distances_are_scored_by_the_batch(monkeypatch):
    """Words once took Python integers pair by pair, whatever the batch."""
    from vocalframe.functions import bitparallel, edits
    rng, calls = random.Random(5), []
    one = bitparallel.levenshtein_bits
    counted = lambda a, b: calls.append(1) or one(a, b)
    for module in (bitparallel, edits):
        if hasattr(module, "levenshtein_bits"):
            monkeypatch.setattr(module, "levenshtein_bits", counted)
    a = [" ".join(rng.choice(["aa", "b", "çç", "d"]) for _ in range(40 + i % 50)) for i in range(2000)] + ["", "x", None]
    b = [" ".join(w for w in (t or "y").split(" ") if rng.random() > 0.2) for t in a]
    got = edits._long_pairs(pd.Series(a, dtype=object), pd.Series(b, dtype=object))
    assert len(calls) < 200
    assert list(got.word_errors[:-1]) == [one(x.split(" ") if x else [], y.split(" ") if y else []) for x, y in zip(a[:-1], b)]
    assert list(got.char_errors[:-1]) == [one(x, y) for x, y in zip(a[:-1], b)]
    assert got.iloc[-1].isna().all()


def test_pairs_of_very_different_lengths_share_a_batch():
    from vocalframe.functions.bitparallel import levenshtein_bits, levenshtein_many
    rng = random.Random(6)
    a = ["".join(rng.choice("abc é漢") for _ in range(n)) for n in (0, 1, 63, 64, 65, 700, 5000, 30)]
    b = ["".join(rng.choice("abc é漢") for _ in range(n)) for n in (3, 0, 64, 64, 200, 650, 4100, 900)]
    assert list(levenshtein_many(a, b)) == [levenshtein_bits(x, y) for x, y in zip(a, b)]


def test_long_runs_of_signs_are_normalised(spark):
    """The run's pattern was an alternative of two classes, which overflowed the stack."""
    from vocalframe.functions.text import with_normalized
    rows = [("a" + "- \t." * 50_000 + "B",), ("x (y) <z> [w] Q!",), (None,), ("c ( d",)]
    df = with_normalized(spark.createDataFrame(rows, "t string"), "t", "n")
    assert [r.n for r in df.select("n").collect()] == ["a b", "x q ", None, "c d"]


def test_labels_carry_no_text_and_keep_repeated_null_and_empty_rows(spark):
    from vocalframe.operators import labels as L
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "word string, id int")
    df = spark.createDataFrame([(1, "a x b", "p"), (2, "", "q"), (3, None, "r"), (4, "b", "s"), (4, "a b", "t"), (None, "a", "u"), (None, "b", "v")],
                               "idx long, t string, other string")
    start = F.size(F.split("t", " ")) >= 2
    enc = L.encode(df, "t", vocab, with_start=start)
    assert enc.columns == ["idx", "t", "other", "ids"]
    got = {r.other: (r.idx, r.t, r.ids) for r in enc.collect()}
    assert got == {"p": (1, "a x b", [1, 4, 3, 5]), "q": (2, "", []), "r": (3, None, []), "s": (4, "b", [4, 5, 5]),
                   "t": (4, "a b", [1, 4, 5, 5]), "u": (None, "a", []), "v": (None, "b", [])}
    narrow = L.encode(df, "t", vocab, with_start=start, keep=["idx"])
    assert sorted((r.idx or 0, r.ids) for r in narrow.collect()) == sorted((i or 0, ids) for i, _, ids in got.values())
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_part" in plan and "struct" not in plan


def test_numbered_documents_write_only_what_their_records_hold(spark, tmp_path, monkeypatch):
    import json

    from vocalframe.sources import documents
    seen, number = [], documents.number_rows
    monkeypatch.setattr(documents, "number_rows", lambda df, *a: seen.append(df.columns) or number(df, *a))
    fields = ["prediction", "reference", "normalized_prediction", "normalized_reference"]
    df = spark.createDataFrame([(7, "u", *"abcd"), (3, "u", *"efgh")], "idx long, unused string, " + ", ".join(f"{c} string" for c in fields))
    documents.write_predictions(df, str(tmp_path / "d.json"), "indexed")
    assert seen == [["_given", *fields]]
    got = [json.loads(x) for x in open(tmp_path / "d.json").read().splitlines() if x]
    assert [list(r.values()) for r in got] == [[0, *"efgh"], [1, *"abcd"]]


def test_guessed_distances_are_exact_whatever_the_guess(monkeypatch):
    """The kernel once scored the whole table of every pair; a guess narrows it to a band, never the result."""
    import numpy as np

    from vocalframe.functions import bitparallel
    rng = random.Random(7)
    a = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 300, 700, 1300) for _ in range(6)]
    b = ["".join(c for c in t if rng.random() > 0.2) for t in a]
    b[::5] = [t[len(t) // 2:] + t[:len(t) // 2] for t in a[::5]]
    b[::7] = [t[:9] + "x" * 350 + t[9:] for t in a[::7]]

    def plain(x, y):
        row = np.arange(len(y) + 1)
        codes, at = np.array([ord(c) for c in y], dtype=np.int64), np.arange(len(y) + 1)
        for i, c in enumerate(x):
            new = np.r_[i + 1, np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))]
            row = np.minimum.accumulate(new - at) + at
        return int(row[-1])

    want = [plain(x, y) for x, y in zip(a, b)]
    for symbol in (bitparallel.SYMBOL, 1.0, 0.0):                   # as measured, all by lanes, all by Python integers
        monkeypatch.setattr(bitparallel, "SYMBOL", symbol)
        for guess in (None, [0] * len(a), want, [w + rng.randint(-30, 30) for w in want], [10_000] * len(a)):
            assert list(bitparallel.levenshtein_many(a, b, guess)) == want


def test_lanes_far_from_the_diagonal_are_not_scanned(monkeypatch):
    """A pair of nearly equal texts once scanned every block at every symbol."""
    import numpy as np

    from vocalframe.functions import bitparallel
    rng, ran = random.Random(8), []
    text = "".join(rng.choice("abcdefgh ") for _ in range(6400))
    near = [text[:50 * i] + "x" + text[50 * i + 1:] for i in range(1, 60)]
    monkeypatch.setattr(bitparallel, "SYMBOL", 1.0)

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_and(self, x, y, out=None):
            ran.append(len(x))
            return np.bitwise_and(x, y, out=out)
    monkeypatch.setattr(bitparallel, "np", Counted())
    assert list(bitparallel.levenshtein_many([text] * 59, near, np.ones(59, dtype=int))) == [int(t != text) for t in near]
    assert sum(ran) < 2 * 59 * 6400 * 100 // 10                     # a hundred blocks a pair, two such calls a step


def test_signs_and_blanks_become_one_space_over_all_characters(spark):
    """The class looks most characters up in a table; single spaces are left where they are."""
    from vocalframe.functions import text as X
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["\U0001F600", "\U00010400", "\U0001D165", "！"]
    rows = [(f"a{c}b {c} {c}{c}c  {c}d{c}",) for c in chars] + [(" ",), ("  ",), ("",), (" a b ",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", X._post(F.col("t")).alias("n"), F.regexp_replace("t", X.MSP_OR_WS_RUN, " ").alias("w"),
                    X.needs_nfkc(F.col("t")).alias("u"),
                    ((F.char_length("t") != F.octet_length("t")) & F.col("t").rlike(X.NFKC_UNSAFE)).alias("v")).collect()
    assert [(r.t, r.n, r.u) for r in got] == [(r.t, r.w, r.v) for r in got]


def test_long_pairs_of_several_batches_are_scored_together(monkeypatch):
    import pandas as pd

    from vocalframe.functions import edits
    calls = []
    scored = edits._long_pairs
    monkeypatch.setattr(edits, "_long_pairs", lambda rs, hs: calls.append(len(rs)) or scored(rs, hs))
    batches = [(pd.Series(["a b c", None, "one two"]), pd.Series(["a c", None, "one too"])),
               (pd.Series([None, None]), pd.Series([None, None])),
               (pd.Series(["x y", "", "the end"]), pd.Series([None, "z", "the end"]))]
    rows = pd.concat(edits.long_pair_udf.func(iter(batches)), ignore_index=True)
    assert calls == [8]
    assert [None if pd.isna(v) else int(v) for v in rows["word_errors"]] == [1, None, 1, None, None, 2, 1, 0]
    assert [None if pd.isna(v) else int(v) for v in rows["char_errors"]] == [2, None, 1, None, None, 3, 1, 0]
    # a batch that fills the measure is not held back
    calls.clear()
    monkeypatch.setattr(edits, "GATHER_CHARS", edits.ROW_CHARS * 3)
    got = list(edits.long_pair_udf.func(iter(batches)))
    assert calls == [3, 5] and pd.concat(got, ignore_index=True).equals(rows)
