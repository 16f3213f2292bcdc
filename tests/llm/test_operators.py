"""Small fixtures for the training-data operators: brute force, round trips, odd input."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalframe.llm import (beside, decontam, fm, imatch, langid, mixing, ngram_jaccard, quotes, tokenfiles, tokens, url_rules, warc)
from vocalframe.llm.components import connected_components
from vocalframe.llm.queries import URL_RULES, byte_bpe
from vocalframe.llm.store import shared_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, bucket string, taken string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def frame(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


ODD = [None, "", "  \n", "one", "!!!", "é à", prose(1, 3000), "x\x01y z"]


def test_words_match_the_pattern():
    texts = [*ODD, "A-B c9É ünï 中文字 🎉x", prose(2, 50).upper()]
    w = tokens.words_of(pa.array(texts, pa.string()))
    got = [[w.low[a:b].tobytes().decode() for a, b in zip(w.starts[p:q], w.ends[p:q])] for p, q in zip(w.ptr, w.ptr[1:])]
    assert got == [words(t) for t in texts]
    by_word = {}
    for h, x in zip(w.hashes.tolist(), [x for d in got for x in d]):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


# operator 1

def brute_classes(texts):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_jaccard_join_finds_the_brute_force_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL", 6)      # buckets of the group below are large
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = prose(3, 120).split()
    texts = [*ODD, *ODD, "one", prose(4, 40), prose(4, 40).upper()]
    for k in range(40):                                   # one group, near and not so near copies
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, 7), replace=False):
            w[at] = f"edit{k}x{at}"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in ngram_jaccard.jaccard_join(frame(spark, texts)).collect()}
    expected = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == expected
    assert sum(r["first"] for r in got.values()) == len(set(expected))
    assert got[0].n_links == 0 and got[3].n_copies == 3


@pytest.mark.parametrize("link_block, bits", [(1024, 1 << 16), (7, 64)])
def test_jaccard_join_counts_every_link(spark, monkeypatch, link_block, bits):
    monkeypatch.setattr(ngram_jaccard, "SMALL", 6)
    monkeypatch.setattr(ngram_jaccard, "LINK_BLOCK", link_block)
    monkeypatch.setattr(ngram_jaccard, "BITS", bits)
    rng = np.random.default_rng(6)
    texts = [*ODD, prose(4, 40), prose(4, 39)]
    for base in (prose(11, 150).split(), prose(12, 90).split()):
        for k in range(30):
            w = list(base)
            for at in rng.choice(len(w), rng.integers(0, 4), replace=False):
                w[at] = f"edit{at}x{rng.integers(0, 3)}"
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    want = [sum(i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in ngram_jaccard.jaccard_join(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) > 20


def test_jaccard_join_repeats_and_empty(spark):
    d = frame(spark, ["a b c d e f", "a b c d e f"])
    assert ngram_jaccard.one_per_class(d.union(d)).count() == 1
    assert ngram_jaccard.jaccard_join(d.where("false")).count() == 0
    assert ngram_jaccard.one_per_class(frame(spark, ODD)).columns == d.columns


def test_kept_row_does_not_depend_on_the_deal(spark, tmp_path):
    rng = np.random.default_rng(9)
    base, texts = prose(21, 100).split(), []
    for k in range(12):
        texts.append(" ".join([*base[:-1], f"end{rng.integers(0, 4)}"]))
    docs = frame(spark, [*texts, *ODD, prose(2, 30)])
    docs = docs.union(frame(spark, texts[:2], source="other")).withColumn("_metadata", F.lit("clash"))
    kept = []
    for k, n in enumerate((1, 5, 11)):
        path = str(tmp_path / str(n))
        docs.orderBy(F.rand(k)).repartition(n).write.parquet(path)
        for d in (spark.read.parquet(path), docs.repartition(n)):
            out = ngram_jaccard.one_per_class(d)
            assert out.columns == docs.columns
            kept.append(sorted(r.doc_id for r in out.collect()))
    assert all(k == kept[0] for k in kept) and 0 in kept[0] and not set(range(1, 12)) & set(kept[0])


def test_facts_beside_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(beside, "CHUNK", 7)
    spark.range(1000).repartition(6).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    docs, file, row = beside.positioned(docs)
    facts = beside.write(docs.where("id % 3 = 0").select(file.alias("file"), row.alias("row")).repartition(9))
    assert len(facts.chunks) >= 334 // 7
    left = docs.where(beside.absent(facts, file, row)).collect()
    assert sorted(r.id for r in left) == [i for i in range(1000) if i % 3]
    none = beside.write(docs.where("false").select(file.alias("file"), row.alias("row")))
    assert docs.where(beside.absent(none, file, row)).count() == 1000


def test_pruning_limits_grow():
    steps = ngram_jaccard.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 97, 16)) and all(0 < m < 0.8 * n for n, m in steps)


# operator 2

def brute_scan(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        for g in {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == g:
                    hit |= set(range(i, i + n))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("block_words", [10, 1000])
def test_decontamination_matches_brute_force(spark, block_words):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 30)))) for i in range(20)] + [(99, None), (98, "one"), (97, "one")]
    texts = [*ODD, *[" ".join(rng.choice(list("abcd"), rng.integers(1, 80))) for _ in range(60)], items[3][1] + " zz " + prose(1, 400)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    s = decontam.scan(frame(spark, texts), bench, block_words=block_words)
    for r in s.collect():
        assert (r.scan.n_words, r.scan.n_hit, r.scan["items"]) == brute_scan(texts[r.doc_id], items)


def test_decontamination_cuts_spans(spark):
    item, clean = prose(7, 20), prose(8, 1000)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontam.decontaminate(frame(spark, [clean, item, f"{clean}\n{item}. end", None]), bench)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: clean, 2: f"{clean}\n. end", 3: None} and out.columns == frame(spark, [""]).columns
    assert decontam.scan(frame(spark, ["a"]), bench.where("false")).first().scan.n_hit == 0


# operator 3

def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/fr/1">'),      # blocked through its alias
        (2, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://a.org/x.html">'),   # two steps
        (3, "http://b.net/fr/1", None), (4, "http://d.org/z", '<link rel=canonical href=http://good.com/>'),
        (5, "http://e.org/q", '<link rel="canonical" href="http://d.org/z#top"><link rel="canonical" href="http://b.net/es/">'),
        (6, None, None), (7, "nonsense", None), (8, "HTTP://WWW.Example.COM/en/?a#b", ""), (8, "HTTP://WWW.Example.COM/en/?a#b", ""),
        (9, "http://m.example.com/en/1", ""), (10, "http://lonely.org", ""), (11, "http://f.org/p", '<link rel="canonical" href="http://k.net/fr/only-a-target">'),
    ]
    got = url_rules.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [
        "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "block"]
    assert by[8].host == "www.example.com" and by[8].path == "/en/" and by[8].rule == "www.example.com/en/"
    assert by[6].host == "" and by[7].rule is None and by[1].via == "alias"
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_rules.filter_urls(empty, URL_RULES).count() == 0


def test_url_links_are_resolved(spark):
    base = "http://Site.org/a/b.html?q=1#f"
    targets = {"http://x.net/fr/1": "http://x.net/fr/1", "//x.net/y": "http://x.net/y", "/fr/x": "http://Site.org/fr/x",
               "c": "http://Site.org/a/c", "./c/../d?z=/../": "http://Site.org/a/d?z=/../", "../../../e": "http://Site.org/e", "..": "http://Site.org/",
               "?p=2": "http://Site.org/a/b.html?p=2", "#top": None, "mailto:a@b.c": None, "/go?u=http://x.net/": "http://Site.org/go?u=http://x.net/"}
    rows = [(base, t, w) for t, w in targets.items()] + [("no scheme", "/x", None), ("http://h.org", "x", "http://h.org/x")]
    got = spark.createDataFrame(rows, "b string, t string, w string").select(
        "t", "w", url_rules.resolved(F.col("b"), F.col("t")).alias("r")).collect()
    assert [(r.t, r.r) for r in got] == [(r.t, r.w) for r in got]


def test_url_aliases_by_relative_links_as_sql(spark, tmp_path):
    import duckdb
    from vocalframe.llm.oracles import ORACLES
    pages = [(1, "http://a.net/x/1", '<link rel="canonical" href="/fr/x">'), (2, "http://a.net/x/2", '<link rel=canonical href="../es/./y">'),
             (3, "http://b.org/p", '<link rel="canonical" href="//a.net/fr/z">'), (4, "http://c.org/q", '<meta http-equiv=refresh content="0; url=r">'),
             (5, "http://c.org/r", '<link rel=canonical href="http://b.org/p">'), (6, "http://d.org/", '<link rel=canonical href="#x">'),
             (7, "http://e.org/s/t", '<link rel=canonical href="mailto:x@a.net">'), (8, "none", '<link rel=canonical href="/fr/">'),
             (9, "http://c.org/q", '<link rel=canonical href="http://good.com/">' * 2), (10, None, "x"),
             (11, "http://f.org/" + "l" * 20000, '<link rel=canonical href="//a.net/fr/z?utm_x=1">' + "text " * 40000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'c' host", "'c' r", "'c' src")
    got = url_rules.filter_urls(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "via").collect()
    df.select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["op3_url_filters"]).fetchall())
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow",
                                                  8: "allow", 9: "allow", 10: "allow", 11: "allow"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 5)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 42


# operator 4

def test_half_edit_and_likeness(spark):
    texts = ["abcdef", "ABCDEFGHé", None, "z", prose(1, 300), prose(1, 300)]
    got = {r.doc_id: r for r in imatch.compare_edited(frame(spark, texts), low=0.0, high=1.0).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))
    d = frame(spark, ["p q r", "s"])
    assert imatch.compare_edited(d.union(d)).count() == 4 and imatch.compare_edited(d.where("false")).count() == 0


def brute_fingerprints(texts, low, high, seed="lexicon"):
    """Band fingerprints, term by term; None where a text has fewer than LEAST lexicon terms."""
    sets, n, out = [set(words(t)) for t in texts], len(texts), []
    df = {}
    for x in sets:
        for t in x:
            df[t] = df.get(t, 0) + 1
    code = {}
    for t, c in df.items():
        if c >= 2 and low * n <= c <= high * n:
            h = "".join(hashlib.sha256(f"{seed}|{k}|{t}".encode()).hexdigest() for k in (0, 1))
            mask = sum(1 << k for k, most in enumerate(imatch.THRESHOLDS) if int(h[4 * k:4 * k + 4], 16) < most)
            if mask:
                code[t] = (int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (1 << 31) << 32) + mask
    for x in sets:
        own = sorted(code[t] for t in x if t in code)
        lists = [[c for c in own if c >> k & 1] for k in range(imatch.SUBSETS)]
        out.append("".join(hashlib.md5(",".join(map(str, p)).encode()).hexdigest()[:8] if p else imatch.NONE for p in lists)
                   if len(own) >= imatch.LEAST else None)
    return out


def test_fingerprints_match_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}é" for k in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 900)))) for _ in range(80)] + ODD
    got = {r.doc_id: r.fingerprint for r in imatch.compare_edited(frame(spark, texts), low=0.05, high=0.3).collect()}
    want = brute_fingerprints(texts, 0.05, 0.3)
    assert sum(w is not None for w in want) > 60 and all(w is None or got[i] == w for i, w in enumerate(want))


def test_likeness_outside_the_band(spark):
    """A third near copies of one text; a rare language; unrelated texts."""
    rng = np.random.default_rng(11)
    base = prose(31, 200).split()
    copies = [" ".join([*base[:k], f"edit{k}", *base[k + 1:]]) for k in range(40)]
    common = [f"c{k}" for k in range(3000)]
    others = [" ".join(rng.choice(common, 150)) for _ in range(80)]
    rare = "  ".join(f"ż{k}" for k in range(300))
    texts = [*copies, *others, rare, rare.replace("ż7 ", "zz "), " ".join(f"ø{k}" for k in range(300)), "long " * 30000 + prose(3, 20000)]
    got = {r.doc_id: r for r in imatch.compare_edited(frame(spark, texts)).collect()}
    assert all(got[i].near_next > 0.5 for i in range(39)) and len({got[i].fingerprint for i in range(40)}) > 1
    assert got[120].near_next > 0.5 and all(got[i].near_next < 0.2 for i in (39, *range(40, 119), 119, 121, 122, 123))


# operator 5

def test_warc_headers_of_other_archives_are_not_changed():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: <http://x.org/a%20b%2Fc>\r\nWARC-Record-ID: <urn:a%41>\r\n\r\nbody"
    got = warc.parse_header(head)
    assert got["warc-target-uri"] == "http://x.org/a%20b%2Fc" and got["warc-record-id"] == "urn:a%41"
    for uri in ("http://x.org/a%20b%2Fc", "http://x.org/plain", "u\r\nWARC-Type: x"):
        ours = warc.inflate(warc.record("response", "urn:page:1", uri, "2024-01-01T00:00:00Z", b"x", None))[1]
        assert warc.parse_header(ours)["warc-target-uri"] == uri and (warc.ESCAPES.encode() in ours) == (uri != "http://x.org/plain")


def test_warc_round_trip_and_pushdown(spark):
    rows = [(1, "http://a/1", "same"), (3, "http://a/3\r\nx%", "same"), (2, None, "same"), (4, "u", None), (5, "v", "é" * 9000),
            (6, "w", ""), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = shared_folder(spark)
    warc.archive(pages, folder)
    got = {r.record_id: r for r in warc.read_archive(spark, folder, payload=True).collect()}
    assert len(got) == 7
    for i, u, h in rows:
        body = (h or "").encode()
        r = got["" if i is None else f"urn:page:{i}"]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.target_uri == u and r.record_type == ("revisit" if i in (1, 2, 4, None) else "response")
        assert r.payload == (body if r.record_type == "response" else None)
    assert got["urn:page:1"].refers_to == "urn:page:3" and got["urn:page:4"].refers_to == "urn:page:6"
    some = warc.read_archive(spark, folder).where("record_type = 'revisit' and target_uri is not null")
    assert some.count() == 3
    reader = warc.WarcReader(folder, False, False, 64)
    from pyspark.sql.datasource import EqualTo
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    empty = shared_folder(spark)
    warc.archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


# operator 6

def test_factorisation_machine(spark):
    rng = np.random.default_rng(0)
    good = [prose(i, int(rng.integers(5, 200))) for i in range(150)]
    bad = [("buy!! " * int(rng.integers(5, 100))) for _ in range(50)]
    docs = frame(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    m = fm.fit(docs.where("doc_id % 5 <> 0"), labels)
    got = {r.doc_id: r.score for r in fm.score(docs, m).collect()}
    held = [i for i in range(0, 200, 5)]
    assert np.mean([(got[i] >= 0.3) == (i < 150) for i in held]) > 0.9 and all(0 <= s <= 1 for s in got.values())
    doc, at, value = fm.features(pa.array(["a b a"]), np.array([5.0]))
    m.factors, m.linear = rng.normal(size=m.factors.shape), rng.normal(size=m.linear.shape)
    brute = m.bias + m.linear[at] @ value + sum(m.factors[at[i]] @ m.factors[at[j]] * value[i] * value[j]
                                                for i in range(len(at)) for j in range(i))
    assert np.isclose(m.logits(doc, at, value, 1)[0], brute)
    none = fm.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in fm.score(docs, none).collect()} == {0.5}


# operator 7

def test_kneser_ney_is_a_distribution():
    spelled = ["banana", "bandana", "anna", "ban"]
    grams, _ = langid.four_grams(spelled)
    keys, n = np.unique(grams, return_counts=True)
    m = langid.KneserNey.fit(keys, n)
    ctx = np.array([(ord("b") << 32) | (ord("a") << 16) | ord("n")], np.uint64)
    symbols = np.unique(keys & np.uint64(0xFFFF))
    total = np.exp(m.log_prob((ctx << np.uint64(16)) | symbols)).sum()
    assert 0.8 < total <= 1.0 + 1e-6                    # the rest is kept for unseen characters
    assert all(np.all(np.diff(k) > 0) for k, _ in m.grams if len(k) > 1)


def test_language_identification(spark):
    a, b = [prose(i, 60) for i in range(40)], [prose(i, 60).translate(str.maketrans("abcdefgh", "qrstuvwx")) for i in range(40)]
    train = frame(spark, a, "aa").union(frame(spark, b, "bb")).union(frame(spark, ODD, None))
    scorer = langid.fit(train)
    texts = [prose(99, 20), "QRST uvwx.", None, "", "123 !!", "中文" * 50]
    got = [r.language for r in langid.identify(frame(spark, texts), scorer).orderBy("doc_id").collect()]
    assert [g.lang for g in got[:5]] == ["aa", "bb", "und", "und", "und"]
    assert [g.rejected for g in got] == [False, False, True, True, True, True] and all(0 <= g.score <= 1 for g in got)
    none = langid.fit(train.where("false"))
    assert langid.identify(frame(spark, ["abc"]), none).first().language.lang == "und"


def test_language_models_hold_every_four_gram(spark):
    rng = np.random.default_rng(3)
    han = ["".join(map(chr, 0x4E00 + rng.integers(0, 20000, 1500))) for _ in range(2200)]      # 3.3 million, most of them once
    rare = ["quick brown foxes", "jumping wizard"]
    train = frame(spark, han, "zh").union(frame(spark, rare, "xx")).union(frame(spark, [prose(i, 50) for i in range(5)], "aa"))
    scorer = langid.fit(train)
    assert scorer.names == ["aa", "xx", "zh"]
    for name, texts in (("xx", rare), ("zh", han)):
        keys, n = np.unique(langid.four_grams([x for t in texts for x in words(t)])[0], return_counts=True)
        brute = langid.KneserNey.fit(keys, n)
        ask = np.concatenate((keys[::97], langid.four_grams(["foxy", "zzz", "一丁丂七"])[0], keys[:50] ^ np.uint64(1)))
        model = scorer.models[scorer.names.index(name)]
        assert np.allclose(model.log_prob(ask), brute.log_prob(ask), atol=1e-4)
    assert langid.identify(frame(spark, ["brown wizard"]), scorer).first().language.lang == "xx"


def test_language_limits_cover_all_training_rows(spark):
    rng = np.random.default_rng(8)
    common = [prose(i, 4) for i in range(12_500)]
    rare = {f"r{k}": [" ".join("".join(rng.choice(list("qrstuvwx"), 5)) for _ in range(6))] for k in range(4)}
    train = frame(spark, common, "aa")
    for name, texts in {**rare, "c1": common[:1], "c2": common[:1]}.items():        # the text of "c2" gets "c1"
        train = train.union(frame(spark, texts, name))
    scorer = langid.fit(train)
    by = dict(zip(scorer.names, scorer.models))
    assert all(np.isfinite(m.limit) for m in by.values()) and by["c1"].limit == by["c2"].limit
    for name, texts in {"aa": common, **rare}.items():
        x, _, _ = scorer.score(pa.array(texts))
        own = x[np.argmin(x, 1) == scorer.names.index(name), scorer.names.index(name)]
        assert abs(by[name].limit - (1.25 * np.percentile(own, 99.9) + 0.75)) < 2e-4


# operator 8

def test_sainte_lague_matches_single_seats():
    rng = np.random.default_rng(2)
    for _ in range(50):
        votes = rng.integers(0, 50, rng.integers(1, 8)).astype(float).tolist()
        seats = int(rng.integers(0, 60))
        got = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
            got[i] += 1
        assert mixing.sainte_lague(votes, seats) == got


def test_targets():
    assert mixing.fill_targets([10, 100], [1, 1], 60, 2) == [20.0, 40.0]
    assert mixing.fill_targets([10, 10], [3, 1], 30, 2) == [20.0, 10.0]


def test_mix_keeps_its_promises(spark):
    texts = [prose(i, 3 * i) for i in range(60)]
    docs = frame(spark, texts, source="a").union(frame(spark, texts[:20], source="b")).union(frame(spark, [*ODD, prose(5, 700)], source=None))
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r.size
        x[1] += r.taken
    for size, taken, target, said in by.values():
        assert size == said and abs(taken - target) <= 16
    assert abs(sum(x[2] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1e-6
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": [320] * 1000, "b": [500], "c": [40, 80], "d": [3], "e": [], None: [7] * 9, "f": [20000, 5], "g": [16] * 7}
    rows = [(i, prose(i, n), s, "clash") for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mixing.mix(docs).collect()
    for s, ns in sizes.items():
        own = [r for r in got if r.source == s]
        assert len(own) == len(ns) and all(r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split()) for r in own)
        assert not own or abs(sum(r.taken for r in own) - own[0].target) <= 16


def brute_taken(rows, seed=42, block=16):
    """The promises of the plan on single words: shares of each block are whole copies."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        for r in own:
            inside = [max(0, min((i + 1) * block, r.first_word + r.size) - max(i * block, r.first_word)) for i in range(len(r.copies))]
            assert sum(inside) == r.size and r.taken == sum(a * b for a, b in zip(inside, r.copies))
            assert max(r.copies, default=0) - min(min(x.copies, default=9) for x in own if x.size) <= 1


def test_taken_words_are_whole_blocks(spark):
    rng = np.random.default_rng(4)
    docs = frame(spark, [prose(k, int(n)) for k, n in enumerate(rng.integers(0, 200, 80))], source="a")
    docs = docs.union(frame(spark, [prose(k, 50) for k in range(400)], source="b")).union(frame(spark, ODD, source="c"))
    rows = mixing.mix(docs.repartition(6)).collect()
    brute_taken(rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


# operator 9

def test_quotes_and_threads(spark):
    rows = [(1, 0, "user", "Hello there\nfriend"), (1, 1, "bot", "> Hello  THERE\n> friend\nmy answer"),
            (1, 2, "user", ">> hello there\n>> friend\n> my answer\nthanks"), (1, 3, "bot", "> friend\nlate"), (1, 4, "user", None),
            (2, 0, "user", "> my answer\nnot from here"), (None, 1, "x", "y"), (3, None, "x", "> y"), (1, 3, "bot", "> friend\nlate")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].reply_to, by[1, t].depth, by[1, t].own_text) for t in range(5)] == [
        (None, 0, "Hello there\nfriend"), (0, 1, "my answer"), (1, 2, "thanks"), (0, 1, "late"), (None, 0, "")]
    assert by[1, 2].quote_levels == 2 and by[1, 2].root == 0 and by[2, 0].reply_to is None and by[3, None].depth == 0
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(6))
    long = [(7, t, "u", (f"> message {t - 1}\n" if t else "") + f"message {t}") for t in range(50)]
    deep = quotes.link_quotes(spark.createDataFrame(long, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r.depth, r.position) for r in deep) == [(t, t) for t in range(50)]


TALK = "conv_id bigint, turn bigint, role string, text string"


def brute_links(rows):
    """{(conv, turn, text): (own_text, quote_levels, n_quotes, reply_to)} line by line, all pairs of messages."""
    def lines(text):
        out = []
        for raw in re.split(r"\r\n|\r|\n", text or ""):
            marks = re.match(r"(?:[ \t]*>)*", raw).group()
            out.append((marks.count(">"), raw[len(marks):].removeprefix(" ") if marks else raw, raw))
        return out

    def clean(x):
        return re.sub(r"\s+", " ", x.lower()).strip(" ")

    def runs(ls):
        out = []
        for i, x in enumerate(ls):
            if i and x[0] == ls[i - 1][0]:
                out[-1].append(i)
            else:
                out.append([i])
        return out

    held = {}
    for c, t, _, text in rows:
        if c is not None and t is not None:
            ls = lines(text)
            own = [x[1] for x in ls if x[0] == 0]
            bodies = ["\n".join(own), *own, *("\n".join(ls[i][1] for i in r) for r in runs(ls) if ls[r[0]][0] == 0)]
            held.setdefault(c, []).extend((t, clean(b)) for b in bodies if clean(b))
    links, gone = {}, {}
    for c, t, _, text in rows:
        ls = lines(text)
        for r in runs(ls):
            if ls[r[0]][0] == 0 or c is None or t is None:
                continue
            asked = [(0, "\n".join(ls[i][1] for i in r), r)]
            for k, i in enumerate(r):
                if ls[i][1].strip():
                    tail = next((k + 1 + d for d, j in enumerate(r[k + 1:]) if ls[j][1].strip()), len(r))
                    asked.append((1, ls[i][1], r[k:tail]))
            for part, body, which in asked:
                at = [x for x, b in held[c] if x < t and clean(body) and b == clean(body)]
                if at:
                    gone.setdefault((c, t, text), set()).update(which)
                    links.setdefault((c, t), []).append((ls[r[0]][0], part, -max(at)))
    return {(c, t, text): (
        "\n".join(x[2] for i, x in enumerate(lines(text)) if i not in gone.get((c, t, text), ())).strip(" "),
        max(x[0] for x in lines(text)), sum(1 for r in runs(lines(text)) if lines(text)[r[0]][0] > 0),
        -min(links[c, t])[2] if (c, t) in links else None) for c, t, _, text in rows}


def test_quotes_typed_lines_stay(spark):
    rows = [(1, 0, "u", "How do I count?\nIt is slow"), (1, 1, "b", "> how do I  count?\n>\n> typed here\nuse\n> SELECT 1\n\nbye"),
            (1, 2, "u", "> It is slow\n> How do I count?\n>\nno"), (1, 9000, "b", "> use\nlate"), (1, 9001, "b", "> late\n> > use\nlater"),
            (1, 1, "b", "another version"), (2, 0, "u", ">\n>>\n"), (2, 1, "u", ""), (2, 2, "u", "long " * 50000 + "\n> x" * 3000),
            (None, 1, "u", "> It is slow"), (1, None, "u", "> It is slow")]
    got = quotes.link_quotes(spark.createDataFrame(rows, TALK).selectExpr("*", "1 row", "2 lines", "3 runs", "4 h")).collect()
    by = {(r.conv_id, r.turn): r for r in got if r.own_text != "another version"}
    assert by[1, 1].own_text == "> typed here\nuse\n> SELECT 1\n\nbye" and by[1, 1].reply_to == 0
    assert by[1, 2].own_text == "no" and by[1, 9000].reply_to == 1 and by[1, 9000].own_text == "late"
    assert by[1, 9001].own_text == "later" and by[1, 9001].reply_to == 9000 and by[None, 1].own_text == "> It is slow"
    want = brute_links(rows)
    assert sorted(map(str, ((r.conv_id, r.turn, r.own_text, r.quote_levels, r.n_quotes, r.reply_to) for r in got))) == sorted(
        map(str, ((c, t, *want[c, t, x]) for c, t, _, x in rows)))
    assert quotes.link_quotes(spark.createDataFrame([], TALK)).count() == 0


def test_quotes_against_brute_force(spark):
    m = quotes.quoting_thread(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = [tuple(r) for r in m.select("conv_id", "turn", "role", "text").collect()]
    want = brute_links(rows)
    got = quotes.link_quotes(m).collect()
    assert sorted(map(str, ((r.conv_id, r.turn, r.own_text, r.quote_levels, r.n_quotes, r.reply_to) for r in got))) == sorted(
        map(str, ((c, t, *want[c, t, x]) for c, t, _, x in rows)))


# operator 10

def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(byte_bpe())
    texts = [*ODD, "a  b\t\tc\n\n d 's 'll 99x <|endoftext|> é", "ünï 中文  x y", "×÷ªº½ end ", prose(3, 500)]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id = 3")).union(spark.createDataFrame([(None, "n", "", "", 1, "", "", "")], DOCS))
    folder = tokenfiles.write_tokens(docs, byte_bpe())
    got = tokenfiles.read_tokens(spark, folder).orderBy("start").collect()
    order = [(None, "n"), *sorted([*enumerate(texts), (3, texts[3])], key=lambda x: x[0])]
    start = 0
    for r, (i, x) in zip(got, order, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(docs.where("false"), byte_bpe())).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_").replace("/", "_"))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
    assert docs.count() > 0 and docs.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).distinct().count() == 1
