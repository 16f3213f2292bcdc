"""I-Match fingerprints (operator 4, DataFrame functions only).

Terms are the distinct lower-cased words of a text. The lexicon keeps the terms
whose share of documents df / N lies in ``[low, high]``, that is, whose inverse
document frequency ln(N / df) lies in a chosen band. A term with df >= low * N
can occur at most (distinct terms per document) / low times over, so the lexicon
has at most mean-distinct-terms / low entries however large the corpus is; its
size is counted before it is broadcast.

Each of 32 randomised subsets of the lexicon keeps a term by 16 bits of its hash,
at the rates 1/2, 1/64, 1/256 and 1/1024: the dense ones tell near copies apart,
the sparse ones still agree after larger edits. A subset's signature is the hash
of its terms in sorted order, and the fingerprint lists the 32 signatures. Likeness of two fingerprints is the share of equal signatures
among the subsets in which either text has a term.

The band says little about some texts: near copies that hold a third of all rows have
only terms above it, a language of few documents only terms below it. So a text with
fewer than ``LEAST`` lexicon terms is fingerprinted by terms of its own: about
``SPARE`` of them, those whose hash has enough zero bits, whatever their frequency,
in subsets at the rates 1/2, 1/4, 1/8 and 1/16. A fingerprint of one kind and one of
the other share no signature, but by equal empty subsets, which do not count.

Nulls and odd input: a null text is empty. Without words every signature
is ``--------``; two such fingerprints are alike (1.0) only if the texts are
equal. Repeated rows get equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.order import with_next
from vocalframe.llm.store import keep, spread

SUBSETS = 32
#: Keep a term if the subset's 16 bits of its hash are below this: rates 1/2, 1/64, 1/256 and 1/1024.
DENSE = 2
THRESHOLDS = (1 << 15,) * DENSE + (1 << 10,) * 10 + (1 << 8,) * 10 + (1 << 6,) * 10
NONE = "--------"
#: Lexicon terms that a fingerprint needs; texts with fewer are described by about SPARE terms of their own.
LEAST = 8
SPARE = 64
#: Subsets of own terms: how many hash bits must be zero, per subset.
SPARE_BITS = (1,) * DENSE + (2,) * 10 + (3,) * 10 + (4,) * 10
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct words: runs of letters, digits and non-ASCII characters, ASCII lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.array_distinct(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.002, high: float = 0.2,
            seed: str = "lexicon") -> DataFrame:
    """(term, code): the terms of the band. The low 32 bits of ``code`` say in which
    subsets the term is, the 31 above are its hash."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    band = df.where((F.col("count") >= 2) & (F.col("count") >= low * n) & (F.col("count") <= high * n))
    # written first: a filter on the code alone would move below the aggregation, to every word
    band = keep(band.select("term"))
    h = F.concat(F.sha2(F.concat(F.lit(seed + "|0|"), F.col("term")), 256),
                 F.sha2(F.concat(F.lit(seed + "|1|"), F.col("term")), 256))
    band = band.select("term", h.alias("h"))
    bits = F.zip_with(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.array(*map(F.lit, THRESHOLDS)), lambda k, t: F.when(
        F.conv(F.substring(F.col("h"), 4 * k + 1, F.lit(4)), 16, 10).cast("int") < t, F.pow(F.lit(2.0), k)).otherwise(0.0))
    mask = F.aggregate(bits, F.lit(0.0), lambda x, y: x + y).cast("bigint")
    ident = F.conv(F.substring(F.md5(F.col("term")), 1, 8), 16, 10).cast("bigint") % (1 << 31)
    code = ident * (1 << 32) + mask
    return keep(band.select("term", code.alias("code")).where("code % 4294967296 > 0"))


def let_in(n_terms: Column) -> Column:
    """The hash bits that must be zero for an own term of a text with ``n_terms`` terms to be taken: none
    up to ``SPARE`` terms, one more per doubling. So the sets of texts of similar length are nested."""
    step = F.greatest(F.ceil(F.log2(n_terms / F.lit(SPARE))), F.lit(0)).cast("int")
    return (F.pow(F.lit(2.0), step) - 1).cast("bigint")


def spare_code(term: Column, zero_bits: Column) -> Column:
    """The code of a text's own term, as in ``lexicon``; null for a term that is not let in."""
    h = [F.xxhash64(term, F.lit(k)) for k in range(4)]
    mask, at = F.lit(0).cast("bigint"), 0
    for k, bits in enumerate(SPARE_BITS):
        if at % 60 + bits > 60:
            at += 60 - at % 60
        zero = F.shiftright(h[at // 60], at % 60).bitwiseAND(F.lit((1 << bits) - 1)) == 0
        mask, at = mask + F.when(zero, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")), at + bits
    # the subsets are worked out inside the branch, for the few terms that are let in
    return F.when(h[3].bitwiseAND(zero_bits) == 0, F.shiftrightunsigned(h[2], 33) * (1 << 32) + mask)


def signature(ordered: Column, sparse: Column) -> Column:
    """The fingerprint string of a sorted array of codes; ``sparse`` holds those of its codes
    that are in any subset but the first ``DENSE``."""
    def own(codes: Column, ks: range) -> Column:
        bits = F.array(*[F.lit(1 << k).cast("bigint") for k in ks])
        return F.transform(bits, lambda bit: F.array_join(F.filter(codes, lambda c: c.bitwiseAND(bit) != 0).cast("array<string>"), ","))
    both = F.concat(own(ordered, range(DENSE)), own(sparse, range(DENSE, SUBSETS)))
    return F.array_join(F.transform(both, lambda o: F.when(o == "", NONE).otherwise(F.substring(F.md5(o), 1, 8))), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of equal signatures; ``equal`` decides when neither text has a term."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.struct(
        F.substring(a, 8 * k + 1, F.lit(8)).alias("x"), F.substring(b, 8 * k + 1, F.lit(8)).alias("y")))
    votes = F.aggregate(pairs, F.struct(F.lit(0).alias("same"), F.lit(0).alias("both")), lambda s, p: F.struct(
        (s["same"] + F.when((p["x"] == p["y"]) & (p["x"] != NONE), 1).otherwise(0)).alias("same"),
        (s["both"] + F.when((p["x"] != NONE) | (p["y"] != NONE), 1).otherwise(0)).alias("both")),
        lambda s: F.when(s["both"] > 0, s["same"] / s["both"]).otherwise(0.0))
    return F.when(equal, 1.0).otherwise(votes).cast("double")


def fingerprints(texts: DataFrame, keys: list[str], variants: list[str], words: DataFrame,
                 carried: str | None = None) -> DataFrame:
    """``keys`` plus a fingerprint column ``fp_<v>`` for each text column in ``variants``, and the
    string column ``carried``. Rows with equal keys are one text.

    The terms of a row are exploded and met with the (broadcast) lexicon. The exploded
    rows are narrow: the carried string travels as a row of its own. Rows stay where they
    are when the input is already dealt by ``keys``.
    """
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)

    def tag(i: int, terms_: Column) -> Column:
        return F.transform(terms_, lambda t: F.struct(F.lit(i).alias("v"), t.alias("t")))
    n, few = len(variants), F.lit((1 << SUBSETS) - (1 << DENSE)).cast("bigint")
    held = texts.select(*keys, *([F.col(carried).alias("_carried")] if carried else []), *[terms(F.col(v)).alias(f"_t{i}") for i, v in enumerate(variants)])
    parts = [tag(i, F.col(f"_t{i}")) for i in range(n)]
    if carried:
        parts.append(tag(-1, F.array("_carried")))
    sizes = F.array(*[let_in(F.size(f"_t{i}")) for i in range(n)])
    rows = held.select(*keys, sizes.alias("_sizes"), F.explode_outer(F.concat(*parts)).alias("x"))
    rows = rows.select(*keys, "x.v", F.col("x.t").alias("term"), F.get("_sizes", F.col("x.v")).alias("_n"))
    met = rows.join(words, "term", "left").withColumn("own", spare_code(F.col("term"), F.col("_n")))
    met = met.where("code is not null or own is not null or v is null or v < 0")
    met = met.select(*keys, "v", "code", "own", F.when(F.col("v") < 0, F.col("term")).alias("_carried"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("v") == i, F.col(c)))).alias(f"_{c}{i}") for i in range(n) for c in ("code", "own")]
    out = met.groupBy(*keys).agg(*lists, F.max("_carried").alias("_carried"))
    chosen = [F.when(F.size(f"_code{i}") >= LEAST, F.col(f"_code{i}")).otherwise(F.col(f"_own{i}")).alias(f"_c{i}") for i in range(n)]
    out = out.select(*keys, "_carried", *chosen)
    out = out.select("*", *[F.filter(f"_c{i}", lambda c: c.bitwiseAND(few) != 0).alias(f"_s{i}") for i in range(n)])
    return out.select(*keys, *([F.col("_carried").alias(carried)] if carried else []),
                      *[signature(F.col(f"_c{i}"), F.col(f"_s{i}")).alias(f"fp_{v}") for i, v in enumerate(variants)])


def half_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables keyed by (did, tie), hashes of the id and of the text; one row per different
    (doc_id, text). The first has doc_id, ``n`` (how often the input repeats it), n_chars and the
    keys of the next one in (doc_id, tie) order; the second has text and ``edited``: the last
    floor(n_chars / 2) code points replaced by the first as many of the next."""
    base = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    did = F.xxhash64("doc_id", F.col("doc_id").isNull())
    base = base.select("doc_id", did.alias("did"), F.xxhash64("text").alias("tie"), "text")
    once = base.select("doc_id", "tie", F.length("text").alias("n_chars")).groupBy("doc_id", "tie").agg(
        F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    once = with_next(once, "doc_id", "tie")
    once = keep(once.select("doc_id", did.alias("did"), "tie", "n_chars", "n",
                            F.xxhash64("next_key", F.col("next_key").isNull()).alias("next_did"), "next_tie"))
    if once.where("n > 1").limit(1).count():
        base = base.dropDuplicates(["did", "tie"])
    b = base.select("did", "tie", "text")
    ask = once.select(F.col("next_did").alias("did"), F.col("next_tie").alias("tie"), F.col("did").alias("to_did"),
                      F.col("tie").alias("to_tie"), "n_chars")
    heads = b.join(ask, ["did", "tie"]).select(
        F.col("to_did").alias("did"), F.col("to_tie").alias("tie"), "n_chars",
        F.expr("substring(text, 1, n_chars div 2)").alias("head"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - n_chars div 2)"), F.col("head"))
    return once, b.join(heads, ["did", "tie"]).select("did", "tie", "text", edited.alias("edited"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = 0.002,
                   high: float = 0.2) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    words = lexicon(spread(docs.select(text)), text, low, high)
    once, h = half_edited(docs, doc_id, text)
    h = h.withColumn("digest", F.concat(F.sha2(F.col("edited").cast("binary"), 256),
                                        F.when(F.col("text") == F.col("edited"), "=").otherwise("")))
    fp = keep(fingerprints(h, ["did", "tie"], ["text", "edited"], words, "digest").join(once, ["did", "tie"]))
    other = fp.select(F.col("did").alias("next_did"), F.col("tie").alias("next_tie"), F.col("fp_text").alias("fp_next"))
    out = fp.join(other, ["next_did", "next_tie"]).select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.substring("digest", 1, 64).alias("edited_sha256"),
        F.col("fp_text").alias("fingerprint"), F.col("fp_edited").alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited"), F.length("digest") > 64).alias("near_edited"),
        likeness(F.col("fp_text"), F.col("fp_next"), F.col("tie") == F.col("next_tie")).alias("near_next"), "n")
    return out.withColumn("_r", F.explode(F.expr("sequence(1L, n)"))).drop("n", "_r")
