"""The registered ``opN_*`` queries: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.llm import (decontam, fm, imatch, langid, mixing, ngram_jaccard, packing, quotes, resample, tokenfiles, url_rules,
                            warc, whitening)
from vocalframe.llm.oracles import ORACLES  # noqa: F401
from vocalframe.llm.store import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Fixed values of the contract: (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@_query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url under the rules and its alias group."""
    out = url_rules.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "via")


@_query
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its half-edited text, and their likeness."""
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


@_query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply links and clean texts of the conversations, written as quoting threads."""
    return quotes.link_quotes(quotes.quoting_thread(table(spark, sf_dir, "conversations")))


def byte_bpe() -> str:
    """The public tokenizer file; a path that is the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, lengths and checksums of every document's ids, read back from the token files."""
    folder = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), byte_bpe())
    return tokenfiles.read_tokens(spark, folder, digest_only=True)


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document, by windows of 13 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = decontam.scan(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return s.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.col("scan.n_hit").alias("n_hit"),
        F.size("scan.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("scan.items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated(F.col("scan.n_hit"), F.col("scan.n_words")).alias("contaminated"))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; every fourth document (by crc32 of its id) is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    scorer = langid.fit(docs.where(~held))
    out = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), scorer)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
                      F.col("language.cross_entropy").alias("cross_entropy"), F.col("language.rejected").alias("rejected"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; every fifth document (by crc32 of its id) is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    machine = fm.fit(docs, labels.where(~held))
    out = fm.score(docs.withColumn("held_out", held), machine)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, payloads checked against their digests."""
    folder = shared_folder(spark)
    warc.archive(table(spark, sf_dir, "pages"), folder)
    r = warc.read_archive(spark, folder)
    return r.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    warc.page_of(F.col("refers_to")).alias("refers_to"))


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every document at Jaccard 0.8 over five-word shingles."""
    out = ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark texts, and the five percent drawn by it."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, bench).select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document, in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))
