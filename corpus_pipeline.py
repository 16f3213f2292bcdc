"""The corpus pipeline over ``documents``: each stage's result is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.llm import decontam, langid, mixing, ngram_jaccard, tokenfiles
from vocalframe.llm.queries import byte_bpe
from vocalframe.llm.store import free_name, keep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that a model was learned for; what the models reject goes."""
    held = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    scorer = langid.fit(docs.where(~held))
    name = free_name(docs, "language")
    out = langid.identify(docs, scorer, result=name)
    return out.where(~F.col(name)["rejected"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_jaccard.one_per_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut out of the others."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.decontaminate(docs, bench).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; a document can occur twice or in part."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row per document with its offset, length and checksum."""
    folder = tokenfiles.write_tokens(docs, byte_bpe())
    return tokenfiles.read_tokens(spark, folder, digest_only=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: SQL can express neither the language models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; every stage works on all its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
