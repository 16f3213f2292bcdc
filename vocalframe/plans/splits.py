"""Dedup, pairing, splits, folds, seeds and batches over the line corpus
(J1, J2, J10, P10, P12, A10, A17, D1-D11, W1, W2, W4, W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.text import with_normalized
from vocalframe.operators import pairing, splits
from vocalframe.operators.numbering import number_in_groups, number_rows
from vocalframe.operators.permute import original, permuted, permuted_sql
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.sources import fixtures

SEED = 42
PHRASE_EVERY = 8
CONTROL, PATIENT = "src0", "src14"
VAL_SPEAKER, TEST_SPEAKER = "src1", "src2"
BATCH = 8
EPOCHS = 2
FIRST_N = 1000

_LIGHT = f"""k AS (SELECT coalesce(speaker, '') AS speaker, idx, {V.light('text')} AS nrm,
                 len({V.split_words(V.light('text'))}) <= 2 AS short FROM lines)"""


@register("dedup_per_speaker", ("J1", "P10", "T2", "T3"), V.with_views(V.LINES, _LIGHT) + """
SELECT speaker, min(idx) AS idx FROM k WHERE nrm <> '' GROUP BY speaker, short, nrm""")
def dedup_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.dedup_per_speaker(fixtures.lines(spark, sf_dir))


@register("dedup_counts", ("A17", "J1"), V.with_views(V.LINES, _LIGHT) + """,
kept AS (SELECT speaker, min(idx) AS idx FROM k WHERE nrm <> '' GROUP BY speaker, short, nrm),
b AS (SELECT speaker, count(*)::BIGINT AS rows_before FROM lines GROUP BY speaker),
a AS (SELECT speaker, count(*)::BIGINT AS rows_after FROM kept GROUP BY speaker)
SELECT speaker, rows_before, coalesce(rows_after, 0)::BIGINT AS rows_after FROM b LEFT JOIN a USING (speaker)""")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.lines(spark, sf_dir)
    kept = pairing.dedup_per_speaker(lines)
    before = lines.groupBy("speaker").agg(F.count(F.lit(1)).alias("rows_before"))
    after = kept.groupBy("speaker").agg(F.count(F.lit(1)).alias("rows_after"))
    return before.join(after, "speaker", "left").select(
        "speaker", "rows_before", F.coalesce("rows_after", F.lit(0)).cast("bigint").alias("rows_after"))


@register("first_appearance_order", ("J10", "W1", "W4"), V.with_views(V.LINES) + """
SELECT speaker, min(idx) AS first_idx, (row_number() OVER (ORDER BY min(idx)) - 1)::BIGINT AS appearance_rank
FROM lines GROUP BY speaker""")
def first_appearance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = pairing.first_appearance(fixtures.lines(spark, sf_dir), "speaker")
    return number_rows(firsts, ["first_idx"], name="appearance_rank")


@register("phrase_split", ("D4", "W1", "T1"), V.with_views(V.LINES, V.UTT) + f""",
ph AS (SELECT norm, min(idx) AS f FROM utt GROUP BY norm),
num AS (SELECT norm, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS phrase_no FROM ph)
SELECT idx, phrase_no, CASE WHEN phrase_no % {PHRASE_EVERY} = 0 THEN 'validation' ELSE 'train' END AS split
FROM utt JOIN num USING (norm)""")
def phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalframe.session import cut_lineage
    # the normalised lines feed the phrase numbering and the join back: write them
    # once instead of running the regex chain twice
    utt = cut_lineage(with_normalized(fixtures.lines(spark, sf_dir).select("idx", "text"), "text", "norm")
                      .select("idx", "norm"))
    return splits.phrase_split(utt, "norm", PHRASE_EVERY).select("idx", "phrase_no", "split")


@register("transcript_pairs", ("J2", "W2", "T1"), V.with_views(V.LINES, V.UTT) + f""",
pat AS (SELECT norm, min(idx) AS patient_idx FROM utt WHERE speaker = '{PATIENT}' GROUP BY norm)
SELECT u.idx AS control_idx, pat.patient_idx FROM utt u JOIN pat USING (norm) WHERE u.speaker = '{CONTROL}'""")
def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the speaker filters reach the Parquet scan; only those rows are normalised
    lines = fixtures.lines(spark, sf_dir)
    return pairing.pair_transcripts(lines, CONTROL, PATIENT, "norm",
                                    keyed=lambda d: with_normalized(d, "text", "norm"))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out speakers = every speaker whose tier is not 'normal'
    (case-insensitive), numbered in the order of the severity table: by number,
    then by name (D7 seeds use the fold number)."""
    dim = fixtures.severity_dimension(spark, sf_dir)
    dim = dim.withColumn("_n", F.regexp_extract("speaker", r"(\d+)$", 1).cast("int"))
    return splits.resolve_speakers(dim, order=["_n", "speaker"])


@register("loso_folds", ("D1", "D7", "P12", "J4"), V.with_views(V.LINES, V.SEV) + f""",
f AS (SELECT speaker AS held_out, severity,
             (row_number() OVER (ORDER BY regexp_extract(speaker, '(\\d+)$', 1)::INTEGER, speaker))::BIGINT AS fold_no
      FROM sevd WHERE lower(severity) <> 'normal'),
per AS (SELECT speaker, count(*)::BIGINT AS c FROM lines GROUP BY speaker)
SELECT held_out, severity, fold_no, ({SEED} + fold_no - 1)::BIGINT AS fold_seed,
       ((SELECT sum(c) FROM per) - c)::BIGINT AS train_samples, c AS validation_samples
FROM f JOIN per ON per.speaker = f.held_out""")
def loso_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _folds(spark, sf_dir)
    summary = splits.loso_summary(fixtures.lines(spark, sf_dir), folds.drop("severity"), SEED)
    return summary.join(folds.select("held_out", "severity"), "held_out").select(
        "held_out", "severity", "fold_no", F.col("fold_seed").cast("bigint").alias("fold_seed"),
        "train_samples", "validation_samples")


@register("speaker_split_counts", ("D3", "A10"), V.with_views(V.LINES) + f""",
s AS (SELECT speaker, CASE WHEN speaker = '{VAL_SPEAKER}' THEN 'validation'
                           WHEN speaker = '{TEST_SPEAKER}' THEN 'test' ELSE 'train' END AS split FROM lines)
SELECT speaker, count(*) FILTER (WHERE split = 'train')::BIGINT AS train,
       count(*) FILTER (WHERE split = 'validation')::BIGINT AS validation,
       count(*) FILTER (WHERE split = 'test')::BIGINT AS test, count(*)::BIGINT AS total
FROM s GROUP BY speaker""")
def speaker_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalframe.operators.runs import speaker_counts
    df = splits.speaker_split(fixtures.lines(spark, sf_dir), VAL_SPEAKER, TEST_SPEAKER)
    return speaker_counts(df)


@register("ratio_split", ("D5", "D11"), V.with_views(V.LINES).replace("WITH", "WITH RECURSIVE", 1) + f""",
r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM lines),
{permuted_sql('r', SEED)}
SELECT idx, CASE WHEN q < floor(0.8 * n) THEN 'train'
                 WHEN q < floor(0.8 * n) + floor(0.1 * n) THEN 'validation' ELSE 'test' END AS split
FROM r JOIN shuffled USING (p, n)""")
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ratio_split(fixtures.lines(spark, sf_dir).select("idx"), SEED)


@register("first_n", ("D6",), V.with_views(V.LINES) + f"SELECT idx FROM lines ORDER BY idx LIMIT {FIRST_N}")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 is a top-k by position: the limit is the feature."""
    return splits.first_n(fixtures.lines(spark, sf_dir).select("idx"), FIRST_N)


@register("speaker_positions", ("D2",), V.with_views(V.LINES) + """
SELECT speaker, idx, (row_number() OVER (PARTITION BY speaker ORDER BY idx) - 1)::BIGINT AS ordinal FROM lines""")
def speaker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 in long form: (speaker, idx, position within the speaker)."""
    lines = fixtures.lines(spark, sf_dir).select("speaker", "idx")
    return number_in_groups(lines, ["speaker"], ["idx"]).select("speaker", "idx", "ordinal")


@register("epoch_batches", ("D8", "D9", "D10", "W6"), V.with_views(V.LINES) + f""",
p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS position, count(*) OVER () AS n FROM lines)
SELECT idx, e.epoch::BIGINT AS epoch, position::BIGINT AS position,
       ({SEED} + e.epoch * n + position)::BIGINT AS sample_seed, (position // {BATCH})::BIGINT AS batch_id
FROM p, (SELECT unnest(range({EPOCHS})) AS epoch) e""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = number_rows(fixtures.lines(spark, sf_dir).select("idx"), ["idx"], name="position")
    n = pos.count()
    ep = splits.epochs(pos, EPOCHS).withColumn("epoch", F.col("epoch").cast("bigint"))
    return ep.select("idx", "epoch", "position",
                     splits.sample_seed(SEED, F.col("epoch"), n, F.col("position")).cast("bigint").alias("sample_seed"),
                     splits.batch_id(F.col("position"), BATCH).alias("batch_id"))


@register("shuffled_batches", ("D11", "D10"), V.with_views(V.LINES).replace("WITH", "WITH RECURSIVE", 1) + f""",
r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM lines),
{permuted_sql('r', SEED)}
SELECT idx, (q // {BATCH})::BIGINT AS batch_id, p AS position, q AS place FROM r JOIN shuffled USING (p, n)""")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows' places in a seeded shuffle, and back: ``position`` is undone from ``place``."""
    pos = number_rows(fixtures.lines(spark, sf_dir).select("idx"), ["idx"], name="_p")
    n = pos.count()
    placed = pos.select("idx", permuted(F.col("_p"), n, SEED).alias("place"))
    return placed.select("idx", splits.batch_id(F.col("place"), BATCH).alias("batch_id"),
                         original(F.col("place"), n, SEED).alias("position"), "place")


def select_speaker(df: DataFrame, speaker: str, col: str = "speaker") -> DataFrame:
    """Rows whose speaker equals ``speaker`` after Python-style stripping;
    a missing column raises (an empty result is checked by the caller's action)."""
    from vocalframe.functions.text import strip_ws
    if col not in df.columns:
        raise ValueError(f"speaker column {col!r} not found; columns: {df.columns}")
    return df.where(strip_ws(F.col(col).cast("string")) == speaker)


@register("speaker_selection", ("P8", "P9", "J11", "S17"), V.with_views(V.LINES) + """,
sel AS (SELECT 'selected' AS part, lang FROM lines WHERE trim(speaker) = 'src3'),
inc AS (SELECT 'included' AS part, lang FROM lines WHERE speaker IN ('src1', 'src2')),
exc AS (SELECT 'excluded' AS part, lang FROM lines WHERE speaker NOT IN ('src1', 'src2'))
SELECT part, lang, count(*)::BIGINT AS n FROM (SELECT * FROM sel UNION ALL SELECT * FROM inc UNION ALL SELECT * FROM exc)
GROUP BY part, lang""")
def speaker_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 one speaker by trimmed equality; P9 include / exclude lists; J11 the
    row sets concatenated by name; S17 a sharded view."""
    from vocalframe.sources.files import shard
    lines = shard(fixtures.lines(spark, sf_dir).select("speaker", "lang"), 8)
    sel = select_speaker(lines, "src3").select(F.lit("selected").alias("part"), "lang")
    inc = lines.where(F.col("speaker").isin("src1", "src2")).select(F.lit("included").alias("part"), "lang")
    exc = lines.where(~F.col("speaker").isin("src1", "src2")).select(F.lit("excluded").alias("part"), "lang")
    return sel.unionByName(inc).unionByName(exc).groupBy("part", "lang").agg(
        F.count(F.lit(1)).alias("n"))


@register("run_records", ("S18", "D1", "T13"), V.with_views(V.LINES, V.SEV) + f""",
f AS (SELECT speaker AS held_out, severity FROM sevd WHERE lower(severity) <> 'normal'),
per AS (SELECT speaker, count(*)::BIGINT AS c FROM lines GROUP BY speaker)
SELECT held_out, severity, ((SELECT sum(c) FROM per) - c)::INTEGER AS train_samples,
       c::INTEGER AS validation_samples, '{SEED}' AS seed
FROM f JOIN per ON per.speaker = f.held_out""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-fold run-config documents assembled as JSON text by Spark, then
    read back field by field (the sink shape is checked, not its formatting)."""
    from vocalframe.sources.files import run_records as records
    folds = _folds(spark, sf_dir)
    counts = splits.loso_summary(fixtures.lines(spark, sf_dir), folds.drop("severity"), SEED)
    doc = records(folds.select("held_out", "severity"), counts.select("held_out", "train_samples",
                                                                      "validation_samples"),
                  f'{{"seed": "{SEED}"}}')
    schema = ("held_out_speaker string, severity string, train_samples int, "
              "validation_samples int, parameters map<string,string>")
    back = doc.select(F.from_json("run_config", schema).alias("r"))
    return back.select(F.col("r.held_out_speaker").alias("held_out"), "r.severity", "r.train_samples",
                       "r.validation_samples", F.element_at("r.parameters", F.lit("seed")).alias("seed"))
