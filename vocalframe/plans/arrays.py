"""Array plans over ``embeddings`` (waveforms, feature matrices, logits) and
label sequences over the line corpus (P2-P5, X2-X5, X10, M1-M11, L1-L5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalframe.functions.bind import bind
from vocalframe.functions.text import with_normalized, words
from vocalframe.operators import labels as L
from vocalframe.operators import spectral as M
from vocalframe.operators import waveform as X
from vocalframe.operators.numbering import number_rows
from vocalframe.operators.splits import hash_draw
from vocalframe.plans import oracle_views as V
from vocalframe.plans.registry import register
from vocalframe.sources import fixtures
from vocalframe.sources.tables import table

SEED = 42
RATES = [8000, 16000, 22050]
CH, FR, BITS, WINDOW = 8, 8, 4, 4
GROUP_SIZES = [2, 4, 2]
MAX_S = 0.004


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 64-sample waveforms at 8, 16 or 22.05 kHz (by vec_id % 3)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rate = F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select("vec_id", F.col("embedding").alias("samples"), rate.alias("sampling_rate"),
                    (F.col("vec_id") / 4).cast("bigint").alias("batch_id"))


def mel(samples: Column) -> Column:
    """The same 64 values as 8 channels x 8 frames (channel-major)."""
    return F.transform(F.sequence(F.lit(0), F.lit(CH - 1)), lambda c: F.slice(samples, c * FR + 1, FR))


def fmt(arr: Column, d: int = 5) -> Column:
    """Fixed decimals of the exact value (round first: Java's %f alone rounds
    the shortest decimal form, which differs from Python/DuckDB at ties)."""
    # + 0.0 turns a rounded -0.0 into 0.0 (engines differ on the sign of zero)
    return F.array_join(F.transform(arr, lambda x: F.format_string(f"%.{d}f", F.round(x.cast("double"), d) + 0.0)), ",")


def ints(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


# ---- DuckDB side ---------------------------------------------------------
def dfmt(x: str, d: int = 5) -> str:
    return f"array_to_string(list_transform({x}, lambda v: format('{{:.{d}f}}', round(v::DOUBLE, {d}) + 0.0)), ',')"


def ddraw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


WAVE = f"""w AS (SELECT vec_id, embedding AS s, {RATES}[vec_id % 3 + 1] AS sr, vec_id // 4 AS batch_id FROM embeddings)"""

_INTERP = ("list_transform(range(m), lambda i: (s[floor(i * st)::INTEGER + 1]::DOUBLE + (i * st - floor(i * st)) * "
           "(s[least(floor(i * st)::INTEGER + 2, n)]::DOUBLE - s[floor(i * st)::INTEGER + 1]::DOUBLE))::FLOAT)")


@register("waveform_resample", ("X3", "P2"), V.with_views(WAVE) + f""",
r AS (SELECT *, len(s) AS n, round_even(len(s) * 16000.0::DOUBLE / sr, 0)::INTEGER AS m FROM w),
q AS (SELECT *, CASE WHEN m > 1 THEN (n - 1)::DOUBLE / (m - 1) ELSE 0.0 END AS st FROM r)
SELECT vec_id, m AS n_out, CASE WHEN sr = 16000 THEN {dfmt('s')} ELSE {dfmt(_INTERP)} END AS vals FROM q""")
def waveform_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wave(spark, sf_dir)
    return w.select("vec_id", X.resampled_length(F.size("samples"), F.col("sampling_rate")).alias("n_out"),
                    fmt(X.resample(F.col("samples"), F.col("sampling_rate"))).alias("vals"))


@register("waveform_ops", ("X2", "X4", "X5", "X10", "P3", "P4", "P5"), V.with_views(WAVE) + f""",
d AS (SELECT *, {ddraw("'42'", "'tm'", "vec_id::VARCHAR")} % 56 AS st FROM w)
SELECT vec_id, round(len(s) / sr, 9) AS duration, len(s) / sr <= 30 AS under_30s,
       round_even(len(s) * 16000.0::DOUBLE / sr, 0) <= {int(MAX_S * 16000)} AS short_enough,
       {dfmt("list_transform(range(32), lambda i: ((s[i + 1]::DOUBLE + s[i + 33]::DOUBLE) / 2)::FLOAT)")} AS mono,
       {dfmt("list_transform(s, lambda x: greatest(-1.0, least(1.0, x::DOUBLE * 3))::FLOAT)")} AS clipped,
       {dfmt("(s || list_transform(range(100), lambda x: 0.0))[1:100]")} AS padded,
       {dfmt("s[1:48]")} AS trimmed,
       {dfmt("list_transform(s, lambda x, i: CASE WHEN i - 1 >= st AND i - 1 < st + 8 THEN 0.0 ELSE x END)")} AS masked
FROM d""")
def waveform_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wave(spark, sf_dir)
    s, sr = F.col("samples"), F.col("sampling_rate")
    stereo = F.array(F.slice(s, 1, 32), F.slice(s, 33, 32))
    start = hash_draw(F.lit(str(SEED)), F.lit("tm"), F.col("vec_id")) % 56
    return w.select(
        "vec_id", F.round(X.duration_seconds(s, sr), 9).alias("duration"),
        (X.duration_seconds(s, sr) <= 30).alias("under_30s"),
        X.short_enough(s, sr, MAX_S).alias("short_enough"),
        fmt(F.transform(X.mono(stereo), lambda v: v.cast("float"))).alias("mono"),
        fmt(X.clip(F.transform(s, lambda x: x.cast("double") * 3))).alias("clipped"),
        fmt(X.pad_or_trim(s, 100)).alias("padded"),
        fmt(X.pad_or_trim(s, 48)).alias("trimmed"),
        fmt(X.time_mask(s, start, F.lit(8))).alias("masked"))


def _dgroups(salt: str) -> str:
    return f"list_transform(range(2), lambda g: ({ddraw(repr(str(SEED)), repr(salt), 'vec_id::VARCHAR', 'g::VARCHAR')} % 14) + 1)"


@register("channel_masks", ("M1", "M2", "M3", "M4"), V.with_views(WAVE) + f""",
g AS (SELECT *, {_dgroups('m')} AS r1, {_dgroups('n')} AS r2 FROM w),
a AS (SELECT *, list_transform(range(2), lambda i: CASE WHEN bit_count(r1[i + 1]) > bit_count(r2[i + 1])
                                                   THEN r1[i + 1] ELSE r2[i + 1] END) AS adv FROM g),
k AS (SELECT *, list_transform(range({CH}), lambda c: (adv[c // {BITS} + 1] >> (c % {BITS})) & 1) AS keep FROM a)
SELECT vec_id, array_to_string(r1, ',') AS groups, array_to_string(adv, ',') AS adv_groups,
       array_to_string(keep, '') AS kept,
       {dfmt(f"list_transform(range({CH}), lambda c: CASE WHEN keep[c + 1] = 1 THEN s[c * {FR} + 1] ELSE 0.0 END)")} AS view1_frame0,
       {dfmt(f"list_transform(range({CH}), lambda c: CASE WHEN keep[c + 1] = 0 THEN s[c * {FR} + 1] ELSE 0.0 END)")} AS view2_frame0
FROM k""")
def channel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wave(spark, sf_dir).withColumn("mel", mel(F.col("samples")))
    r1 = M.mask_groups(SEED, F.col("vec_id"), CH // BITS, BITS, "m")
    r2 = M.mask_groups(SEED, F.col("vec_id"), CH // BITS, BITS, "n")
    w = w.withColumns({"r1": r1, "adv": M.advantage_groups(r1, r2)})
    v1, v2 = M.complementary_views(F.col("mel"), F.col("adv"), BITS)
    keep = F.transform(F.sequence(F.lit(0), F.lit(CH - 1)), lambda c: M.channel_keep(F.col("adv"), BITS, c))
    return w.select("vec_id", ints(F.col("r1")).alias("groups"), ints(F.col("adv")).alias("adv_groups"),
                    F.array_join(F.transform(keep, lambda x: x.cast("string")), "").alias("kept"),
                    fmt(F.transform(v1, lambda row: F.element_at(row, 1))).alias("view1_frame0"),
                    fmt(F.transform(v2, lambda row: F.element_at(row, 1))).alias("view2_frame0"))


@register("channel_shuffles", ("M5", "M6"), V.with_views(WAVE) + f"""
SELECT vec_id,
  array_to_string(list_transform(list_sort(list_transform(range({CH}), lambda c:
     {{'w': c // {WINDOW}, 'h': {ddraw(repr(str(SEED)), 'vec_id::VARCHAR', 'c::VARCHAR')}, 'c': c}})), lambda x: x.c), ',') AS local_order,
  array_to_string(list_transform(list_sort(list_transform(range({CH}), lambda c:
     {{'g': len(list_filter({[sum(GROUP_SIZES[:i + 1]) for i in range(len(GROUP_SIZES))]}, lambda b: b <= c)),
      'h': {ddraw(repr(str(SEED)), 'batch_id::VARCHAR', 'c::VARCHAR')}, 'c': c}})), lambda x: x.c), ',') AS group_order
FROM w""")
def channel_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wave(spark, sf_dir)
    return w.select("vec_id",
                    ints(M.local_shuffle_order(SEED, F.col("vec_id"), CH, WINDOW)).alias("local_order"),
                    ints(M.group_shuffle_order(SEED, F.col("batch_id"), GROUP_SIZES)).alias("group_order"))


@register("importance_span_masks", ("M7", "M8"), V.with_views(WAVE) + f""",
sp AS (SELECT *, ({ddraw(repr(str(SEED)), "'len'", 'batch_id::VARCHAR')} % 2 + 1)::INTEGER AS len FROM w),
sp2 AS (SELECT *, ({ddraw(repr(str(SEED)), "'start'", 'vec_id::VARCHAR')} % ({CH} - len + 1))::INTEGER AS start FROM sp)
SELECT vec_id,
  array_to_string(list_transform(range(80), lambda c:
     ({ddraw(repr(str(SEED)), "'imp'", 'batch_id::VARCHAR', 'c::VARCHAR')} / 4294967296.0 >= {M.IMPORTANCE_DROP}[c + 1])::INTEGER), '') AS importance_kept,
  start, len AS length,
  array_to_string(list_transform(range({CH}), lambda c: CASE WHEN c >= start AND c < start + len THEN 0 ELSE 1 END), '') AS span_kept
FROM sp2""")
def importance_span_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 on an 80-channel view (the 64 values repeated to 80 channels of one
    frame), M8 on the 8-channel view."""
    w = wave(spark, sf_dir)
    keep = M.importance_keep(SEED, F.col("batch_id"), 80)
    start, length = M.contiguous_mask_span(SEED, F.col("batch_id"), F.col("vec_id"), CH)
    w = w.withColumns({"start": start, "length": length})
    span = F.transform(F.sequence(F.lit(0), F.lit(CH - 1)), lambda c: F.when(
        (c >= F.col("start")) & (c < F.col("start") + F.col("length")), F.lit(0)).otherwise(F.lit(1)))
    return w.select("vec_id", F.array_join(F.transform(keep, lambda x: x.cast("string")), "").alias("importance_kept"),
                    "start", "length",
                    F.array_join(F.transform(span, lambda x: x.cast("string")), "").alias("span_kept"))


def _flat(order_or_keep: str, masked: bool) -> str:
    """The whole matrix, channel by channel: ``s`` in a channel order, or with channels zeroed."""
    value = (f"CASE WHEN ({order_or_keep})[i // {FR} + 1] = 1 THEN s[i + 1] ELSE 0.0 END" if masked else
             f"s[({order_or_keep})[i // {FR} + 1] * {FR} + i % {FR} + 1]")
    return dfmt(f"list_transform(range({CH * FR}), lambda i: {value})")


_WHOLE = f"""g AS (SELECT *, {_dgroups('m')} AS r1, {_dgroups('n')} AS r2 FROM w),
a AS (SELECT *, list_transform(range(2), lambda i: CASE WHEN bit_count(r1[i + 1]) > bit_count(r2[i + 1]) THEN r1[i + 1] ELSE r2[i + 1] END) AS adv,
             ({ddraw(repr(str(SEED)), "'len'", 'batch_id::VARCHAR')} % 2 + 1)::INTEGER AS len FROM g),
b AS (SELECT *, list_transform(range({CH}), lambda c: (adv[c // {BITS} + 1] >> (c % {BITS})) & 1) AS keep,
             list_transform(range({CH}), lambda c: 1 - ((adv[c // {BITS} + 1] >> (c % {BITS})) & 1)) AS drop_,
             ({ddraw(repr(str(SEED)), "'start'", 'vec_id::VARCHAR')} % ({CH} - len + 1))::INTEGER AS start,
  list_transform(list_sort(list_transform(range({CH}), lambda c:
     {{'w': c // {WINDOW}, 'h': {ddraw(repr(str(SEED)), 'vec_id::VARCHAR', 'c::VARCHAR')}, 'c': c}})), lambda x: x.c) AS local_,
  list_transform(list_sort(list_transform(range({CH}), lambda c:
     {{'g': len(list_filter({[sum(GROUP_SIZES[:i + 1]) for i in range(len(GROUP_SIZES))]}, lambda b: b <= c)),
      'h': {ddraw(repr(str(SEED)), 'batch_id::VARCHAR', 'c::VARCHAR')}, 'c': c}})), lambda x: x.c) AS group_,
  list_transform(range(80), lambda c: ({ddraw(repr(str(SEED)), "'imp'", 'batch_id::VARCHAR', 'c::VARCHAR')} / 4294967296.0 >= {M.IMPORTANCE_DROP}[c + 1])::INTEGER) AS imp
  FROM a),
m AS (SELECT *, list_transform(range({CH}), lambda c: CASE WHEN c >= start AND c < start + len THEN 0 ELSE 1 END) AS span FROM b)"""


@register("feature_matrices", ("M1", "M4", "M5", "M6", "M7", "M8"), V.with_views(WAVE, _WHOLE) + f"""
SELECT vec_id, {_flat('keep', True)} AS masked_view, {_flat('drop_', True)} AS other_view, {_flat('local_', False)} AS local_shuffled,
       {_flat('group_', False)} AS group_shuffled, {_flat('span', True)} AS span_masked,
       {dfmt("list_transform(range(160), lambda i: CASE WHEN imp[i // 2 + 1] = 1 THEN s[i % 64 + 1] ELSE 0.0 END)")} AS importance_masked
FROM m""")
def feature_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrices that masks and shuffles make of every feature matrix, channel by channel; the
    importance mask on an 80-channel matrix of two frames."""
    w = wave(spark, sf_dir).withColumn("mel", mel(F.col("samples")))
    groups = M.advantage_groups(M.mask_groups(SEED, F.col("vec_id"), CH // BITS, BITS, "m"), M.mask_groups(SEED, F.col("vec_id"), CH // BITS, BITS, "n"))
    tall = F.transform(F.sequence(F.lit(0), F.lit(79)), lambda c: F.transform(F.array(F.lit(0), F.lit(1)), lambda t: F.element_at(
        "samples", (c * 2 + t) % 64 + 1)))
    start, length = M.contiguous_mask_span(SEED, F.col("batch_id"), F.col("vec_id"), CH)
    # draws are bound to columns first, so each is made once a row
    w = bind(w, {"_adv": groups, "_tall": tall, "_local": M.local_shuffle_order(SEED, F.col("vec_id"), CH, WINDOW),
                 "_group": M.group_shuffle_order(SEED, F.col("batch_id"), GROUP_SIZES), "_imp": M.importance_keep(SEED, F.col("batch_id"), 80),
                 "_start": start, "_length": length})
    view, other = M.complementary_views(F.col("mel"), F.col("_adv"), BITS)
    whole = {"masked_view": view, "other_view": other, "local_shuffled": M.reorder(F.col("mel"), F.col("_local")),
             "group_shuffled": M.reorder(F.col("mel"), F.col("_group")), "importance_masked": M.keep_channels(F.col("_tall"), F.col("_imp")),
             "span_masked": M.keep_channels(F.col("mel"), M.span_keep(F.col("_start"), F.col("_length"), CH))}
    return w.select("vec_id", *[fmt(F.flatten(c)).alias(k) for k, c in whole.items()])


_LSM = ("list_transform({x}, lambda v: v::DOUBLE - (ln(list_sum(list_transform({x}, lambda u: exp(u::DOUBLE - list_max({x})::DOUBLE)))) "
        "+ list_max({x})::DOUBLE))")


@register("divergences", ("M9", "M10", "M11", "P15"), V.with_views(WAVE) + f""",
l AS (SELECT vec_id, batch_id, {_LSM.format(x='s')} AS lp, {_LSM.format(x='list_reverse(s)')} AS lq,
             s, list_reverse(s) AS t FROM w),
r AS (SELECT vec_id, batch_id,
        list_sum(list_transform(range(len(lp)), lambda i: 0.5 * (
            exp(lp[i + 1]) * (lp[i + 1] - ln(0.5 * (exp(lp[i + 1]) + exp(lq[i + 1]))))
          + exp(lq[i + 1]) * (lq[i + 1] - ln(0.5 * (exp(lp[i + 1]) + exp(lq[i + 1]))))))) AS jsd,
        ln(least(greatest(1.0 - list_sum(list_transform(range(len(s)), lambda i: s[i + 1]::DOUBLE * t[i + 1]::DOUBLE))
             / (sqrt(list_sum(list_transform(s, lambda v: v::DOUBLE * v::DOUBLE)))
                * sqrt(list_sum(list_transform(t, lambda v: v::DOUBLE * v::DOUBLE)))), 0.01), 2.0)) AS cons
      FROM l)
SELECT batch_id, round(avg(jsd), 6) AS jsd, round(avg(cons), 6) AS consistency,
       round(0.5 * (avg(jsd) + avg(jsd)) + 0.5 * avg(cons), 6) AS combined
FROM r GROUP BY batch_id""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 Jensen-Shannon divergence and M10 cosine consistency between each
    row's logits (the embedding) and its reversal, batch means; M11 combines."""
    from vocalframe.functions.bind import bind
    w = wave(spark, sf_dir)
    w = bind(w, {"s": F.transform("samples", lambda v: v.cast("double"))})
    w = bind(w, {"t": F.reverse("s")})
    w = M.with_log_softmax(w, "s", "lp")
    w = M.with_log_softmax(w, "t", "lq")
    r = w.select("batch_id", M.jsd_from_log(F.col("lp"), F.col("lq")).alias("jsd"),
                 M.consistency_term(F.col("s"), F.col("t")).alias("cons"))
    g = r.groupBy("batch_id").agg(F.avg("jsd").alias("jsd"), F.avg("cons").alias("cons"))
    return g.select("batch_id", F.round("jsd", 6).alias("jsd"), F.round("cons", 6).alias("consistency"),
                    F.round(M.combine_loss(F.col("jsd"), F.col("jsd"), F.col("cons"), 0.5), 6).alias("combined"))


# ---- label sequences -------------------------------------------------------
LBATCH = 8

_VOCAB = f"""bw AS (SELECT DISTINCT unnest({V.split_words(V.t1('text'))}) AS word FROM benchmark),
vocab AS (SELECT word, (row_number() OVER (ORDER BY word) - 1 + 4)::INTEGER AS id FROM bw)"""

_ENC = """ex AS (SELECT idx, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok),
enc AS (SELECT idx, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM ex LEFT JOIN vocab v USING (word) GROUP BY idx),
s AS (SELECT t.idx, CASE WHEN len(t.w) >= 3 THEN [1] || coalesce(e.ids, []::INTEGER[]) ELSE coalesce(e.ids, []::INTEGER[]) END AS ids,
             ((row_number() OVER (ORDER BY t.idx) - 1) // 8)::BIGINT AS batch_id
      FROM tok t LEFT JOIN enc e USING (idx)),
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx,
             bool_and(coalesce(ids[1] = 1, false)) OVER (PARTITION BY batch_id) AS all_start FROM s),
lab AS (SELECT idx, batch_id, all_start,
               CASE WHEN all_start AND mx > 0 THEN (ids || list_transform(range(mx - len(ids)), lambda x: -100))[2:]
                    ELSE ids || list_transform(range(mx - len(ids)), lambda x: -100) END AS labels FROM b)"""


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vocab = L.build_vocabulary(with_normalized(table(spark, sf_dir, "benchmark", "item_id", "text"),
                                               "text", "norm"), "norm")
    utt = with_normalized(fixtures.lines(spark, sf_dir).select("idx", "text"), "text", "norm")
    enc = L.encode(utt, "norm", vocab, with_start=F.size(words(F.col("norm"))) >= 3, keep=["idx"])
    pos = number_rows(enc, ["idx"], name="_p")
    return pos.withColumn("batch_id", (F.col("_p") / LBATCH).cast("bigint")).drop("_p"), vocab


@register("label_batches", ("L1", "L2", "L3", "L4", "D10"),
          V.with_views(V.LINES, V.UTT, V.TOK, _VOCAB, _ENC) + """
SELECT idx, batch_id, all_start AS drop_start, array_to_string(labels, ',') AS labels,
       array_to_string(list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ',') AS label_ids
FROM lab""")
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, _ = _encoded(spark, sf_dir)
    b = L.pad_batch(enc)
    return b.select("idx", "batch_id", "drop_start", ints(F.col("labels")).alias("labels"),
                    ints(L.ignore_to_pad()).alias("label_ids"))


@register("label_decode", ("L5", "L1"), V.with_views(V.LINES, V.UTT, V.TOK, _VOCAB) + """,
ex AS (SELECT idx, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok),
dec AS (SELECT idx, string_agg(word, ' ' ORDER BY pos) AS text FROM ex JOIN vocab USING (word) GROUP BY idx)
SELECT t.idx, coalesce(d.text, '') AS text FROM tok t LEFT JOIN dec d USING (idx)""")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc, vocab = _encoded(spark, sf_dir)
    return L.decode(enc, "ids", vocab)
