"""Feature-matrix arrays: channel masks, shuffles, divergences.

A feature matrix is ``ARRAY<ARRAY<FLOAT>>`` (channel-major). Randomness comes
from md5-based draws of (seed, keys...) so results are reproducible and
independent of partitioning; per-batch draws take the batch id as their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.operators.splits import hash_draw

# The reference's per-channel drop probabilities for its
# 80-channel importance mask, in channel order.
IMPORTANCE_DROP = [
    0.1931, 0.1171, 0.1171, 0.3183, 0.1931, 0.1931, 0.3183, 0.1931, 0.1931,
    0.1931, 0.1931, 0.1931, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171,
    0.1171, 0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.0710,
    0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.1171, 0.0710, 0.1171, 0.0710,
    0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171,
    0.1171, 0.1171, 0.1171, 0.1171, 0.1931, 0.1931, 0.1171, 0.1171, 0.1171,
    0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.0710,
    0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.0710, 0.1171, 0.1171, 0.1171,
    0.1171, 0.1171, 0.1171, 0.1171, 0.1171, 0.1931, 0.1171, 0.5248,
]

U32 = 4294967296.0


def channel_keep(groups: Column, bits: int, c: Column) -> Column:
    """M1 for one channel: bit (c mod bits) of groups[c div bits] (little-endian)."""
    r = F.element_at(groups, (c / bits).cast("int") + 1)
    return F.getbit(r, (c % bits).cast("int")).cast("int")


def apply_channel_mask(mel: Column, groups: Column, bits: int) -> Column:
    """M1: zero every channel whose mask bit is 0."""
    return F.transform(mel, lambda row, c: F.when(channel_keep(groups, bits, c) == 1, row)
                       .otherwise(F.transform(row, lambda x: F.lit(0.0).cast("float"))))


def mask_groups(seed: int, key: Column, n_groups: int, bits: int, salt: str = "m") -> Column:
    """M2: per (row, group) integers uniform in [1, 2^bits - 2] (never all on/off)."""
    span = (1 << bits) - 2
    return F.transform(F.sequence(F.lit(0), F.lit(n_groups - 1)),
                       lambda g: (hash_draw(F.lit(str(seed)), F.lit(salt), key, g) % span + 1).cast("int"))


def advantage_groups(a: Column, b: Column) -> Column:
    """M3: per group, the draw with more set bits; ties take the second."""
    return F.zip_with(a, b, lambda x, y: F.when(F.bit_count(x) > F.bit_count(y), x).otherwise(y))


def complementary_views(mel: Column, groups: Column, bits: int) -> tuple[Column, Column]:
    """M4: (mask * x, (1 - mask) * x): the two views sum to x."""
    full = (1 << bits) - 1
    inv = F.transform(groups, lambda r: F.lit(full) - r)
    return apply_channel_mask(mel, groups, bits), apply_channel_mask(mel, inv, bits)


def local_shuffle_order(seed: int, key: Column, channels: int, window: int) -> Column:
    """M5: channel order after shuffling inside fixed windows, independently per
    row (sort channels by (window, draw))."""
    if channels % window:
        raise ValueError("channel count must be a multiple of the window size")
    cs = F.sequence(F.lit(0), F.lit(channels - 1))
    keyed = F.transform(cs, lambda c: F.struct((c / window).cast("int").alias("w"),
                                               hash_draw(F.lit(str(seed)), key, c).alias("h"),
                                               c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def group_shuffle_order(seed: int, batch: Column, group_sizes: list[int]) -> Column:
    """M6: permutation inside given channel groups, the same for a whole batch."""
    bounds, acc = [], 0
    for g in group_sizes:
        acc += g
        bounds.append(acc)
    channels = acc
    cs = F.sequence(F.lit(0), F.lit(channels - 1))
    arr = F.array(*[F.lit(b) for b in bounds])
    keyed = F.transform(cs, lambda c: F.struct(F.size(F.filter(arr, lambda b: b <= c)).alias("g"),
                                               hash_draw(F.lit(str(seed)), batch, c).alias("h"),
                                               c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def reorder(mel: Column, order: Column) -> Column:
    """M5 / M6 applied: the matrix with its channels in ``order``; another number of channels raises."""
    lost = F.raise_error(F.lit("order and matrix differ in their channels")).cast("array<int>")
    return F.transform(F.when(F.size(mel) == F.size(order), order).otherwise(lost), lambda c: F.element_at(mel, c + 1))


def keep_channels(mel: Column, keep: Column) -> Column:
    """M7 / M8 applied: channels whose ``keep`` is 0 become zero; another number of channels raises."""
    lost = F.raise_error(F.lit("mask and matrix differ in their channels")).cast("array<int>")
    same = F.when(F.size(mel) == F.size(keep), keep).otherwise(lost)
    return F.zip_with(mel, same, lambda row, k: F.when(k == 1, row).otherwise(F.transform(row, lambda x: F.lit(0.0).cast("float"))))


def span_keep(start: Column, length: Column, channels: int) -> Column:
    """M8: 0 for the channels of a span, 1 for the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.when((c >= start) & (c < start + length), 0).otherwise(1))


def importance_keep(seed: int, batch: Column, channels: int, probs: list[float] | None = None) -> Column:
    """M7: one Bernoulli draw per (batch, channel); channel kept with 1 - p."""
    probs = probs or IMPORTANCE_DROP
    if len(probs) != channels:
        raise ValueError(f"expected {len(probs)} channels, got {channels}")
    p = F.array(*[F.lit(x) for x in probs])
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)),
                       lambda c: (hash_draw(F.lit(str(seed)), F.lit("imp"), batch, c) / U32
                                  >= F.element_at(p, c + 1)).cast("int"))


def contiguous_mask_span(seed: int, batch: Column, key: Column, channels: int,
                         max_ratio: float = 0.25) -> tuple[Column, Column]:
    """M8: span length uniform in [1, max(1, floor(C*ratio))] per batch, start
    uniform in [0, C - length] per row."""
    top = max(1, int(channels * max_ratio))
    length = (hash_draw(F.lit(str(seed)), F.lit("len"), batch) % top + 1).cast("int")
    start = (hash_draw(F.lit(str(seed)), F.lit("start"), key) % (F.lit(channels) - length + 1)).cast("int")
    return start, length


def with_log_softmax(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Stable log-softmax of an array column; the normaliser is computed once per
    row (bound), not once per element."""
    from vocalframe.functions.bind import bind
    x = F.col(src)
    out = bind(df, {"_mx": F.array_max(x)})
    out = bind(out, {"_lse": F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_mx"))))
                     + F.col("_mx")})
    return bind(out, {dst: F.transform(x, lambda v: v - F.col("_lse"))}, drop=("_mx", "_lse"))


def jsd_from_log(lp: Column, lq: Column) -> Column:
    """M9 for one row from log-probabilities: 0.5 * (KL(p||m) + KL(q||m))."""
    def term(a, b):
        p, q = F.exp(a), F.exp(b)
        lm = F.log(0.5 * (p + q))
        return 0.5 * (p * (a - lm) + q * (b - lm))
    return F.aggregate(F.zip_with(lp, lq, term), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return dot / (na * nb)


def consistency_term(h1: Column, h2: Column) -> Column:
    """M10 per row: log(clamp(1 - cos(h1, h2), 0.01, 2)); the batch mean is an avg."""
    return F.log(F.least(F.greatest(F.lit(1.0) - cosine(h1, h2), F.lit(0.01)), F.lit(2.0)))


def combine_loss(a: Column, b: Column, consistency: Column, weight: float, guard: bool = True) -> Column:
    """0.5 * (a + b) + weight * consistency, non-finite parts -> 0."""
    def g(c):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c) if guard else c
    return 0.5 * (g(a) + g(b)) + F.lit(weight) * g(consistency)
