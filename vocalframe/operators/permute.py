"""A seeded shuffle of positions as a column expression: no sort, no exchange, no list.

``permuted(p, n, seed)`` is a bijection of 0 .. n-1. A position is split into two
digits, of bases a and b with a * b >= n > a * b - a, and goes through a few rounds in
which each digit is shifted by a hash of the other one (a Feistel network over unequal
halves). Positions that land at n or above go round again (cycle walking) until they
land below; that keeps the map a bijection. There are fewer than a such places, so
nearly every position lands at once. Each row is computed on its own, and ``original``
undoes the shuffle, so the row behind any shuffled position is found without a table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Rounds of walking; below 4,096 positions fewer than 64 places lie above n, so these always do.
WALK = 64
PRIME = 2_147_483_647
MOST = 1 << 60


def bases(n: int) -> tuple[int, int]:
    """(a, b): a * b is n or little more."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def round_keys(seed: int | str) -> Iterator[tuple[int, int, int]]:
    """(factor, term, factor) of each half round, from the seed."""
    for k in range(2 * ROUNDS):
        h = hashlib.sha256(f"{seed}|{k}".encode()).digest()
        x, y, z = (int.from_bytes(h[4 * i:4 * i + 4], "big") % (1 << 30) for i in range(3))
        yield x + (1 << 30), y, z + (1 << 30)


def _hash(x: Column, key: Column, base: int) -> Column:
    y = F.pmod(x * key["m"] + key["c"], F.lit(PRIME))
    mixed = F.transform(F.array(y), lambda v: F.pmod(v.bitwiseXOR(F.shiftright(v, 15)) * key["k"], F.lit(PRIME)))[0]
    return F.pmod(mixed, F.lit(base))


def _walk(position: Column, n: int, step) -> Column:
    def finish(x: Column) -> Column:
        lost = F.raise_error(F.lit("no position below n after walking")).cast("bigint")
        return F.when((x >= 0) & (x < n), x).otherwise(lost)
    start = position.cast("bigint")
    inside = F.when((start >= 0) & (start < n), start).otherwise(F.raise_error(F.lit(f"position outside 0..{n - 1}")).cast("bigint"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(inside), lambda x, _: F.when(x < n, x).otherwise(step(x)), finish)
    return F.when(position.isNotNull(), out)


def _keys(seed: int | str, backwards: bool) -> Column:
    pairs = list(zip(*[iter(round_keys(seed))] * 2))
    lit = lambda k: F.struct(*[F.lit(v).cast("bigint").alias(c) for v, c in zip(k, "mck")])
    return F.array(*[F.struct(lit(f).alias("f"), lit(g).alias("g")) for f, g in (reversed(pairs) if backwards else pairs)])


def permuted(position: Column, n: int, seed: int | str) -> Column:
    """The place of ``position`` (0 .. n-1, else an error; null stays null) in the shuffle of ``seed``."""
    if n > MOST:
        raise ValueError(f"at most {MOST} positions")
    a, b = bases(n)

    def step(x: Column) -> Column:
        digits = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), F.pmod(x, F.lit(b)).alias("r"))

        def turn(d: Column, k: Column) -> Column:
            left = F.transform(F.array(F.pmod(d["l"] + _hash(d["r"], k["f"], a), F.lit(a))), lambda v: F.struct(
                v.alias("l"), F.pmod(d["r"] + _hash(v, k["g"], b), F.lit(b)).alias("r")))
            return left[0]
        return F.aggregate(_keys(seed, False), digits, turn, lambda d: d["l"] * b + d["r"])
    return _walk(position, n, step)


def original(place: Column, n: int, seed: int | str) -> Column:
    """The position that ``permuted`` sends to ``place``."""
    if n > MOST:
        raise ValueError(f"at most {MOST} positions")
    a, b = bases(n)

    def step(x: Column) -> Column:
        digits = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), F.pmod(x, F.lit(b)).alias("r"))

        def turn(d: Column, k: Column) -> Column:
            right = F.transform(F.array(F.pmod(d["r"] - _hash(d["l"], k["g"], b), F.lit(b))), lambda v: F.struct(
                F.pmod(d["l"] - _hash(v, k["f"], a), F.lit(a)).alias("l"), v.alias("r")))
            return right[0]
        return F.aggregate(_keys(seed, True), digits, turn, lambda d: d["l"] * b + d["r"])
    return _walk(place, n, step)


def permuted_sql(rows: str, seed: int | str) -> str:
    """DuckDB SQL of the same map over a relation ``rows`` with the columns p (position) and n (rows):
    a recursive walk as ``shuffled(p, n, q)``. For the oracle queries."""
    def mix(x: str, key: tuple[int, int, int], base: str) -> str:
        y = f"(({x} * {key[0]} + {key[1]}) % {PRIME})"
        return f"((xor({y}, {y} >> 15) * {key[2]}) % {PRIME} % {base})"

    def once(source: str) -> str:
        sql = f"SELECT p, n, a, b, x // b AS l, x % b AS r FROM ({source})"
        for f, g in zip(*[iter(round_keys(seed))] * 2):
            sql = f"SELECT p, n, a, b, (l + {mix('r', f, 'a')}) % a AS l, r FROM ({sql})"
            sql = f"SELECT p, n, a, b, l, (r + {mix('l', g, 'b')}) % b AS r FROM ({sql})"
        return f"SELECT p, n, a, b, l * b + r AS x FROM ({sql})"
    start = (f"SELECT p, n, a, (n + a - 1) // a AS b, p AS x FROM "
             f"(SELECT p::BIGINT AS p, n::BIGINT AS n, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM {rows})")
    return (f"walk AS ({once(start)} UNION ALL {once('SELECT * FROM walk WHERE x >= n')}),\n"
            f"shuffled AS (SELECT p, n, x AS q FROM walk WHERE x < n)")
