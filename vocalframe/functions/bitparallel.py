"""Batched bit-parallel Levenshtein distance (Myers 1999 / Hyyrö 2001) in numpy.

The shorter sequence of each pair is the bit-vector "pattern", cut into blocks of 64
rows; the longer one is scanned. Every block of every pair of a group is one lane of
flat uint64 arrays. Blocks of a pair run one symbol behind each other, so a block gets
the horizontal difference of the block above from the step before, and no carry crosses
lanes. Pairs of a group are ordered by the step they end at and leave the arrays then:
lengths need no padding.

Only a band of the table is computed: an alignment of cost k leaves the diagonals between
the two corners by (k - n + m) / 2 at most, so a block scans the columns that its rows can
meet there. Cells at the band's rim count as reached by insertions or deletions alone, so a
result never is too small, and one of at most k is exact; others are computed again with
the result as their k.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_ONE = np.uint64(1)
_SH63 = np.uint64(63)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

# Lanes and match-table entries of a group (a single larger pair is a group of its own): its arrays fit in 1 MB of cache.
GROUP_LANES = 4096
GROUP_ENTRIES = 1 << 22
# Steps after which blocks enter and leave the band, and symbols after which rows do for Python integers.
SPELL, STRIDE = 64, 256
# Measured seconds: a step of a group, a lane's step, a symbol scanned by Python integers, and its work per 64 rows.
STEP, LANE, SYMBOL, BLOCK = 3e-5, 2.5e-8, 1.6e-6, 3e-8


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` (of 0 .. size - 1) in order, and every key's place among them."""
    if size > 4 * len(keys) + 65_536:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, dtype=bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def _steps_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them) for every i, one behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def _group_distances(pat: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Distances, exact up to ``k`` (n - m at least), of pairs with 0 < m <= n: symbols (non-negative
    integers) of all patterns and of all texts one behind the other, and their lengths; pairs by
    falling n + blocks."""
    p, blocks = len(m), (m + 63) // 64
    pair_p, pair_t = np.repeat(np.arange(p), m), np.repeat(np.arange(p), n)
    _, sym = _numbered(np.concatenate([pat, text]), int(max(pat.max(), text.max())) + 1)
    a = int(sym.max()) + 1
    # every pair has its own symbols, numbered from 1; its symbol 0 matches nothing
    kinds, own = _numbered(np.concatenate([pair_p, pair_t]) * a + sym, p * a)
    of_pair = kinds // a
    per_pair = np.bincount(of_pair, minlength=p)
    own = own - (np.cumsum(per_pair) - per_pair)[np.concatenate([pair_p, pair_t])] + 1
    entries = (per_pair + 1) * blocks
    base = np.cumsum(entries) - entries
    # rows lie at the upper end: the last row of a pair is the top bit of its last block
    unused = 64 * blocks - m
    at = _steps_of(unused, m)
    where = base[pair_p] + own[:len(pat)] * blocks[pair_p] + at // 64
    bits = np.left_shift(_ONE, (at % 64).astype(np.uint64))
    table = np.zeros(int(entries.sum()), dtype=np.uint64)
    np.add.at(table, where, bits)                                   # no bit comes twice
    # a text as table positions, behind and before as many fillers as its pair has blocks
    room = n + 2 * blocks
    room_at = np.cumsum(room) - room
    scan = np.repeat(base, room)
    scan[_steps_of(room_at + blocks, n)] += own[len(pat):] * blocks[pair_t]
    lanes = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    block = _steps_of(np.zeros(p, dtype=np.int64), blocks)
    pair = np.repeat(np.arange(p), blocks)
    above = 64 * block - unused[pair]                               # rows before the block
    rim = ((k - (n - m)) // 2)[pair]
    enter = (np.maximum(above - rim, 0) + block) // SPELL
    leave = (np.minimum(above + 64 + (n - m)[pair] + rim, n[pair]) - 1 + block) // SPELL
    begin = (room_at + blocks)[pair] - block
    vp = np.full(lanes, _ALL)
    vp[first] = np.left_shift(_ALL, unused.astype(np.uint64))       # unused rows: no difference, no match
    vn = np.zeros(lanes, dtype=np.uint64)
    into_up, into_down = np.zeros(lanes, dtype=np.uint64), np.zeros(lanes, dtype=np.uint64)
    into_up[first] = _ONE
    plus, minus = np.zeros(p, dtype=np.uint64), np.zeros(p, dtype=np.uint64)
    ends = n + blocks - 1                       # steps until the last block has scanned the text
    live, t, spell = p, 0, 0
    while live:
        on = np.flatnonzero((enter <= spell) & (leave >= spell))
        size, of = len(on), pair[on]
        firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        lasts = np.r_[firsts[1:], size]
        late, behind = on[:0], on[:0]
        if spell:
            # entering blocks of a pair start at one column; the block above has counted it already
            new = np.flatnonzero(enter[on] == spell)
            lead = new[np.r_[True, of[new][1:] != of[new][:-1]]] if len(new) else new
            plus[of[lead]] -= into_up[on[lead]]
            minus[of[lead]] -= into_down[on[lead]]
            lag = np.zeros(p, dtype=np.int64)
            lag[of[lead]] = block[on[lead]]
            behind = block[on[new]] - lag[of[new]]
            late, behind = new[behind > 0], behind[behind > 0]
        wait = t + int(behind.max(initial=0))
        began = t
        top, other = np.zeros(size, dtype=np.uint64), np.full(size, _ALL)     # a pair's first block, and the others
        top[firsts], other[firsts] = _ONE, 0
        all_up, all_down = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        svp, svn, cursor, row = vp[on], vn[on], begin[on], block[on]
        up, down = np.zeros(size + 1, dtype=np.uint64), np.zeros(size + 1, dtype=np.uint64)
        up[:size], down[:size] = into_up[on], into_down[on]
        up2, down2 = up.copy(), down.copy()
        e, xv, x, ph, mh = (np.empty(size, dtype=np.uint64) for _ in range(5))
        pos = np.empty(size, dtype=np.int64)
        until = (spell + 1) * SPELL
        while live and t < until:
            stop = min(int(ends[live - 1]), until)
            w = int(lasts[live - 1])
            vp_, vn_, e_, xv_, x_, ph_, mh_ = (v[:w] for v in (svp, svn, e, xv, x, ph, mh))
            pos_, cursor_, row_ = pos[:w], cursor[:w], row[:w]
            top_, other_, all_up_, all_down_ = top[:w], other[:w], all_up[:w], all_down[:w]
            for t in range(t, stop):
                scan[t:].take(cursor_, out=pos_, mode="clip")
                pos_ += row_
                table.take(pos_, out=e_, mode="clip")
                if t < wait:
                    still = late[behind > t - began]
                    e_[still[still < w]] = 0
                in_up, in_down = up[:w], down[:w]
                if t > began:                   # the first step of a spell has what the one before left
                    in_up |= top_
                    in_down &= other_
                np.bitwise_or(e_, vn_, out=xv_)
                e_ |= in_down
                np.bitwise_and(e_, vp_, out=x_)
                x_ += vp_
                x_ ^= vp_
                x_ |= e_
                np.bitwise_or(x_, vp_, out=ph_)
                np.invert(ph_, out=ph_)
                ph_ |= vn_
                np.bitwise_and(vp_, x_, out=mh_)
                out_up, out_down = up2[1:w + 1], down2[1:w + 1]
                np.right_shift(ph_, _SH63, out=out_up)
                np.right_shift(mh_, _SH63, out=out_down)
                all_up_ += out_up
                all_down_ += out_down
                ph_ <<= _ONE
                ph_ |= in_up
                mh_ <<= _ONE
                mh_ |= in_down
                np.bitwise_or(xv_, ph_, out=vp_)
                np.invert(vp_, out=vp_)
                vp_ |= mh_
                np.bitwise_and(ph_, xv_, out=vn_)
                up, up2, down, down2 = up2, up, down2, down
            t, was = stop, live
            live = int(np.searchsorted(-ends[:live], -stop))        # pairs that end later
            done = lasts[live:was] - 1
            plus[live:was] += all_up[done]
            minus[live:was] += all_down[done]
        if live:
            last = lasts[:live] - 1
            plus[:live] += all_up[last]
            minus[:live] += all_down[last]
            below = on[last] + 1                                    # the block that enters next, if there is one
            has = np.flatnonzero(below < (first + blocks)[:live])
            out_up, out_down = up[last[has] + 1], down[last[has] + 1]
            up[firsts], down[firsts] = _ONE, 0
            vp[on], vn[on], into_up[on], into_down[on] = svp, svn, up[:size], down[:size]
            into_up[below[has]], into_down[below[has]] = out_up, out_down
        spell += 1
    return m + plus.astype(np.int64) - minus.astype(np.int64)


def _bucket_distances(pats: Sequence, texts: Sequence, k: np.ndarray | None = None) -> np.ndarray:
    """Distances, exact up to ``k``, of one group of pairs with non-empty patterns
    (len(pattern) <= len(text)), by lanes."""
    (pat, m), (text, n) = _symbols(pats), _symbols(texts)
    k = n if k is None else k                                       # no distance is above n
    order = np.argsort(-(n + (m + 63) // 64), kind="stable")
    if (order != np.arange(len(order))).any():
        (pat, m), (text, n) = (_symbols([side[q] for q in order]) for side in (pats, texts))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = _group_distances(pat, m, text, n, k[order])
    return out


def levenshtein_bits(a, b) -> int:
    """Unit-cost edit distance of two sequences (str or list) by bit vectors."""
    return _banded_bits(a, b, max(len(a), len(b)))


def _banded_bits(a, b, k: int) -> int:
    """The distance by Python integers that hold the rows of the band, exact up to ``k``
    (the difference of the lengths at least)."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m == 0:
        return n
    peq: dict = {}
    bit = 1
    for x in b:
        peq[x] = peq.get(x, 0) | bit
        bit <<= 1
    rim = (k - (n - m)) // 2
    vp, vn, dist, low, high = 0, 0, 0, 0, 0
    for at in range(0, n, STRIDE):
        # the band's rows in these columns; those that enter are reached by deletions
        lo, hi = max(at - (n - m) - rim, 0), min(at + STRIDE + rim, m)
        vp = (vp >> (lo - low)) | (((1 << (hi - high)) - 1) << (high - lo))
        vn >>= lo - low
        dist += hi - high
        low, high = lo, hi
        full = (1 << (hi - lo)) - 1
        top = 1 << (hi - lo - 1)
        here: dict = {}
        for x in a[at:at + STRIDE]:
            eq = here.get(x)
            if eq is None:
                eq = here[x] = (peq.get(x, 0) >> lo) & full
            xv = eq | vn
            d0 = ((((eq & vp) + vp) & full) ^ vp) | eq
            hp = vn | (full ^ (d0 | vp))
            hn = vp & d0
            if hp & top:
                dist += 1
            elif hn & top:
                dist -= 1
            hp = ((hp << 1) | 1) & full
            hn = (hn << 1) & full
            vp = hn | (full ^ (xv | hp))
            vn = hp & xv
    return dist


def _symbols(items: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of ``items`` (str or sequences of integers) one behind the other, and their lengths."""
    n = np.fromiter(map(len, items), np.int64, len(items))
    if isinstance(items[0], str):
        flat = np.frombuffer("".join(items).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    else:
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in items])
    return flat, n


def levenshtein_many(a: Sequence, b: Sequence, guess: np.ndarray | None = None) -> np.ndarray:
    """Edit distance of every pair (a[i], b[i]); items are str, lists of tokens, or arrays of
    non-negative integers. ``guess``, if given, says about how far each pair is apart: a good one
    saves work, a bad one costs it, and the results are exact either way.

    Pairs ordered by length are scored in groups of lanes; a rough cost model leaves the few
    longest, which would lengthen the run of a group alone, to per-pair Python integers."""
    out = np.zeros(len(a), dtype=np.int64)
    if any(isinstance(x, list) for x in a):
        ids: dict = {}
        a, b = ([[ids.setdefault(c, len(ids)) for c in x] for x in side] for side in (a, b))
    la, lb = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
    m, n = np.minimum(la, lb), np.maximum(la, lb)
    out[m == 0] = n[m == 0]
    blocks = (m + 63) // 64
    todo = np.flatnonzero(m)
    todo = todo[np.argsort(-(n + blocks)[todo], kind="stable")]
    if not len(todo):
        return out
    m, n, blocks = m[todo], n[todo], blocks[todo]
    # no distance is above n
    k = n if guess is None else np.asarray(guess, dtype=np.int64)[todo].clip(n - m, n)
    wide = np.minimum(blocks, k // 64 + 3)                          # blocks at work at a time
    pairs = list(zip(todo.tolist(), (la <= lb)[todo].tolist()))
    pats, texts = ([(a[q] if first == shorter else b[q]) for q, first in pairs] for shorter in (True, False))
    alone = np.r_[0, np.cumsum(n * (SYMBOL + wide * BLOCK))]
    grouped = (n * wide)[::-1].cumsum()[::-1] * LANE
    cut = int(np.argmin(alone + np.r_[grouped + (n + blocks) * STEP, 0]))
    got = np.empty(len(todo), dtype=np.int64)
    for q in range(cut):
        got[q] = _banded_bits(pats[q], texts[q], int(k[q]))
    while cut < len(todo):
        size = np.maximum(np.cumsum(wide[cut:]) / GROUP_LANES, np.cumsum((m + 1)[cut:].clip(max=256) * blocks[cut:]) / GROUP_ENTRIES)
        end = cut + max(1, int(np.searchsorted(size, 1.0, side="right")))
        got[cut:end] = _bucket_distances(pats[cut:end], texts[cut:end], k[cut:end])
        cut = end
    far = np.flatnonzero(got > k)
    if len(far):
        got[far] = levenshtein_many([pats[q] for q in far], [texts[q] for q in far], got[far])
    out[todo] = got
    return out
