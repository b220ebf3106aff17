"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.  Leftmost
S suffixes cut the text into substrings; these are sorted by inducing L from them and S
from L, named by rank, and where names repeat the string of names is sorted recursively.
From the order of the leftmost S suffixes the same two passes induce that of all.

A pass goes through blocks of neighbouring symbols.  The rank of a suffix follows from its
symbol and the rank of the suffix to its right, which lies in an earlier block or, where
symbols of one block meet, was ranked a round before.
"""

from __future__ import annotations

import numpy as np

BLOCKS, LEAST = 64, 1 << 12


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol counts as such."""
    n = len(s)
    out = np.ones(n, bool)
    rise = s[1:] > s[:-1]
    where = np.where(s[1:] != s[:-1], np.arange(n - 1), n - 1)  # the next place where symbols differ decides
    where = np.minimum.accumulate(where[::-1])[::-1]
    out[:-1] = np.append(rise, True)[where]
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of keys, equal for equal ones, and how many there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


def _by_block(block: np.ndarray, places: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    of = block[places]
    return places[np.argsort(of.astype(np.uint16), kind="stable")], np.cumsum(np.bincount(of, minlength=count))


def _induce(s: np.ndarray, size: int, targets: np.ndarray, seeds: np.ndarray, seed_rank: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``targets`` and ``seeds``, from those of the seeds.

    The symbol of a target is no less than the one to its right, which belongs to a target
    or a seed; of one symbol, targets come before seeds.
    """
    held = np.bincount(s[targets], minlength=size) + np.bincount(s[seeds], minlength=size)
    step = max(LEAST, (len(targets) + len(seeds)) // BLOCKS)
    of_symbol = np.cumsum(held) - held
    block = (of_symbol // step)[s].astype(np.int32)
    count = int(block.max()) + 1
    targets, t_ends = _by_block(block, targets, count)
    seeds, s_ends = _by_block(block, seeds, count)
    own = np.zeros(len(s), np.int64)
    own[seeds] = seed_rank[seeds]
    rank, done, base, a, p = np.zeros(len(s) + 1, np.int64), np.zeros(len(s) + 1, bool), 1, 0, 0
    for b in range(count):
        here, ready = targets[a : t_ends[b]], seeds[p : s_ends[b]]
        a, p = t_ends[b], s_ends[b]
        inside = block[here + 1] == b
        pending, first = here[inside], here[~inside]
        spread = max(base + len(here) + len(ready) + 2, int(own[ready].max()) + 1 if len(ready) else 0)
        settled, late = np.concatenate((ready, first)), np.zeros(0, np.int64)
        keys = np.concatenate(((2 * s[ready] + 1) * spread + own[ready], 2 * s[first] * spread + rank[first + 1]))
        while True:
            places = np.concatenate((settled, late))
            local, kinds = _ranked(np.concatenate((keys, 2 * s[late] * spread + rank[late + 1])))
            rank[places] = base + local
            if not len(pending):
                break
            done[places] = True
            go = done[pending + 1]
            late, pending = np.concatenate((late, pending[go])), pending[~go]
        base += kinds
    return rank[:-1]


def ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of s, whole numbers from 0; its last symbol must be less than all others."""
    n, size = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(s)
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    cuts, small, large = np.flatnonzero(leftmost), np.flatnonzero(smaller), np.flatnonzero(~smaller)
    turned = size - 1 - s

    def both(rank: np.ndarray) -> np.ndarray:
        rank = _induce(s, size, large, cuts, rank)
        if smaller[-1]:  # the end is a seed of its own: nothing stands to its right
            rank = n + 2 - rank
            seeds = np.append(large, n - 1)
            rank[n - 1] = n + 2
            rank = _induce(turned, size, small[:-1], seeds, rank)
        return rank.max() - rank

    names = both(s)[cuts]
    if len(cuts):
        names, kinds = _ranked(names)
        order = ranks(names) if kinds < len(cuts) else names
        rank = np.zeros(n, np.int64)
        rank[cuts] = order
        return both(rank)
    return both(np.zeros(n, np.int64))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view("<u8").ravel()


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes from places a and b on, at most ``most`` of them; the first ``start`` are known to be equal."""
    out, live = start.astype(np.int64).copy(), np.arange(len(a))
    while len(live := live[out[live] < most]):
        at = out[live]
        odd = words[a[live] + at] ^ words[b[live] + at]
        low = odd & (~odd + np.uint64(1))
        same = np.where(odd == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        out[live] = np.minimum(at + same, most)
        live = live[same == 8]
    return out


def permuted_prefixes(data: np.ndarray, starts: np.ndarray, before: np.ndarray, window: int, every: int = 8) -> np.ndarray:
    """Common prefix, up to ``window`` bytes, of each place in ``starts`` (ascending) with the place in ``before``.

    ``before`` has the next less suffix among ``starts``, -1 for the least.  In text order a common
    prefix shrinks by one a place at most while the neighbour moves along, so that only each
    ``every``-th place of a run is compared from its first byte.
    """
    words, out = _words(np.append(data, np.zeros(window, np.uint8))), np.zeros(len(starts), np.int64)
    run = np.maximum.accumulate(np.where(np.append(True, starts[1:] != starts[:-1] + 1), np.arange(len(starts)), 0))
    anchor = np.arange(len(starts)) - (np.arange(len(starts)) - run) % every
    far = starts - starts[anchor]
    has = before >= 0
    first = np.flatnonzero(has & (far == 0))
    out[first] = _common(words, starts[first], before[first], np.zeros(len(first)), window)
    rest = np.flatnonzero(has & (far > 0))
    inside = np.zeros(len(data) + every, bool)
    inside[starts] = True
    moved = before[anchor[rest]] + far[rest]
    known = np.where((before[anchor[rest]] >= 0) & inside[moved], np.maximum(out[anchor[rest]] - far[rest], 0), 0)
    out[rest] = _common(words, starts[rest], before[rest], known, window)
    return out
