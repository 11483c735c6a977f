"""Suffix arrays by induced sorting, and permuted common prefixes, in vectorised steps.

Buckets of the alphabet are filled one after the other; within a bucket all suffixes known so
far induce their predecessors at once, and what falls into the same bucket follows as the next
block. So a pass takes a few array operations for each letter and for each repetition of a
letter, over a linear number of suffixes in all.
"""

from __future__ import annotations

import numpy as np

#: Positions; a shard is far shorter than 2 ** 31.
_INT = np.int32


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type). s ends in a unique smallest letter."""
    n = len(s)
    change = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    smaller = np.append(s[change[:-1]] < s[change[:-1] + 1], True)
    return np.repeat(smaller, np.diff(change, prepend=-1))


def leftmost_smaller(is_s: np.ndarray) -> np.ndarray:
    """Positions of S-type suffixes that follow an L-type one."""
    return (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(_INT)


def _fill(sa: np.ndarray, s: np.ndarray, at: np.ndarray, wanted: np.ndarray, block: np.ndarray, step: int) -> None:
    """Put the predecessors of block that are wanted into their buckets, in order; at moves by step for each."""
    before = block[block > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    letters = s[before]
    order = np.argsort(letters, kind="stable")
    counts = np.bincount(letters, minlength=len(at)).astype(_INT)
    firsts = np.cumsum(counts, dtype=_INT) - counts
    # where each letter's block begins, less the place of its first suffix in the sorted block
    base = at - firsts if step > 0 else at - 1 + firsts
    place = np.arange(len(before), dtype=_INT)
    sa[np.repeat(base, counts) + (place if step > 0 else -place)] = before[order]
    at += step * counts


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array if lms is sorted by suffix; else all suffixes sorted by their part up to the next of lms."""
    sa = np.full(len(s), -1, _INT)
    counts = np.bincount(s, minlength=size)
    stops = np.cumsum(counts).astype(_INT)
    starts = stops - counts.astype(_INT)
    seeds = np.bincount(s[lms], minlength=size)
    # those of one bucket keep their order
    groups = np.split(lms[np.argsort(s[lms], kind="stable")], np.cumsum(seeds)[:-1])
    is_l, heads = ~is_s, starts.copy()
    for c in range(size):
        done = starts[c]
        while done < heads[c]:
            block, done = sa[done : heads[c]].copy(), heads[c]
            _fill(sa, s, heads, is_l, block, 1)
        if seeds[c]:
            _fill(sa, s, heads, is_l, groups[c], 1)
    tails = stops.copy()
    for c in range(size - 1, -1, -1):
        done = stops[c]
        while done > tails[c]:
            block, done = sa[tails[c] : done][::-1].copy(), tails[c]
            _fill(sa, s, tails, is_s, block, -1)
        if heads[c] > starts[c]:
            _fill(sa, s, tails, is_s, sa[starts[c] : heads[c]][::-1], -1)
    # the last letter has no successor that could induce it
    sa[0] = len(s) - 1
    return sa


def _name(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Of each of lms, the rank of its substring up to the next of lms; ordered has them sorted by it."""
    length = np.diff(lms, append=len(s) - 1) + 1
    index = np.zeros(len(s), _INT)
    index[lms] = np.arange(len(lms))
    of = length[index[ordered]]
    same = np.zeros(len(ordered), bool)
    pairs = np.flatnonzero(of[1:] == of[:-1]) + 1
    if len(pairs):
        sizes = of[pairs]
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
        equal = s[np.repeat(ordered[pairs - 1], sizes) + place] == s[np.repeat(ordered[pairs], sizes) + place]
        same[pairs] = np.logical_and.reduceat(equal, firsts)
    names = np.zeros(len(lms), np.int64)
    names[index[ordered]] = np.cumsum(~same) - 1
    return names


def _sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of names. Each round tells apart twice as long parts, among those that still tie."""
    n, width = len(names), 1
    # a rank is the first place of all that tie with it
    rank = (np.cumsum(np.bincount(names)) - np.bincount(names))[names]
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(live):
        after = np.where(live + width < n, rank[np.minimum(live + width, n - 1)] + 1, 0)
        old = rank[live]
        order = np.argsort(old * (n + 1) + after)
        live, old, after = live[order], old[order], after[order]
        place = np.arange(len(live))
        begins = np.append(True, old[1:] != old[:-1])
        fresh = begins | np.append(True, after[1:] != after[:-1])
        group, part = np.maximum.accumulate(np.where(begins, place, 0)), np.maximum.accumulate(np.where(fresh, place, 0))
        rank[live] = old + part - group
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        live = live[tied]
        width *= 2
    return np.argsort(rank)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a uint8 array whose last letter is 0 and stands nowhere else."""
    if len(s) < 3:
        return np.arange(len(s))[::-1].copy()
    is_s = classify(s)
    lms = leftmost_smaller(is_s)
    size = int(s.max()) + 1
    rough = induce(s, is_s, lms, size)
    marked = np.zeros(len(s), bool)
    marked[lms] = True
    names = _name(s, lms, rough[marked[rough]])
    return induce(s, is_s, lms[_sort_names(names)], size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Of each position, the common prefix of its suffix and the one before it in sa, at most room there.

    room must fall by one from a position to the next, or be 0; most is its largest value or more. Where the letters before both
    agree, the prefix is one shorter than that of the position before; only others are compared.
    """
    n = len(s)
    before = np.zeros(n, _INT)
    before[sa[1:]] = sa[:-1]
    first = sa[0]
    own = np.ones(n, bool)
    own[1:] = (before[1:] == 0) | (s[:-1] != s[before[1:] - 1]) | (room[:-1] == 0)
    if first + 1 < n:
        own[first + 1] = True
    own[first] = True
    where = np.flatnonzero(own)
    padded = np.concatenate([s, np.zeros(most + 16, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        words |= padded[k : len(padded) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    prefix = np.zeros(len(where), _INT)
    live = np.arange(len(where))
    for at in range(0, most, 8):
        differ = words[where[live] + at] ^ words[before[where[live]] + at]
        low = differ & (~differ + np.uint64(1))
        agreed = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        prefix[live] += agreed.astype(_INT)
        live = live[differ == 0]
        if not len(live):
            break
    prefix = np.minimum(prefix, np.minimum(room[where], room[before[where]]))
    prefix[where == first] = 0
    # what is not compared is one shorter than its left neighbour
    near = np.cumsum(own, dtype=_INT) - 1
    return np.maximum(0, prefix[near] - (np.arange(n, dtype=_INT) - where.astype(_INT)[near]))
