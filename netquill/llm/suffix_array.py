"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The array is built as in Nong, Zhang and Chan's SA-IS: suffixes are classified as smaller (S)
or larger (L) than their right neighbour, the leftmost-S substrings are sorted by one round of
inducing and named, the string of names is sorted in turn, and a last round induces the order
of all suffixes from it. Inducing goes bucket by bucket; inside a bucket it goes in
waves, one for each step of a run of equal symbols, so that each wave is a few array
operations. The recursion on names doubles instead (see suffixes_of_names).

Common prefixes come in text order (Karkkainen, Manzini and Puglisi): only positions whose
left neighbours differ are compared symbol by symbol, all others have one less than the
position before.
"""

from __future__ import annotations

import numpy as np

#: Below this length suffixes are sorted directly.
TINY = 24


def classes(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; s ends with its only smallest symbol."""
    n = len(s)
    less = np.empty(n, bool)
    less[-1] = True
    if n > 1:
        differs = np.flatnonzero(s[:-1] != s[1:])
        nearest = differs[np.searchsorted(differs, np.arange(n - 1))]  # the end of the run of equal symbols
        less[:-1] = s[nearest] < s[nearest + 1]
    return less


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from the leftmost-S ones in seeds (in order); edges bound the buckets."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    symbols = np.flatnonzero(np.diff(edges)).tolist()
    # Seeds go to the ends of their buckets, in order.
    order = np.argsort(s[seeds], kind="stable")
    placed = seeds[order]
    counts = np.bincount(s[seeds], minlength=len(edges) - 1)
    before = np.cumsum(counts) - counts
    sa[edges[1:][s[placed]] - counts[s[placed]] + np.arange(len(placed)) - before[s[placed]]] = placed

    heads = edges[:-1].copy()

    def put_left(found: np.ndarray) -> np.ndarray:
        """L-type left neighbours of the suffixes found, to the heads of their buckets."""
        left = found[found > 0] - 1
        left = left[~smaller[left]]
        if not len(left):
            return left
        c = s[left]
        order = np.argsort(c, kind="stable")
        left, c = left[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(first, len(c)))
        sa[np.repeat(heads[c[first]] - first, sizes) + np.arange(len(c))] = left
        heads[c[first]] += sizes
        return left

    seed_from = edges[1:] - counts
    for c in symbols:
        at = int(edges[c])
        while at < heads[c]:  # a wave: what came into this bucket since
            at, upto = int(heads[c]), at
            put_left(sa[upto:at])
        if counts[c]:
            put_left(sa[seed_from[c] : edges[c + 1]])

    tails = edges[1:].copy()

    def put_right(found: np.ndarray) -> None:
        """S-type left neighbours, to the ends of their buckets; found runs from the right."""
        left = found[found > 0] - 1
        left = left[smaller[left]]
        if not len(left):
            return
        c = s[left]
        order = np.argsort(c, kind="stable")
        left, c = left[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(first, len(c)))
        sa[np.repeat(tails[c[first]] - 1 + first, sizes) - np.arange(len(c))] = left
        tails[c[first]] -= sizes

    sa[0] = n - 1  # the end symbol
    tails[s[n - 1]] = 0
    for c in reversed(symbols):
        if c == s[n - 1]:
            put_right(sa[:1])
            continue
        at = int(edges[c + 1])
        while at > tails[c]:
            at, upto = int(tails[c]), at
            put_right(sa[at:upto][::-1])
        if heads[c] > edges[c]:
            put_right(sa[edges[c] : heads[c]][::-1])
    return sa


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Of s (uint16, symbols below size), whose last symbol is 0 and occurs nowhere else.

    Sixteen bits let numpy sort by radix.
    """
    n = len(s)
    if n <= TINY:
        listed = s.tolist()
        return np.array(sorted(range(n), key=lambda i: listed[i:]), np.int32)
    smaller = classes(s)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    edges = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    sa = induce(s, smaller, seeds, edges)
    by_substring = sa[is_seed[sa]]
    names, n_names = named(s, seeds, by_substring)
    if n_names == len(seeds):
        return induce(s, smaller, by_substring, edges)
    return induce(s, smaller, seeds[suffixes_of_names(names)], edges)


def suffixes_of_names(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names, whose alphabet is as large as the string.

    Recursion of the same kind would loop over as many buckets as there are names, so the
    string is sorted recursively by doubling: names are replaced by names for pairs of names,
    where the pair's halves are 1, 2, 4, ... apart, and only names still shared are sorted again.
    """
    n = len(names)
    rank = names.astype(np.int64)  # equal names share the rank of their first place
    order = np.argsort(rank, kind="stable")
    step = 1
    open_ = np.arange(n)  # places in the order whose names are shared
    rank[order] = first_places(rank[order], open_)
    while True:
        sorted_rank = rank[order[open_]]
        shared = np.zeros(len(open_), bool)
        equal = sorted_rank[1:] == sorted_rank[:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        open_ = open_[shared]
        if not len(open_):
            return order
        who = order[open_]
        nexts = who + step
        key = rank[who] << 32 | np.where(nexts < n, rank[np.minimum(nexts, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_], key = who[by], key[by]
        rank[order[open_]] = first_places(key, open_)
        step *= 2


def first_places(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted keys at these places, the place of the first equal key."""
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(fresh, places, 0))


def named(s: np.ndarray, seeds: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings in text order, equal ones alike, and how many there are."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[seeds] = np.append(np.diff(seeds) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_], b[open_]
        equal = s[x + at] == s[y + at]
        same[open_[~equal]] = False
        at += 1
        open_ = open_[equal & (length[x] > at)]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(n, np.int32)
    names[ordered] = rank
    return names[seeds], int(rank[-1]) + 1


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each rank, the symbols that the suffix shares with that of the rank before (the first: 0)."""
    n = len(s)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    position = np.arange(n)
    alone = (position == 0) | (before <= 0)
    some = ~alone
    alone[some] = s[position[some] - 1] != s[before[some] - 1]
    alone |= before < 0
    start = np.flatnonzero(alone)
    wide = s.astype(np.uint64)
    padded = np.concatenate([wide, np.zeros(4, np.uint64)])
    four = padded[:-4] | padded[1:-3] << np.uint64(16) | padded[2:-2] << np.uint64(32) | padded[3:-1] << np.uint64(48)
    shared = np.zeros(len(start), np.int64)
    open_ = np.flatnonzero(before[start] >= 0)
    while len(open_):
        x, y = start[open_] + shared[open_], before[start[open_]] + shared[open_]
        inside = (x < n) & (y < n)
        open_, x, y = open_[inside], x[inside], y[inside]
        differ = four[x] ^ four[y]
        # Symbols are below 2**15, so the lowest bit that differs lies in the first symbol that differs.
        low = differ & (~differ + np.uint64(1))
        whole = differ == 0
        shared[open_] += np.where(whole, 4, np.bitwise_count(low - np.uint64(1)) // 16)
        open_ = open_[whole]
    last = np.maximum.accumulate(np.where(alone, position, -1))
    which = np.cumsum(alone) - 1
    permuted = np.where(before < 0, 0, shared[which] - (position - last))
    return permuted[sa]
