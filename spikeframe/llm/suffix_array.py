"""The difference-cover suffix sort (modulo 3) over arrays of whole numbers."""

from __future__ import annotations

import numpy as np


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each key among the distinct ones, from 1, and their number."""
    by = np.argsort(key, kind="stable")
    new = np.ones(len(key), np.int64)
    new[1:] = key[by][1:] != key[by][:-1]
    out = np.empty(len(key), np.int64)
    out[by] = np.cumsum(new)
    return out, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of s in order. Symbols are positive and below 2**21; an end sorts before any symbol.

    The suffixes at positions 1 and 2 modulo 3 are named by their sorted triples; if names repeat, the sequence of names
    is sorted in the same way. The others follow from their first symbol and the next suffix's rank; then both merge.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # n = 1 mod 3: an empty suffix ends the first part
    sample = np.concatenate([one, two])
    named, distinct = _names((t[sample] << np.int64(42)) | (t[sample + 1] << np.int64(21)) | t[sample + 2])
    if distinct < len(sample):
        order = suffix_array(named) if distinct < 1 << 21 else _doubling(named)
        rank_in = np.empty(len(sample), np.int64)
        rank_in[order] = np.arange(1, len(sample) + 1)
    else:
        rank_in = named
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = rank_in
    real = sample[sample < n]
    by_rank = real[np.argsort(rank[real], kind="stable")]
    zero = np.arange(0, n, 3)
    key0 = (t[zero] << np.int64(32)) | rank[zero + 1]
    by0 = np.argsort(key0, kind="stable")
    zero, key0 = zero[by0], key0[by0]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    key1 = (t[ones] << np.int64(32)) | rank[ones + 1]
    long0 = _pair(t[zero], t[zero + 1], rank[zero + 2])
    long2 = _pair(t[twos], t[twos + 1], rank[twos + 2])
    place = np.empty(n, np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(key1, key0) + _less(long2, long0)
    above = np.arange(len(by_rank))
    before = np.empty(n, np.int64)
    before[ones] = np.searchsorted(key0, key1)
    before[twos] = _less(long0, long2)
    place[by_rank] = above + before[by_rank]
    out = np.empty(n, np.int64)
    out[place] = np.arange(n)
    return out


def _pair(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sorts as (a, b, r): a and b below 2**21, r below 2**32, in two words."""
    out = np.empty(len(a), [("ab", np.int64), ("r", np.int64)])
    out["ab"], out["r"] = (a << np.int64(21)) | b, r
    return out


def _less(sorted_pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of sorted_pairs are below each of the also sorted `of`."""
    both = np.concatenate([of, sorted_pairs])
    order = np.lexsort((np.arange(len(both)), both["r"], both["ab"]))
    is_pair = order >= len(of)
    below = np.cumsum(is_pair)
    out = np.empty(len(of), np.int64)
    out[order[~is_pair]] = below[~is_pair]
    return out


def _doubling(s: np.ndarray) -> np.ndarray:
    """The same by ranks of prefixes of twice the length, for alphabets too large to pack."""
    rank, step, n = _names(s)[0], 1, len(s)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:]
        rank, distinct = _names((rank << np.int64(32)) | nxt)
        if distinct == n:
            return np.argsort(rank, kind="stable")
        step *= 2
