"""Two-stage suffix sorting of a block of byte strings, to a bounded depth, with numpy.

Suffixes smaller than their successor (type B) are sorted directly; all others (type A) are induced from
them by one scan over the buckets of first symbols, smallest first. Order is right to `depth` symbols,
which is all that matches of that length need.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # 9-bit symbols in an int64


def _packed(t: np.ndarray) -> np.ndarray:
    """Rank of the PACK symbols that begin at each place; the end counts as zeros."""
    padded = np.append(t, np.zeros(PACK, t.dtype)).astype(np.int64)
    key = np.zeros(len(t), np.int64)
    for i in range(PACK):
        key = (key << 9) | padded[i : i + len(t)]
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Type B flags: the suffix is smaller than its successor. The last suffix counts as B."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def sort_direct(places: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first `depth` symbols; only suffixes that still tie are sorted on."""
    padded = np.append(rank, np.zeros(depth + PACK, np.int64))
    width = int(rank.max()).bit_length() if len(rank) else 1
    order = places[np.argsort(padded[places], kind="stable")]
    value = padded[order]
    fresh = np.append(True, value[1:] != value[:-1])
    for shift in range(PACK, depth, PACK):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        key = (np.cumsum(fresh)[at] << width) | padded[own + shift]
        by = np.argsort(key, kind="stable")
        order[at] = own[by]
        key = key[by]
        fresh[at] |= np.append(True, key[1:] != key[:-1])
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of symbols t (0..511, the last of them 0) in order of their first `depth` symbols."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    b = smaller_than_next(t)
    symbols = int(t.max()) + 1
    ends = np.cumsum(np.bincount(t, minlength=symbols))
    starts = ends - np.bincount(t, minlength=symbols)
    head = starts.copy()
    tails = ends - np.bincount(t[b], minlength=symbols)  # where the B part of a bucket begins
    out = np.full(n, -1, np.int64)
    direct = sort_direct(np.flatnonzero(b), _packed(t), depth)
    first = t[direct]
    begin = np.searchsorted(first, np.arange(symbols + 1))
    for c in np.flatnonzero(ends > starts):
        out[tails[c] : ends[c]] = direct[begin[c] : begin[c + 1]]
        wave = out[starts[c] : head[c]]
        while len(wave):  # runs of one symbol that fall at their end
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
            out[head[c] : head[c] + len(wave)] = wave
            head[c] += len(wave)
        before = out[starts[c] : ends[c]]
        before = before[before > 0] - 1
        symbol = t[before]
        larger = symbol > c
        before, symbol = before[larger], symbol[larger]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        if not len(symbol):
            continue
        edge = np.append(np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])), len(symbol)).tolist()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            x = symbol[s]
            out[head[x] : head[x] + e - s] = before[s:e]
            head[x] += e - s
    return out


def common_prefix_at_least(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Do the suffixes a[i] and b[i] (depth symbols or more each) begin with the same `depth` symbols?"""
    same = np.ones(len(a), bool)
    at = np.arange(len(a))
    for i in range(depth):
        at = at[t[a[at] + i] == t[b[at] + i]]
    same[:] = False
    same[at] = True
    return same


def repeated_windows(strings: list[bytes], depth: int) -> np.ndarray:
    """Places, in the strings laid end to end with one separator after each, of the `depth`-byte windows that
    also begin at an earlier place."""
    parts = [np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, np.int16(0)) for s in strings]
    t = np.concatenate(parts) if parts else np.zeros(0, np.int16)
    sizes = np.array([len(p) for p in parts], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(t))  # symbols before the separator
    sa = suffix_array(t, depth)
    sa = sa[left[sa] >= depth]
    if len(sa) < 2:
        return np.zeros(0, np.int64)
    new = np.append(True, ~common_prefix_at_least(t, sa[:-1], sa[1:], depth))
    begin = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(sa, begin), np.diff(np.append(begin, len(sa))))
    return np.sort(sa[sa != earliest])
