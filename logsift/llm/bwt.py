"""Long repeats by the Burrows-Wheeler transform of a text of bounded size.

Suffixes are sorted by prefix doubling as far as the length in question. Then intervals of the suffix array are extended
backward, breadth first: the interval of a string w gives those of c + w for all bytes c that stand before w, and where such an
interval ends, the common prefix of the two neighbours is as long as w, unless a shorter string has already ended there. So common
prefixes are found by increasing value, each place once, and the search stops at the length: neighbours that no string
has parted share that many bytes at least.
"""

from __future__ import annotations

import numpy as np

#: Symbols that fit into the first sorting key: bytes and a separator, nine bits each.
PACKED, BITS = 7, 9


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of what follows them, as far as ``length`` symbols; what is behind the end counts as separators."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACKED, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(PACKED):
        key = key << np.uint64(BITS) | padded[k : k + n]
    known = PACKED
    while True:
        order = np.argsort(key)
        ordered = key[order]
        if known >= length:
            return order.astype(np.int32)
        rank = np.empty(n + known, np.uint64)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) if n else 0
        rank[n:] = 0
        key = rank[:n] << np.uint64(32) | rank[known:]
        known *= 2


def parted(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place k of the order (from 1), whether suffixes k - 1 and k have less than ``length`` symbols in common."""
    n = len(symbols)
    before = symbols[order.astype(np.int64) - 1].astype(np.int64)  # the transform; the last symbol stands before the first suffix
    by_symbol = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int32)  # where the suffix that begins one symbol earlier stands
    forward[by_symbol] = np.arange(n, dtype=np.int32)
    again = np.full(n, n, np.int32)  # the next place with the same symbol before it
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    again[by_symbol[:-1][same]] = by_symbol[1:][same]
    ranks = before[by_symbol] * n + by_symbol  # ascending: how many places before one have a symbol before them
    out = np.zeros(n + 1, bool)
    out[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        if not len(low):
            break
        width = high - low
        row = np.repeat(np.arange(len(low)), width)
        at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width - low, width)
        last = np.flatnonzero(again[at] >= high[row])  # of its symbol in the interval
        at, row = at[last], row[last]
        end = forward[at].astype(np.int64) + 1
        fresh = ~out[end]
        at, row, end = at[fresh], row[fresh], end[fresh]
        out[end] = True
        low, high = np.searchsorted(ranks, before[at] * n + low[row]), end
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the places, ascending, of its strings of ``length`` bytes that also start at another place, of any text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[firsts + sizes] = False  # separators, which no string of the length may hold
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
    symbols[inside] += 1
    twice = np.zeros(len(symbols), bool)
    if len(symbols) > 1:
        order = suffix_order(symbols, length)
        met = np.flatnonzero(~parted(symbols, order, length))
        twice[order[met]] = twice[order[met - 1]] = True
    return [np.flatnonzero(twice[a : a + max(0, n - length + 1)]) for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
