"""Suffix order by difference cover, vectorised: sampled triples, recursion on names, merge."""

from __future__ import annotations

import numpy as np


def _packed(*columns):
    """One key that orders as the columns do, the first one first; keys too wide for 63 bits are numbered anew."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        bits = int(column.max()).bit_length() if len(column) else 0
        if len(key) and int(key.max()).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key <<= bits
        key |= column
    return key


def suffix_order(symbols, depth: int | None = None):
    """Positions of all suffixes in order; symbols are positive integers.

    ``depth`` limits the order to that many first symbols: names of a recursion that already cover so many
    are not told apart any further, and suffixes that agree so far come in any order.
    """
    symbols = np.asarray(symbols)
    # half the memory where symbols and places fit into 32 bits
    kind = np.int64 if len(symbols) and max(int(symbols.max()), len(symbols)) >= (1 << 31) - 4 else np.int32
    return _order(symbols.astype(kind), depth, 1)


def _order(s, depth, covers):
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), s.dtype)
    padded = np.concatenate([s, np.zeros(3, s.dtype)])
    del s
    sampled = np.arange(n + (n % 3 == 1), dtype=padded.dtype)  # the dummy suffix after the end keeps the two halves of names apart
    sampled = sampled[sampled % 3 != 0]
    key = _packed(*(padded[sampled + k] for k in range(3)))
    by = np.argsort(key)
    ordered, key = sampled[by], key[by]
    del by
    names = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=padded.dtype)
    del key
    rank = np.zeros(n + 3, padded.dtype)
    rank[ordered] = names
    if names[-1] < len(names) and (depth is None or covers * 3 < depth):
        places = np.concatenate([sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]])
        del names, ordered, sampled
        below = _order(rank[places], depth, covers * 3)
        ordered = places[below]
        if depth is None:
            rank[ordered] = np.arange(1, len(ordered) + 1)
        else:  # suffixes that the limited order left equal keep equal ranks
            rank[ordered] = _ranks_to(rank[places], below, -(-depth // (covers * 3)))
        del places, below
    ordered = ordered[ordered < n]
    rest = np.arange(0, n, 3, dtype=padded.dtype)
    rest = rest[np.argsort(_packed(padded[rest], rank[rest + 1]))]
    # the sampled suffixes before each of the rest: with one symbol a sampled suffix follows on both sides, or with two
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    low = np.zeros(len(rest), np.int64)
    for those, symbols in ((one, 1), (two, 2)):
        both = np.concatenate([those, rest])
        key = _packed(*(padded[both + k] for k in range(symbols)), rank[both + symbols])
        key[: len(those)].sort()
        low += np.searchsorted(key[: len(those)], key[len(those) :])
        del both, key
    by_place = np.argsort(low, kind="stable")  # only suffixes that a limited order calls equal can be out of order
    low, rest = low[by_place], rest[by_place]
    merged = np.empty(n, padded.dtype)
    place = low + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[place] = True
    merged[place] = rest
    merged[~taken] = ordered
    return merged


def _ranks_to(s, order, length):
    """Rank of each suffix in ``order``, equal for neighbours that share their first ``length`` symbols."""
    padded = np.concatenate([s, np.zeros(length, s.dtype)])
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in range(length):
        same &= padded[a + k] == padded[b + k]
    return np.concatenate([[1], 1 + np.cumsum(~same)])
