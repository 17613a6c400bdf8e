"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key; nine bits hold a byte plus one, and zero for a separator.
PACKED, SYMBOL_BITS = 7, 9


def packed_keys(symbols: np.ndarray) -> np.ndarray:
    """The next PACKED symbols at each position as one number; zeros follow the end."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACKED, np.int64)])
    keys = np.zeros(len(symbols), np.int64)
    for k in range(PACKED):
        keys = (keys << SYMBOL_BITS) | padded[k : k + len(symbols)]
    return keys


def suffix_array(symbols: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each position).

    Suffixes are sorted by their first PACKED symbols; then each round sorts, inside the groups that are still
    undecided, by the group of the suffix as far on as is already sorted, which doubles that length.
    """
    n = len(symbols)
    keys = packed_keys(symbols) if keys is None else keys
    sa = np.argsort(keys)
    heads = np.concatenate([[True], keys[sa[1:]] != keys[sa[:-1]]]) if n else np.zeros(0, bool)
    slot = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = slot
    open_slots = np.flatnonzero(_undecided(slot))
    length = PACKED
    while len(open_slots):
        at = sa[open_slots]
        group = rank[at]
        pair = group * (n + 1) + rank[np.minimum(at + length, n)] + 1
        order = np.argsort(pair)
        at, pair = at[order], pair[order]
        sa[open_slots] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        slot = np.maximum.accumulate(np.where(new, open_slots, 0))
        rank[at] = slot
        open_slots = open_slots[_undecided(slot)]
        length *= 2
    return sa, rank[:n]


def _undecided(slot: np.ndarray) -> np.ndarray:
    """Slots whose group has another member; equal groups are neighbours."""
    same = slot[1:] == slot[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def common_prefixes(symbols, keys, sa, rank, starts, steps, most: int) -> np.ndarray:
    """For each position, the symbols it shares with its predecessor in the suffix array, at most ``most``.

    Kasai: the next position shares at least one less.  Each stretch (``starts``, ``steps``) is a chain of its
    own, and all chains advance together.  Positions outside the stretches keep 0.
    """
    n = len(symbols)
    out = np.zeros(n, np.int32)
    before = np.full(n, -1, np.int64)
    if n:
        before[sa[1:]] = sa[:-1]
    padded = np.concatenate([symbols, np.zeros(1, symbols.dtype)])
    keys = np.concatenate([keys, [-1]])
    shared = np.zeros(len(starts), np.int64)
    order = np.argsort(-steps, kind="stable")
    starts, steps = starts[order], steps[order]
    for t in range(int(steps[0]) if len(steps) else 0):
        live = int(np.searchsorted(-steps, -t, "left"))  # chains with steps > t
        i = starts[:live] + t
        j = before[i]
        h = np.maximum(shared[:live] - 1, 0)
        h[j < 0] = 0
        for width, values in ((PACKED, keys), (1, padded)):
            go = np.flatnonzero((j >= 0) & (h < most))
            while len(go):
                a, b = np.minimum(i[go] + h[go], n), np.minimum(j[go] + h[go], n)
                go = go[(values[a] == values[b]) & (a < n) & (b < n)]
                h[go] += width
                go = go[h[go] < most]
        h = np.minimum(h, most)
        shared[:live] = h
        out[i] = h
    return out
