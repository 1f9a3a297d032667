"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Positions walked side by side by common_prefixes are this far apart.
STRIDE = 64


def _words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number, zeros behind the end."""
    padded = np.zeros(len(text) + 8, dtype=np.uint8)
    padded[:len(text)] = text
    out = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the first ``depth`` (8 or more) bytes behind them, and the slots that
    don't agree with the slot before on all of them.

    Groups of positions that agree on h bytes are refined by the rank of what
    follows h bytes later, which doubles h; groups of one are left alone, and
    refinement ends at ``depth``, as longer agreement isn't asked for.
    """
    n = len(text)
    key = _words_at(text)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    first = np.ones(n + 1, dtype=bool)  # slot opens a group
    first[1:n] = key[1:] != key[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1  # the empty suffix
    rank[sa] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    h = 8
    while h < depth:
        slots = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(slots):
            break
        step = min(h, depth - h)
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slots] = at  # groups keep their slots, as their rank leads the key
        opens = first[slots]
        opens[1:] |= key[1:] != key[:-1]
        first[slots] = opens
        rank[at] = np.maximum.accumulate(np.where(opens, slots, 0))
        h += step
    return sa, first[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, opens: np.ndarray, cap: int) -> np.ndarray:
    """For each slot, how many bytes its suffix shares with the slot before, at most ``cap`` (Kasai).

    The suffix one byte further shares at most one byte less with its own
    neighbour, so a chain of positions never compares a byte twice; chains that
    start STRIDE apart are walked at the same time.  Suffixes that agree on all
    ``cap`` bytes are known from refinement; their order among themselves isn't
    lexicographic, so a chain begins anew behind them.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int32)
    words = np.append(_words_at(text), np.zeros(cap + 1, np.uint64))
    before = np.empty(n, dtype=np.int32)  # the neighbour of each position
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    plcp = np.zeros(n, dtype=np.int32)
    plcp[sa[~opens]] = cap
    for r in range(min(STRIDE, n)):
        at = np.arange(r, n, STRIDE, dtype=np.int32)
        at = at[(plcp[at] < cap) & (before[at] < n)]
        h = plcp[at - 1] if r else np.zeros(len(at), dtype=np.int32)
        h = np.where(h < cap, np.maximum(h - 1, 0), 0)
        live, i, j = np.arange(len(at)), at + h, before[at] + h
        while len(live):
            same = _equal_bytes(words[i] ^ words[j])
            h[live] += same
            more = (same == 8) & (h[live] < cap)
            live, i, j = live[more], i[more] + 8, j[more] + 8
        # behind the text's end words hold zeros, which aren't part of it
        plcp[at] = np.minimum(np.minimum(h, cap), n - np.maximum(at, before[at]))
    return plcp[sa]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes in front of the first byte that isn't zero, of big-endian numbers."""
    # without neighbouring ones a number keeps its highest bit when it is rounded to a double
    _, bits = np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))
    return 8 - (bits + 7) // 8


def classes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of ``length`` bytes at ``starts``.

    Returns the indices into ``starts`` in string order, and where in that
    order each class of equal strings begins.
    """
    sa, opens = suffix_array(text, length)
    group = np.cumsum(common_prefixes(text, sa, opens, length) < length)
    asked = np.full(len(text), -1, dtype=np.int64)
    asked[starts] = np.arange(len(starts))
    asked = asked[sa]
    here = asked >= 0
    order, group = asked[here], group[here]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = group[1:] != group[:-1]
    return order, np.flatnonzero(opens)


def merge_smallest(strings: np.ndarray, least: np.ndarray, more: np.ndarray, more_least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted lists of distinct strings, each with a number; equal strings keep the smaller number."""
    at = np.searchsorted(strings, more)
    found = np.zeros(len(more), dtype=bool)
    inside = at < len(strings)
    found[inside] = strings[at[inside]] == more[inside]
    least = least.copy()
    least[at[found]] = np.minimum(least[at[found]], more_least[found])
    new = ~found
    return np.insert(strings, at[new], more[new]), np.insert(least, at[new], more_least[new])
