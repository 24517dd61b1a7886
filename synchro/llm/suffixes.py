"""Suffix arrays of byte strings by two-stage sorting, to a bounded depth.

A suffix is small if it is less than its successor (the suffix one byte on), else large.  Only small suffixes
are sorted directly.  A scan over the buckets of the first byte, in order, then puts each
large suffix in its place: it follows its own first byte's bucket in the order of its successors, which stand in an earlier bucket,
or earlier in the same one.  Small suffixes are sorted by DEPTH bytes, so all are.
"""

from __future__ import annotations

import numpy as np

#: Bytes by which suffixes are in order; ties beyond them stay open.
DEPTH = 56


def words_at(data: np.ndarray, swapped: bool = False) -> np.ndarray:
    """The eight bytes at each place as one integer, zeros after the end; swapped: in the order of bytes, the first one highest."""
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    out = np.empty((len(padded) // 8 - 2) * 8, np.uint64)
    for j in range(8):
        out[j::8] = padded[j : j + len(out)].view(np.uint64)
    out = out[: len(data)]
    return out.byteswap() if swapped else out


def small(data: np.ndarray) -> np.ndarray:
    """True where a suffix is less than its successor; the last place, a zero, is small."""
    n = len(data)
    step = np.ones(n, np.int8)  # the last one stays
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the next place where a run of one byte ends
    return step[decided] > 0


def _direct(places: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places sorted by the DEPTH bytes there; word has DEPTH places more than the bytes."""
    order = places[np.argsort(word[places], kind="stable")]
    group = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    at = 0
    while len(tied):
        # places of a group that differ in the word at this depth part
        key = word[order[tied] + at]
        new = np.ones(len(tied), bool)
        new[1:] = (group[tied][1:] != group[tied][:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(tied)])))
        tied = tied[np.repeat(size > 1, size)]
        at += 8
        if at >= DEPTH:
            break
        own = order[tied]
        order[tied] = own[np.lexsort((word[own + at], group[tied]))]
    return order


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places where `wanted` is true, in the order of their suffixes' first DEPTH bytes."""
    if not wanted.any():
        return np.zeros(0, np.int64)
    data, wanted = np.append(data, np.uint8(0)), np.append(wanted, False)
    less = small(data)
    # a large suffix is placed by its successor, so the places up to the next small one are needed too
    n = len(data)
    stop = np.minimum.accumulate(np.where(less, np.arange(n), n - 1)[::-1])[::-1]
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    size = stop[last] - last
    needed = wanted.copy()
    needed[np.repeat(last, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1] = True
    large = needed & ~less
    word = np.concatenate((words_at(data, swapped=True), np.zeros(DEPTH, np.uint64)))
    direct = _direct(np.flatnonzero(needed & less), word)
    heads = data[direct]
    edges = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = waiting[c]
        grown = np.concatenate(own) if own else np.zeros(0, np.int64)
        while len(grown):  # runs of c: each place puts the one before it
            before = grown[grown > 0] - 1
            grown = before[large[before] & (data[before] == c)]
            if len(grown):
                own.append(grown)
        own.append(direct[edges[c] : edges[c + 1]])
        whole = np.concatenate(own)
        out.append(whole)
        waiting[c] = []
        before = whole[whole > 0] - 1
        before = before[large[before] & (data[before] > c)]
        if len(before):
            head = data[before]
            order = np.argsort(head, kind="stable")
            before, head = before[order], head[order]
            cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[data[part[0]]].append(part)
    out = np.concatenate(out)
    return out[wanted[out]]


def alike(order: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each place and the one before it in the order reaches `length` bytes (at least 8); false for the first."""
    word = np.concatenate((words_at(data), np.zeros(length, np.uint64)))
    same = np.ones(max(0, len(order) - 1), bool)
    left = np.arange(len(same))
    for k in [*range(0, length - 8, 8), length - 8]:
        ok = word[order[left] + k] == word[order[left + 1] + k]
        same[left[~ok]] = False
        left = left[ok]
    return np.concatenate(([False], same)) if len(order) else same
