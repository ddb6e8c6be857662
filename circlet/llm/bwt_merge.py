"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards: for small inputs, to measure and to check by.

Every shard sorts its own suffixes.  The transforms are then merged without
sorting suffixes again: the interleave says of each place in the merged order
which shard it comes from, and a round refines it by one more byte (a stable
distribution of the places by the bytes before them).  After h rounds the
merged order is right for the first h bytes, and places whose suffixes have
these bytes in common form an interval; after ``length`` rounds the intervals
are the repeated strings.  See the README on why ``suffix_dedup`` doesn't work
so over a corpus.

Documents end in a byte of their own kind that equals no other, so that matches
never cross them.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffixes of an array of ranks, sorted, by doubling."""
    rank, width, n = np.unique(data, return_inverse=True)[1].astype(np.int64), 1, len(data)
    while True:
        after = np.full(n, -1)
        after[: n - width] = rank[width:]
        order = np.lexsort((after, rank))
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank[order] = np.cumsum(new)
        width *= 2
        if rank.max() == n - 1 or width >= n:
            return order


def merged(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """The interleave, the interval of each place, each shard's suffix order, and the rounds taken.

    shards: bytes as integers from 1; each document ends in 0, and each 0 counts as different from all others.
    """
    orders, before = [], []
    ends = sum(int((s == 0).sum()) for s in shards)
    told = 0
    for s in shards:
        own = s.astype(np.int64) + ends
        zero = np.flatnonzero(s == 0)
        own[zero] = told + np.arange(len(zero))  # ends are told apart, in the order of the documents
        told += len(zero)
        orders.append(suffix_order(own))
        before.append(own[(orders[-1] - 1) % len(s)])
    source = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    interval, rounds = np.zeros(len(source), np.int64), 0
    for _ in range(length):
        rounds += 1
        symbol = np.empty(len(source), np.int64)
        for k, b in enumerate(before):
            symbol[source == k] = b
        place = np.argsort(symbol, kind="stable")
        source, symbol, held = source[place], symbol[place], interval[place]
        new = np.zeros(len(source), np.int64)
        new[1:] = (symbol[1:] != symbol[:-1]) | (held[1:] != held[:-1])
        refined = np.cumsum(new)
        if rounds > 1 and refined[-1] == len(source) - 1:
            interval = refined
            break
        interval = refined
    return source, interval, orders, rounds


def removed(texts: list[bytes], length: int, shard_bytes: int = 1 << 20) -> tuple[list[np.ndarray], int]:
    """For each text which bytes stand in a string of ``length`` that also starts earlier, and the rounds taken.  Texts are in their order."""
    shards, own, held = [], [], 0
    for i, t in enumerate(texts):
        own.append(i)
        held += len(t) + 1
        if held >= shard_bytes or i == len(texts) - 1:
            shards.append(own)
            own, held = [], 0
    if not shards:
        return [], 0
    data = [np.concatenate([np.append(np.frombuffer(texts[i], np.uint8).astype(np.int64) + 1, 0) for i in s]) for s in shards]
    source, interval, orders, rounds = merged(data, length)
    base = np.cumsum([0] + [len(d) for d in data[:-1]])
    start = np.empty(len(source), np.int64)
    for k, order in enumerate(orders):
        start[source == k] = base[k] + order
    # an end stands in one interval with no other place, so that a string never holds one if its interval has two places
    first = np.full(interval.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, interval, start)
    later = np.zeros(len(source) + length, np.int64)
    at = start[start != first[interval]]
    np.add.at(later, at, 1)
    np.add.at(later, at + length, -1)
    gone = np.cumsum(later)[: len(source)] > 0
    out, at = [], 0
    for t in texts:
        out.append(gone[at : at + len(t)])
        at += len(t) + 1
    return out, rounds
