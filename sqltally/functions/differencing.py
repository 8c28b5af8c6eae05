"""Splitting lengths into groups of similar total by largest differencing.

A state is a list of ``k`` group sums, largest first.  The two states of largest spread are merged, the
largest sum of one with the smallest of the other, until one is left.  ``Merged`` states remember which
sums they came from, so the groups are read off from the last state down.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

#: Batches of at most so many rows are split exactly, by trying all splits.
EXACT_ROWS = 10


def difference(states: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(group of each entry of each state, group sums), groups in order of falling sums."""
    orders = [np.argsort(-s, kind="stable") for s in states]
    sums = [s[o] for s, o in zip(states, orders)]
    heap = [(int(s[-1] - s[0]), -int(s[0]), n) for n, s in enumerate(sums)]
    heapq.heapify(heap)
    parts: list[tuple] = [()] * len(states)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        sums.append(joined[order])
        parts.append((a, b, order))
        sums[a] = sums[b] = None
        s = sums[-1]
        heapq.heappush(heap, (int(s[-1] - s[0]), -int(s[0]), len(sums) - 1))
    labels: list = [None] * len(parts)
    labels[-1] = np.arange(len(sums[-1]))
    for n in range(len(parts) - 1, len(states) - 1, -1):
        a, b, order = parts[n]
        back = np.empty_like(order)
        back[order] = labels[n]  # group of each place before sorting
        labels[a], labels[b], labels[n] = back, back[::-1], None
    groups = []
    for n, order in enumerate(orders):
        back = np.empty_like(order)
        back[order] = labels[n]
        groups.append(back)
    return groups, sums[-1]


def dealt(size: int, k: int, first: int = 0) -> np.ndarray:
    """Groups of ranks dealt back and forth, from rank ``first`` on."""
    rank = np.arange(first, first + size)
    place = rank % k
    return np.where(rank // k % 2 == 0, place, k - 1 - place)


def exact(lengths: np.ndarray, k: int, equal: bool) -> np.ndarray:
    """Groups of least spread over all splits; meant for a handful of lengths, longest first."""
    items = lengths.tolist()
    room = len(items) // k if equal else len(items)
    mean = sum(items) // k  # the least group is at most that
    sums, counts, chosen = [0] * k, [0] * k, [0] * len(items)
    best: list = [None, None]

    def place(n: int) -> None:
        if best[0] is not None and max(sums) - mean >= best[0]:
            return
        if n == len(items):
            spread = max(sums) - min(sums)
            if best[0] is None or spread < best[0]:
                best[:] = [spread, list(chosen)]
            return
        tried = set()
        for g in range(k):
            if counts[g] < room and (sums[g], counts[g]) not in tried:
                tried.add((sums[g], counts[g]))
                sums[g] += items[n]
                counts[g] += 1
                chosen[n] = g
                place(n + 1)
                sums[g] -= items[n]
                counts[g] -= 1

    place(0)
    return np.array(best[1], np.int64)


def split(lengths: np.ndarray, k: int, equal: bool, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, sums, sums when dealt) of lengths that are sorted, longest first.

    ``first`` is the rank of the first of them in their batch.  With ``equal`` the lengths are differenced in
    rows of ``k`` neighbours, one for each group, so that counts stay equal.
    """
    size = len(lengths)
    deal = dealt(size, k, first)
    sums_dealt = np.bincount(deal, lengths, k).astype(np.int64) if size else np.zeros(k, np.int64)
    if equal and size % k == 0:
        states = list(lengths.reshape(-1, k))
        found = difference(states) if states else ([], np.zeros(k, np.int64))
    else:
        single = np.zeros((size, k), np.int64)
        single[:, 0] = lengths
        found = difference(list(single)) if size else ([], np.zeros(k, np.int64))
        found = [g[:1] for g in found[0]], found[1]
    groups = np.concatenate(found[0]) if size else np.zeros(0, np.int64)
    return groups, found[1], sums_dealt


def better(sums: np.ndarray, sums_dealt: np.ndarray, strict: bool) -> bool:
    """Whether differenced groups are no worse than dealt ones; ``strict`` looks at both ends, not at the spread."""
    if strict:
        return sums.max() <= sums_dealt.max() and sums.min() >= sums_dealt.min()
    return sums.max() - sums.min() <= sums_dealt.max() - sums_dealt.min()


def best_split(lengths: np.ndarray, k: int, equal: bool, strict: bool = False, exact_rows: int = EXACT_ROWS) -> np.ndarray:
    """Groups of a whole batch: exact for a handful of rows, else the better of differencing and dealing.

    With ``equal`` a batch that does not divide is dealt, so that counts differ by one at most.
    """
    if equal and len(lengths) % k:
        return dealt(len(lengths), k)
    if len(lengths) <= exact_rows and not strict:
        return exact(lengths, k, equal)
    groups, sums, sums_dealt = split(lengths, k, equal)
    return groups if better(sums, sums_dealt, strict) else dealt(len(lengths), k)
