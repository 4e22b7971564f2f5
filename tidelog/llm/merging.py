"""Pair merging with a heap and a linked list, shared by the token operators."""

from __future__ import annotations

import heapq


def merge(symbols: list, ranks: dict) -> list:
    """The symbols left after all merges; symbols are strings or byte strings.

    Always the adjacent pair whose concatenation has the lowest rank goes
    first, the leftmost of equals before the others. Neighbours are linked by
    index, and a heap entry whose symbols have changed meanwhile is skipped, so
    n symbols take O(n log n) however long the text is.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    own: list = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        both = own[i] + own[i + 1]
        if both in ranks:
            heap.append((ranks[both], i, len(both)))
    heapq.heapify(heap)
    while heap:
        _, left, size = heapq.heappop(heap)
        right = after[left]
        if own[left] is None or right >= n or len(own[left]) + len(own[right]) != size:
            continue
        own[left] += own[right]
        own[right] = None
        follower = after[left] = after[right]
        if follower < n:
            before[follower] = left
            both = own[left] + own[follower]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], left, len(both)))
        leader = before[left]
        if leader >= 0:
            both = own[leader] + own[left]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], leader, len(both)))
    return [s for s in own if s is not None]
