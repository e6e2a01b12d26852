"""Merges within one pre-token."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

Pair = tuple[bytes, bytes]


def merged(piece: bytes, rank: dict[Pair, int], merges: list[Pair]) -> list[bytes]:
    """Tokens of a pre-token, in n log n steps: rank by rank, all places that had the rank's pair when its turn came.

    Tokens are a chain over the places where they begin; a place that an earlier merge changed has another pair and is passed over.
    """
    token: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    waiting: defaultdict = defaultdict(list)
    ranks: list[int] = []

    def wait(at: int) -> None:
        if at >= 0 and after[at] < len(token):
            found = rank.get((token[at], token[after[at]]))
            if found is not None:
                if found not in waiting:
                    heappush(ranks, found)
                waiting[found].append(at)

    for at in range(len(token) - 1):
        wait(at)
    while ranks:
        lowest = heappop(ranks)
        pair = merges[lowest]
        for at in sorted(set(waiting.pop(lowest))):
            right = after[at]
            if right < len(token) and (token[at], token[right]) == pair:
                token[at], token[right] = pair[0] + pair[1], None
                after[at] = after[right]
                if after[at] < len(token):
                    before[after[at]] = at
                wait(before[at])
                wait(at)
    return [t for t in token if t is not None]
