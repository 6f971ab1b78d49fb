"""Filling containers of fixed capacity: large-item matching on a histogram of sizes, then exact assignment of every item.

Sizes are whole numbers up to the capacity, so the plan needs only how many items there are of each size - at most
capacity + 1 numbers, whatever the number of items. The plan says, for runs of equal items, into which run of equal
containers they go; items find their place by their rank among the items of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import NamedTuple


class Run(NamedTuple):
    """`count` items of one size, by rank from `rank`, `each` to a container from `container` on."""

    size: int
    rank: int
    count: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs for all items (sizes 1..capacity; size 0 goes to container 0) and the number of containers.

    Items above a third of the capacity are matched greedily: the largest with the largest other one that still fits
    beside it, at most two of them in a container. The others go, largest first, where they fit best; a container that
    is opened for them is filled the same way.
    """
    runs: list[Run] = []
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    ranks = dict.fromkeys(left, 0)
    containers = 0
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first container, how many]
    order: list[int] = []  # gaps in use, ascending

    def free(gap: int, first: int, many: int) -> None:
        if many > 0 and gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, many])

    def put(size: int, count: int, container: int, each: int = 1) -> None:
        runs.append(Run(size, ranks[size], count, container, each))
        ranks[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        big = large[-1]
        if not left[big]:
            large.pop()
            continue
        k = bisect_left(large, capacity - big + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k = bisect_left(large, capacity - big + 1) - 1
        if k < 0:  # nothing large fits beside it
            n = left[big]
            put(big, n, containers)
            free(capacity - big, containers, n)
            containers += n
            continue
        other = large[k]
        if other == big:
            n = left[big] // 2
            if n:
                put(big, 2 * n, containers, 2)
                free(capacity - 2 * big, containers, n)
                containers += n
            if left[big]:
                rest = [s for s in large[:k] if left[s]]
                put(big, 1, containers)
                gap = capacity - big
                if rest:
                    put(rest[-1], 1, containers)
                    gap -= rest[-1]
                free(gap, containers, 1)
                containers += 1
            continue
        n = min(left[big], left[other])
        put(big, n, containers)
        put(other, n, containers)
        free(capacity - big - other, containers, n)
        containers += n
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            k = bisect_left(order, size)
            if k == len(order):
                each = capacity // size
                n = -(-left[size] // each)
                free(capacity, containers, n)
                containers += n
                continue
            gap = order[k]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            each = gap // size
            full = min(many, left[size] // each)
            if full:
                put(size, full * each, first, each)
                free(gap - each * size, first, full)
            if full < many and 0 < left[size] < each:
                n = left[size]
                put(size, n, first + full, n)
                free(gap - n * size, first + full, 1)
                full += 1
            free(gap, first + full, many - full)
    if histogram.get(0) and not containers:
        containers = 1
    return runs, containers
