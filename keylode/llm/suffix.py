"""Suffix arrays by linear grouping.

Phase 1 groups suffixes by their longest Lyndon prefix: groups are processed in descending order; each
member points to the nearest earlier suffix of a smaller group (its previous-smaller pointer), and the
suffixes pointed at move up to new groups just above their own, those pointed at more often higher.
Phase 2 goes through the order once and emits each group's: the suffix before a sorted one, and on along
the previous-smaller pointers, takes the next place of its group.  Nothing is renamed or recursed into.

Work and space are linear: symbols are numbered and dealt out by counting, a group's members need no order
(pointers into their own group are resolved once each), and counts of pointers are gone through by size.
"""

from __future__ import annotations


def numbers(symbols: list[int]) -> tuple[list[int], int]:
    """Symbols as numbers from 1 in their order, by counting where their range is no wider than a few times
    their count; and how many numbers there are."""
    low, high = min(symbols, default=0), max(symbols, default=0)
    if high - low <= 8 * len(symbols) + 1024:
        rank = [0] * (high - low + 1)
        for x in symbols:
            rank[x - low] = 1
        k = 0
        for i, there in enumerate(rank):
            if there:
                k += 1
                rank[i] = k
        return [rank[x - low] for x in symbols], k
    order = {x: k for k, x in enumerate(sorted(set(symbols)), 1)}  # symbols far apart: their distinct values alone are sorted
    return [order[x] for x in symbols], len(order)


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; a suffix that is another's prefix comes first.

    Equal inputs give equal outputs; an empty list has none.
    """
    s, k = numbers(symbols)
    s.append(0)  # the end is smaller than all
    n = len(s)
    first = [0] * (k + 2)
    for x in s:
        first[x + 1] += 1
    for x in range(k + 1):
        first[x + 1] += first[x]
    free = first.copy()
    order, place, group, last = [0] * n, [0] * n, [0] * n, [0] * n
    for i, x in enumerate(s):
        at = free[x]
        free[x] = at + 1
        order[at], place[i], group[i] = i, at, first[x]
    for x in range(k + 1):
        last[first[x]] = first[x + 1] - 1

    previous = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:
            x = order[end]
            p = x - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[x] = p
            if p >= 0:  # one member: the suffix it points at moves alone
                old = group[p]
                to = last[old]
                if old != to:
                    y, at = order[to], place[p]
                    order[at], order[to] = y, p
                    place[y], place[p] = at, to
                    last[old] = to - 1
                    group[p] = to
                    last[to] = to
            end -= 1
            continue
        members = order[g : end + 1]
        for x in members:
            p = x - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[x] = p
        counts: dict[int, int] = {}
        for x in members:
            p, path = previous[x], [x]
            while p >= 0 and group[p] == g:  # along the group's own members to the first pointer out of it
                path.append(p)
                p = previous[p]
            for y in path:
                previous[y] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        by_count: list[list[int]] = [[] for _ in range(max(counts.values(), default=0) + 1)]
        for p, k in counts.items():
            by_count[k].append(p)
        for members in reversed(by_count):
            moved: dict[int, int] = {}
            for p in members:
                old = group[p]
                to = last[old] - moved.get(old, 0)
                y, at = order[to], place[p]
                order[at], order[to] = y, p
                place[y], place[p] = at, to
                moved[old] = moved.get(old, 0) + 1
            for old, m in moved.items():
                to = last[old]
                new = to - m + 1
                if new != old:
                    last[old] = new - 1
                    last[new] = to
                    for i in range(new, to + 1):
                        group[order[i]] = new
        end = g - 1

    out, put, next_place = [0] * n, [False] * n, list(range(n))
    out[0] = n - 1
    put[n - 1] = True
    for i in range(n):
        x = out[i] - 1
        while x >= 0 and not put[x]:
            g = group[x]
            out[next_place[g]] = x
            next_place[g] += 1
            put[x] = True
            x = previous[x]
    return out[1:]
