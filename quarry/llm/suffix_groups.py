"""Suffix arrays by linear grouping.

Every suffix has a Lyndon prefix, the longest that is a Lyndon word; suffixes of
one Lyndon prefix make a group, and groups in order of their prefixes lie in
the order of the suffix array. Grouping starts from single characters and deals
with groups from the largest down. The suffix before a group's member that is
the nearest with a smaller group is its previous-smaller pointer; a suffix that
is pointed to by k members has a Lyndon prefix that goes on with k copies of
theirs, so those suffixes leave their group for a new one just above it, larger
k higher. Pointers over finished groups are followed, so each step is short.

Then groups are emitted from the smallest up: if s is the next suffix in order,
the suffixes whose Lyndon prefix ends at s, found along the pointers from
s - 1, take the next free places of their groups. Nothing is renamed, and there
is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Order of the suffixes of symbols (integers from 0 on; the last must be 0 and the only 0)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    members, where, group = order.tolist(), place.tolist(), starts[symbols].tolist()
    size = [0] * n
    for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c:
            size[a] = c
    before = [-1] * n
    top = n
    while top > 0:
        low = group[members[top - 1]]
        if top - low == 1:
            s = members[low]
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[s] = p
            if p >= 0:  # one suffix leaves its group
                g = group[p]
                last = g + size[g] - 1
                if last != g:
                    size[g] -= 1
                    a, other = where[p], members[last]
                    members[a], members[last] = other, p
                    where[other], where[p] = a, last
                    group[p] = last
                    size[last] = 1
            top = low
            continue
        times: dict[int, int] = {}
        for s in sorted(members[low:top]):
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            if p >= 0 and group[p] == low:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        top = low
        if not times:
            continue
        if max(times.values()) == 1:
            ranks = (times,)
        else:
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            ranks = tuple(by[k] for k in sorted(by, reverse=True))
        for rank in ranks:
            left = []
            for p in rank:
                g = group[p]
                last = g + size[g] - 1
                size[g] -= 1
                a = where[p]
                if a != last:
                    other = members[last]
                    members[a], members[last] = other, p
                    where[other], where[p] = a, last
                left.append(g)
            # where the rest of each group ends now; a group that left as a whole starts where it was
            for p, new in zip(rank, [g + size[g] for g in left], strict=True):
                group[p] = new
                size[new] += 1
    out, free = [-1] * n, list(range(n))
    out[0] = n - 1
    group[n - 1] = -1
    for i in range(n):
        j = out[i] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            out[free[g]] = j
            free[g] += 1
            group[j] = -1
            j = before[j]
    return out
