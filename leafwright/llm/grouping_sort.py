"""Suffix sorting by linear grouping.

Suffixes are grouped by their Lyndon prefix (the longest prefix that is smaller than all its proper suffixes). Groups
start as those of the first symbol and are processed in descending order. For each suffix of the current group the
previous-smaller pointer finds the nearest suffix to its left in a lower group; that suffix's Lyndon prefix ends here
and goes on with the current group's, so it leaves its group for a new one right above the rest. Suffixes that are
pointed to more often repeat the current prefix more often and go higher. After the pass each group holds one Lyndon
prefix. The second pass walks the suffixes in ascending order; each one places, by the same pointers, the suffixes
whose Lyndon prefix ends where it begins at the front of their groups. No symbol or group is renamed recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Places of the suffixes of text in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, n)))
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    group, slots, place = np.empty(n, np.int64), order.tolist(), where.tolist()
    group[order] = begin
    group = group.tolist()  # each suffix's group, named by the group's first slot
    end = [0] * n  # of each group, its last slot
    for a, b in zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True):
        end[a] = b - 1
    left = [-1] * n  # previous-smaller pointers
    top = n - 1
    while top > 0:
        low = group[slots[top]]
        times: dict[int, int] = {}
        for i in sorted(slots[low : top + 1]) if top > low else slots[low : low + 1]:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = left[p]
            left[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            for k in range(most, 0, -1):
                moved = [p for p, t in times.items() if t == k] if most > 1 else list(times)
                last = {}
                for p in moved:
                    g = group[p]
                    e = end[g]
                    last.setdefault(g, e)
                    a, other = place[p], slots[e]
                    slots[a], slots[e] = other, p
                    place[other], place[p] = a, e
                    end[g] = e - 1
                for p in moved:
                    group[p] = end[group[p]] + 1 if group[p] in last else group[p]
                for g, e in last.items():
                    end[end[g] + 1] = e if end[g] >= g else e
        top = low - 1
    free = list(range(n))
    out, placed = [n - 1] * n, [False] * n
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = left[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in the order but the first, the length of the prefix shared with the one before."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
