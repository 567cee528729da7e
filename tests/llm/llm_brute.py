"""Brute-force versions that several tests use."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_groups(rows, k, num, den):
    """(id, set size, smallest id reachable) by comparing every pair that shares a shingle."""
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in held[x])
        for x in s:
            held[x].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
