"""Slow, plain counterparts of the operators."""

from __future__ import annotations

import re
from itertools import combinations

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return W.findall((text or "").translate(LOW))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_classes(docs):
    """doc id -> (class, links) by comparing all pairs; docs: [(id, text)] with different ids."""
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root, links = {d: d for d, _ in docs}, {d: 0 for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and inter >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d, _ in docs}


def kept_lines(docs):
    """doc id -> numbers of the lines that go; docs: [(id, text)]."""
    gone, lines = {}, []
    for d, t in sorted(docs, key=lambda r: r[0]):
        for no, raw in enumerate((t or "").split("\n") if t is not None else []):
            line = " ".join(raw.lower().split())
            if len(line.split()) >= 5:
                lines.append((d, no, line))
    by_len = {}
    for d, no, line in lines:
        near = any(p == line or levenshtein(p, line) <= 1 for k in (len(line) - 1, len(line), len(line) + 1)
                   for p in by_len.get(k, ()) if _could(p, line))
        if near:
            gone.setdefault(d, set()).add(no)
        by_len.setdefault(len(line), set()).add(line)
    return gone


def _could(a, b):
    """Cheap and exact: one edit leaves the first or the last half of the shorter one."""
    h = min(len(a), len(b)) // 2
    rest = min(len(a), len(b)) - h
    return a[:h] == b[:h] or a[len(a) - rest:] == b[len(b) - rest:]
