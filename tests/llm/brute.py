"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, words=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}


def near_duplicates(docs: dict, percent: int):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    meet = {p for ids in by.values() for p in combinations(sorted(ids), 2)} if max(map(len, by.values()), default=0) < 400 else set(combinations(sorted(sets), 2))
    links = [(a, b) for a, b in meet if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def repeats(docs: dict, length: int = 100):
    """{id: (n_bytes, n_removed, n_spans, kept bytes)}; ids in order."""
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out
