"""Plain-Python answers for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows):
    """rows of (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_words(rows, size=35):
    """rows of (key, text) -> {key: (n_words, kept words)}"""
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[i:i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for key, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out[key] = (len(w), [x for x, g in zip(w, gone) if not g])
    return out


def dropped_lines(rows, min_chars=20, min_docs=3):
    """rows of (doc_id, text) with distinct ids -> {doc_id: (n_lines, n_dropped, kept text)}"""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out
