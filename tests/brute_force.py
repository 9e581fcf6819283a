"""Plain-Python answers on small inputs."""

from __future__ import annotations

import math
from collections import Counter


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def vector_pairs(vectors: dict, threshold: float) -> dict:
    ids = sorted(vectors)
    found = {}
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            similarity = cosine(vectors[i], vectors[j])
            if similarity >= threshold - 1e-12:
                found[i, j] = similarity
    return found


def tfidf(texts: dict) -> dict:
    counts = {i: Counter(t.lower().split()) for i, t in texts.items()}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    units = {}
    for i, c in counts.items():
        raw = {w: n * math.log((len(counts) + 1) / (df[w] + 1)) for w, n in c.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        units[i] = {w: v / length for w, v in raw.items() if v > 0} if length else {}
    return units


def text_pairs(texts: dict, threshold: float) -> dict:
    units = tfidf(texts)
    ids = sorted(units)
    found = {}
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            similarity = sum(u * units[j].get(w, 0.0) for w, u in units[i].items())
            if similarity >= threshold:
                found[i, j] = similarity
    return found


def components(pairs) -> dict:
    """{member: smallest member of its component}"""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def nearest(vectors: dict, k: int) -> dict:
    out = {}
    for i in vectors:
        order = sorted(vectors, key=lambda j: (round(1 - cosine(vectors[i], vectors[j]), 12), j))
        out[i] = order[:k]
    return out


def dbscan(vectors: dict, eps: float, min_samples: int) -> dict:
    """{id: label}; the vector itself always counts as its neighbour."""
    near = {i: {j for j in vectors if i == j or cosine(vectors[i], vectors[j]) >= 1 - eps} for i in vectors}
    core = {i for i in vectors if len(near[i]) >= min_samples}
    root = components([(i, j) for i in core for j in near[i] & core])
    number = {r: n for n, r in enumerate(sorted(set(root.values())))}
    label = {}
    for i in vectors:
        cores = [number[root[j]] for j in near[i] & core]
        label[i] = number[root[i]] if i in core else min(cores, default=-1)
    return label
