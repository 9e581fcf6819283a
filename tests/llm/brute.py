"""Plain Python versions of the operators, to check against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]")


def exact_dedup(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} of (doc_id, text) rows with unique ids."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc))
    found = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for _, doc in members:
            found[doc] = (keep, len(members), doc == keep, sha)
    return found


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def fingerprint(text):
    paragraphs = []
    for paragraph in text.split("\n"):
        leaves = [s for s in re.split(r"(?<=[.!?] )", paragraph)]
        if len(leaves) > 1 and leaves[-1] == "":
            pass  # Java keeps the empty piece after a final border, too
        inside = " ".join(f"{_h(s)}.{len(s)}" for s in leaves)
        paragraphs.append(f"{_h(inside)}({inside})")
    runs, run = [], []
    for paragraph in paragraphs:
        run.append(paragraph)
        if paragraph[0] in "0123":
            runs.append(",".join(run))
            run = []
    if run:
        runs.append(",".join(run))
    # The hash of an open last run covers its trailing comma.
    heads, tree = "", ""
    for i, text_run in enumerate(runs):
        open_end = bool(run) and i == len(runs) - 1
        head = _h(text_run + ("," if open_end else ""))
        heads += head
        tree += f"{head}[{text_run}]"
    return hashlib.sha256(heads.encode()).hexdigest() + "|" + tree


def likeness(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    one, two = (set(re.findall(r"[0-9a-f]{16}\.[0-9]+", x)) for x in (a, b))
    weight = lambda leaves: sum(int(x.split(".")[1]) for x in leaves)
    return 2 * weight(one & two) / (weight(one) + weight(two))


def edited(rows):
    """{doc_id: (n_chars, edited text, next text)}"""
    rows = sorted((d, t or "") for d, t in rows)
    found = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        found[doc] = (len(text), text[:len(text) - half] + after[:half], after)
    return found


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess round after round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_sources, budget = {}, set(order), share * sum(sizes.values())
    while open_sources:
        part = budget / sum(weight[s] for s in open_sources)
        above = {s for s in open_sources if weight[s] * part > most * sizes[s]}
        if not above:
            return target | {s: weight[s] * part for s in open_sources}
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_sources -= above
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shingles(text, words=5):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    if len(found) < words:
        return Counter([tuple(found)] if found else [])
    return Counter(zip(*[found[i:] for i in range(words)]))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def near_classes(rows, threshold=0.8):
    """{doc_id: class_id} by comparing all pairs that share a shingle."""
    sets = {doc: shingles(text) for doc, text in rows}
    top = {doc: doc for doc in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = defaultdict(list)
    for doc, found in sets.items():
        for s in found:
            holders[s].append(doc)
    tried = set()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    if jaccard(sets[a], sets[b]) >= threshold - 1e-12:
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {doc: find(doc) for doc in sets}


def pieces(text, tokenizer, capacity=2048):
    """[(start, length, crc)] of a text, by the tokenizer library itself."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for a, b in zip(edges, edges[1:])]


def fewest(lengths, capacity):
    """A lower bound: no packing has fewer sequences."""
    return max(math.ceil(sum(lengths) / capacity), sum(1 for n in lengths if 2 * n > capacity))
