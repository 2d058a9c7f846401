"""Plain versions of the operators, for small tables held in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = words(lowered)
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1)))


def near_duplicates(docs, per_cent=75):
    """docs: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for d in sorted(sets):
        seen = Counter(e for s in sets[d] for e in holders.get(s, ()))
        for e, both in seen.items():
            if 100 * both >= per_cent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def remove_repeats(docs, span=50):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept text)}."""
    least = {}
    for d, t in docs:
        own = words(t)
        for i in range(len(own) - span + 1):
            key = hash(tuple(own[i:i + span]))
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, t in docs:
        own = words(t)
        gone = set()
        for i in range(len(own) - span + 1):
            if least[hash(tuple(own[i:i + span]))] < d:
                gone.update(range(i, i + span))
        out[d] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out


def base_stats(text):
    text = text or ""
    own = words(text)
    triples = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
    seen = Counter(triples)
    again = {j for i, t in enumerate(triples) if seen[t] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(own), "word_chars": sum(map(len, own)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "base_failed": len(own) < 50 or 100 * len(again) > 50 * len(own)}


def budgets(sizes, share=Fraction(3, 2), epochs=2, weights=(3, 1, 2)):
    """sizes: {source: words} -> {source: target}, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, Fraction(0))
    spare, open_ones = share * sum(sizes.values()), set(order)
    while open_ones and spare:
        total = sum(weight[s] for s in open_ones)
        for s in open_ones:
            target[s] += spare * weight[s] / total
        full = {s for s in open_ones if target[s] >= epochs * sizes[s]}
        spare = sum(target[s] - epochs * sizes[s] for s in full)
        for s in full:
            target[s] = Fraction(epochs * sizes[s])
        if not full:
            break
        open_ones -= full
    return target


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
