"""Brute-force reference for similarity joins on small fixtures (collects both sides)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame


def brute_force_pairs(left: DataFrame, right: DataFrame | None, method: str, threshold: float,
                      left_id: str = "id", left_text: str = "text") -> list[tuple]:
    """Reference answer in the same compact form, for small fixtures only
    (collects both sides)."""
    def reps(rows):
        groups: dict = {}
        for i, t in rows:
            groups.setdefault(_py_key(t, method), []).append(i)
        return [(min(ids), len(ids), key) for key, ids in groups.items()]

    lrows = reps([(r[left_id], r[left_text]) for r in left.collect()])
    rrows = lrows if right is None else reps([(r[left_id], r[left_text]) for r in right.collect()])
    pairs = itertools.combinations(lrows, 2) if right is None else itertools.product(lrows, rrows)
    out = []
    for a, b in pairs:
        if right is None and a[0] > b[0]:
            a, b = b, a
        s = _py_similarity(a[2], b[2], method)
        if s >= threshold - 1e-12:
            out.append((a[0], b[0], round(s, 9), a[1], b[1]))
    return sorted(out)


def _py_key(text: str, method: str):
    if method == "cosine":
        return frozenset(text.lower())
    if method == "jaccard":
        return frozenset(text.lower().split())
    return text


def _py_similarity(a, b, method: str) -> float:
    if method in ("cosine", "jaccard"):
        u = len(a | b)
        return 0.0 if u == 0 else len(a & b) / u
    m = max(len(a), len(b))
    if m == 0:
        return 1.0
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return 1 - prev[-1] / m
