"""Brute force that the operators are held against."""

from __future__ import annotations

import numpy as np


def components(ids: list, links: list[tuple]) -> dict:
    """The smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


def cosine_links(vectors: dict[int, list | None], least: float) -> list[tuple[int, int]]:
    good = {}
    for i, v in vectors.items():
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= least]
