"""Embedding dedup against all pairs."""

import math

import numpy as np
import pytest

from tessera.llm import embedding_dedup
from tests.llm.helpers import components, cosine_links, frame

SCHEMA = "vec_id long, embedding array<float>, label int, key string, w int"


def check(spark, vectors: dict, **sizes):
    found = embedding_dedup.components(frame(spark, [(i, v, None, "k", 1) for i, v in vectors.items()], SCHEMA), **sizes).collect()
    as_stored = {i: v and [None if x is None else float(np.float32(x)) for x in v] for i, v in vectors.items()}
    links = cosine_links(as_stored, 0.95)
    least = components(list(vectors), links)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == {i: (sum(i in e for e in links), least[i], least[i] == i) for i in vectors}
    assert len(found) == len(vectors)


def clouds(n: int, dim: int, seed: int) -> dict[int, list[float]]:
    """Vectors around a few centres at many distances, some of them copies of others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = {}
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.2, 0.3, 0.6, 2.0])
        out[i] = (v * rng.choice([1.0, 3.0, 1e-6])).tolist()
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell": 20, "block": 7}, {"cell": 60, "block": 1000}, {"cell": 1, "block": 30}, {"cell": 10**6, "block": 64}])
def test_all_links_in_any_partition(spark, sizes):
    check(spark, clouds(160, 8, 3), **sizes)


def test_one_large_group(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=12)
    vectors = {i: (centre + rng.normal(size=12) * 0.05).tolist() for i in range(120)} | {200 + i: rng.normal(size=12).tolist() for i in range(30)}
    check(spark, vectors, cell=25, block=10)


def test_no_value_no_link(spark):
    check(spark, {1: [1.0, 0.0], 2: None, 3: [], 4: [0.0, 0.0], 5: [float("nan"), 1.0], 6: [float("inf"), 1.0], 7: [1.0, None], 8: [2.0, 0.0], 9: [1.0], 10: [3.0], 11: [1e30, 1e-30], 12: [1.0, 0.001]})


def test_repeated_ids_nulls_and_empty(spark):
    rows = embedding_dedup.components(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [5.0, -1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in rows) == [("1", 2, 1), ("1", 2, 1), ("4", 0, 4), ("None", 2, 1)]
    assert embedding_dedup.components(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_doubles_near_the_threshold(spark):
    """Double precision decides: two pairs a hair over and under 0.95."""
    at = float(np.arccos(0.95))
    vectors = {1: [1.0, 0.0, 0.0], 2: [math.cos(at - 1e-9), math.sin(at - 1e-9), 0.0], 11: [0.0, 0.0, 1.0], 12: [0.0, math.sin(at + 1e-9), math.cos(at + 1e-9)]}
    found = embedding_dedup.components(frame(spark, list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 11: 11, 12: 12}
