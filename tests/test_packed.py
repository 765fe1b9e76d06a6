"""Neighbours as packed blocks: what plain versions over sets give, however they are cut."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from weft.operators import degrees, paths
from weft.plans import packed
from weft.plans.graph import Graph

EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"
NODES = "id string, label string, data map<string,string>, weight double"


class NoPairs(Graph):
    """Fails where a row is asked for each two members of an edge."""

    @property
    def cliq(self):
        raise AssertionError("a row for each pair")

    links = adj = cliq


def some(spark, seed, n=40, edges=60):
    rng = random.Random(seed)
    ids = [f"n{k}" for k in range(n)]
    sets = [sorted(rng.sample(ids[: n - 3] + ["gone"], rng.choice([1, 2, 2, 3, 5]))) for _ in range(edges)]
    g = NoPairs(spark.createDataFrame([(i, i, {}, 1.0) for i in ids], NODES), spark.createDataFrame([(f"e{k}", s[:1], s[1:], "x", 1.0) for k, s in enumerate(sets)], EDGES))
    return g, ids, sets


def test_numbers_that_are_squeezed_come_back():
    for a in ([], [0], [5, 0, 2**32 - 1], [2**40, 1]):
        assert packed.unsqueeze(packed.squeeze(np.array(a, np.int64))).tolist() == a


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_without_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(packed.packed, "__defaults__", (None, 50, 30))
    g, ids, sets = some(spark, seed)
    now = {i: i for i in ids}
    for _ in range(5):
        votes = {i: Counter() for i in ids}
        for s in sets:
            for a, b in itertools.permutations([x for x in s if x in votes], 2):
                votes[a][now[b]] += 1
        now = {i: min(votes[i], key=lambda c: (-votes[i][c], c)) if votes[i] else now[i] for i in ids}
    got = paths.label_propagation(g).collect()
    assert {r.id: r.community for r in got} == now and len(got) == len(ids)


@pytest.mark.parametrize("cut", [(7, 3, 2, 5), (1000, 128, 15, 2_000_000)])
def test_triangles_without_wedges(spark, monkeypatch, cut):
    monkeypatch.setattr(packed.packed, "__defaults__", (None, 50, 30))
    monkeypatch.setattr(packed.triangles, "__defaults__", cut)
    g, ids, sets = some(spark, 3)
    near = {i: set() for i in [*ids, "gone"]}
    for s in sets:
        for a, b in itertools.permutations(s, 2):
            near[a].add(b)
    want = {i: (len(near[i]), sum(b in near[a] for a, b in itertools.combinations(near[i], 2))) for i in ids}
    got = degrees.triangles(g).collect()
    assert {r.id: (r.k, r.triangles) for r in got} == want and len(got) == len(ids)
    assert all(abs(r.clustering - (2 * r.triangles / (r.k * (r.k - 1)) if r.k > 1 else 0)) < 1e-12 for r in got)
