"""Operators of graphs against plain versions on small random graphs, and their empty cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import belief, blocks, centrality, paths, retrieval, rewriting, states
from weft.plans.graph import Graph

EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"
NODES = "id string, label string, data map<string,string>, weight double"


def graph(spark, pairs, ids):
    nodes = spark.createDataFrame([(i, i, {"k": i[0]}, 1.0) for i in ids], NODES)
    return Graph(nodes, spark.createDataFrame([(f"{a}-{b}", [a], [b], "x", 1.0) for a, b in pairs], EDGES))


def reach(pairs, start, without=()):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, stack = {start}, [start]
    while stack:
        for x in near.get(stack.pop(), ()):
            if x not in seen and x not in without:
                seen.add(x)
                stack.append(x)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"{c}{k}" for k in range(2) for c in "abcdefghij"]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(21)})
    cut = {x for x in ids if any(b not in reach(pairs, a, {x}) for a, b in itertools.combinations([i for i in ids if i != x and i in reach(pairs, x)], 2))}
    g = graph(spark, pairs, ids)
    assert {r.id for r in blocks.articulation_points(g).collect()} == cut
    # links are of one block if they meet in a node without which their other ends are connected
    of = {p: p for p in pairs}
    for _ in pairs:
        for p, q in itertools.combinations(pairs, 2):
            for x in set(p) & set(q):
                (a,), (b,) = set(p) - {x}, set(q) - {x}
                if b in reach(pairs, a, {x}):
                    of[p] = of[q] = min(of[p], of[q])
    want = {}
    for p, c in of.items():
        want.setdefault(c, set()).update(p)
    got = {}
    for r in blocks.biconnected(g).collect():
        got.setdefault(r.block, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(3)
    ids = [f"{c}{k}" for k in range(2) for c in "abcdefghij"]
    arcs = sorted({tuple(rng.sample(ids, 2)) for _ in range(30)})
    far = {i: {i} for i in ids}
    for _ in ids:
        for a, b in arcs:
            for i in ids:
                if a in far[i]:
                    far[i].add(b)
    want = {i: min(j for j in far[i] if i in far[j]) for i in ids}
    assert {r.id: r.component for r in paths.strong_components(graph(spark, arcs, ids)).collect()} == want


def test_similar_sets_miss_no_pair(spark):
    rng = random.Random(4)
    sets = {k: rng.sample(range(30), rng.randint(1, 12)) for k in range(80)}
    rows = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()], "id int, items array<string>")
    for least in (0.2, 0.5, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        assert {(r.a, r.b) for r in states.similar_sets(rows, least).collect()} == want


def test_similar_data_misses_no_pair(spark):
    rng = random.Random(5)
    data = {f"n{k}": {f: rng.choice("xyz") for f in "abcde"} for k in range(40)}
    nodes = spark.createDataFrame([(i, i, d, 1.0) for i, d in data.items()], NODES)
    g = Graph(nodes, spark.createDataFrame([], EDGES))
    for least in (0.4, 0.6, 0.8, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sorted(data), 2) if sum(data[a][f] == data[b][f] for f in "abcde") / 5 >= least}
        assert {(r.a, r.b) for r in rewriting.similar_data(g, least).collect()} == want


def test_pairs_of_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id int, embedding array<double>")
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if u[a] @ u[b] >= 0.6}
    assert {(r.a, r.b) for r in retrieval.similar_pairs(rows, 0.6, block=13).collect()} == want
    best = {(q, int(i)) for q in range(60) for i in np.argsort(-(u @ u[q]))[1:4]}
    assert {(r.query, r.id) for r in retrieval.similar(rows, rows, 3).collect()} == best


def test_entropy_of_a_mixed_state(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4))
    rho = a @ a.conj().T
    rho /= np.trace(rho).real
    rows = spark.createDataFrame([("s", str(i), str(j), float(rho[i, j].real), float(rho[i, j].imag)) for i in range(4) for j in range(4)], "state_id string, i string, j string, re double, im double")
    p = np.linalg.eigvalsh(rho)
    assert abs(belief.von_neumann_entropy(rows).first()["entropy"] + (p * np.log2(p)).sum()) < 1e-9


def test_empty_graph(spark):
    g = graph(spark, [], ["a"])
    g = Graph(g.nodes.where(F.lit(False)), g.edges)
    assert blocks.biconnected(g).collect() == [] and blocks.articulation_points(g).collect() == []
    assert paths.strong_components(g).collect() == [] and paths.label_propagation(g).collect() == []
    assert centrality.eigenvector(g, 2).collect() == [] and rewriting.apply_generalization(g).edges.collect() == []
