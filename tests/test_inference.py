"""Flows, partitions, communities and cases of the inference operators, against plain versions."""

import pytest
from pyspark.sql import functions as F

from tests.test_structure import graph, ids
from weft.operators import flows, inference, structure
from weft.plans.graph import Graph
from weft.sources.graphs import trade

SF = "/root/testdata/sf0.001"


def plain_flow(pairs, s, t):
    cap = {}
    for a, b, w in pairs:
        if a != b:
            cap[a, b] = cap.get((a, b), 0) + w
            cap.setdefault((b, a), 0)
    total = 0
    while True:
        seen, queue = {s: None}, [s]
        for at in queue:
            for (a, b), c in cap.items():
                if a == at and c > 1e-9 and b not in seen:
                    seen[b] = a
                    queue.append(b)
        if t not in seen:
            return total, set(seen)
        path, at = [], t
        while at != s:
            path.append((seen[at], at))
            at = seen[at]
        push = min(cap[p] for p in path)
        total += push
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push


def test_max_flow(spark):
    g = graph(spark, [("s", "a"), ("s", "b"), ("a", "b"), ("a", "t"), ("b", "t"), ("x", "s")])
    w = {"s-a": 3.0, "s-b": 2.0, "a-b": 1.5, "a-t": 2.0, "b-t": 3.0}
    edges = g.edges.withColumn("weight", F.coalesce(*[F.when(F.col("edge_id") == k, v) for k, v in w.items()], F.lit(1.0)))
    value, flow, side = flows.max_flow(Graph(g.nodes, edges), "s", "t")
    rows = [(r.source_ids[0], r.target_ids[0], r.weight) for r in edges.collect()]
    want, cut = plain_flow(rows, "s", "t")
    assert value == pytest.approx(want) and set(ids(side)) == cut
    net = {}
    for r in flow.collect():
        net[r.src] = net.get(r.src, 0) - r.flow
        net[r.tgt] = net.get(r.tgt, 0) + r.flow
    assert net["t"] == pytest.approx(value) and net["s"] == pytest.approx(-value)
    assert all(abs(v) < 1e-9 for n, v in net.items() if n not in "st")


def test_max_flow_without_a_path(spark):
    value, flow, side = flows.max_flow(graph(spark, [("a", "b"), ("c", "d")]), "a", "d")
    assert value == 0 and flow.count() == 0 and ids(side) == ["a", "b"]


def two_cliques(spark):
    pairs = [(a, b) for k in ("abcd", "wxyz") for i, a in enumerate(k) for b in k[i + 1 :]]
    return graph(spark, [*pairs, ("d", "w")])


def test_fiedler_parts_two_cliques(spark):
    rows = {r.id: r.x < 0 for r in flows.fiedler(two_cliques(spark), 10).collect()}
    assert len({rows[i] for i in "abcd"}) == 1 and len({rows[i] for i in "wxyz"}) == 1 and rows["a"] != rows["z"]


def test_algebraic_connectivity(spark):
    import numpy as np

    g = two_cliques(spark)
    order = {i: k for k, i in enumerate(ids(g.nodes))}
    lap = np.zeros((8, 8))
    for r in g.links.collect():
        u, v = order[r.u], order[r.v]
        lap[u, u] += 1
        lap[v, v] += 1
        lap[u, v] = lap[v, u] = -1
    assert flows.algebraic_connectivity(g, 15).first().value == pytest.approx(np.linalg.eigvalsh(lap)[1], rel=1e-3)


def test_local_moves_find_cliques_and_raise_modularity(spark):
    got = {r.id: r.community for r in flows.local_moves(two_cliques(spark), 4).collect()}
    assert {got[i] for i in "abcd"} == {"a"} and {got[i] for i in "wxyz"} == {"w"}
    g = trade(spark, SF)
    alone = structure.modularity(g, g.nodes.select("id", F.col("id").alias("community"))).first().q
    assert structure.modularity(g, flows.local_moves(g, 2)).first().q > alone


def test_hebbian_bounds(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    heat = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.05)], "id string, energy double")
    assert {r.edge_id: round(r.weight, 9) for r in inference.hebbian(g, heat).collect()} == {"a-b": 1.25, "b-c": 0.99}
    assert {round(r.weight, 9) for r in inference.hebbian(g, heat, most=0.5, low=2.0).collect()} == {0.5, 1.0}


def test_collapse_drops_inner_edges(spark):
    g = inference.collapse(graph(spark, [("a", "b"), ("b", "c"), ("c", "d")]), spark.createDataFrame([("a",), ("b",)], "id string"), "S")
    assert sorted((r.edge_id, *r.source_ids, *r.target_ids) for r in g.edges.collect()) == [("b-c", "S", "c"), ("c-d", "c", "d")]
    assert ids(g.nodes) == ["S", "c", "d"]


def test_empty_tables(spark):
    g = graph(spark, [])
    states = spark.createDataFrame([], "state string, parent string, nodes array<string>")
    for df in (inference.forward_chain(g, "x"), inference.open_chains(g), inference.cycles(g), inference.fan_out(g), inference.confidence_paths(g, "a"), inference.ancestors(states), inference.convergent(states), flows.local_moves(g), flows.fiedler(g)):
        assert df.count() == 0
    assert inference.girth(g).first().girth == 0
