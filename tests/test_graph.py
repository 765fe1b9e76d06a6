"""Operators that no SQL is given for, against plain versions on small random graphs; and the edges of the others."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import centrality, degrees, lookup, maintenance, paths, retrieval, rules, search, temporal
from weft.plans.graph import Graph

NODES = "id string, label string, data map<string,string>, weight double"
EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"


def graph(spark, edges, n=None):
    ids = sorted({x for e in edges for x in e[1] + e[2]} | {f"n{k}" for k in range(n or 0)})
    return Graph(spark.createDataFrame([(i, i.upper(), {"kind": i[-1]}, 1.0) for i in ids], NODES), spark.createDataFrame([(e[0], sorted(e[1]), sorted(e[2]), *(e[3:] or ("x", 1.0))) for e in edges], EDGES))


@pytest.fixture(scope="module")
def random_edges():
    rng = random.Random(3)
    ids = [f"n{k}" for k in range(9)]
    return [(f"e{k:02}", rng.sample(ids, rng.randint(1, 2)), rng.sample(ids, rng.randint(1, 3)), rng.choice("xy"), rng.randint(1, 5) / 2) for k in range(12)]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def clique(edges):
    return {(u, v) for e in edges for u, v in itertools.combinations(sorted({*e[1], *e[2]}), 2)}


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def test_minimum_spanning_edges(spark, random_edges):
    g, parent, chosen = graph(spark, random_edges), {}, set()
    for e in random_edges:
        parent |= {x: x for x in e[1] + e[2]}
    pairs = sorted((e[4], e[0], u, v) for e in random_edges for u, v in clique([e]))
    for _, name, u, v in pairs:
        a, b = find(parent, u), find(parent, v)
        if a != b:
            parent[a] = b
            chosen.add(name)
    assert {r[0] for r in rows(paths.minimum_spanning_edges(g))} == chosen


def test_onion_layers(spark, random_edges):
    g, links = graph(spark, random_edges, 11), clique(random_edges)
    left, layer, core, want = {f"n{k}" for k in range(11)}, 1, 0, {}
    while left:
        k = {x: sum(x in p and set(p) <= left for p in links) for x in left}
        core = max(core, min(k.values()))
        gone = {x for x in left if k[x] <= core}
        want |= {x: (layer, core) for x in gone}
        left -= gone
        layer += 1
    assert {r[0]: (r[1], r[2]) for r in rows(paths.onion_layers(g), "id", "layer", "core")} == want


def test_s_persistence_and_components(spark, random_edges):
    g = graph(spark, random_edges)
    members = {e[0]: {*e[1], *e[2]} for e in random_edges}
    top = max(len(members[a] & members[b]) for a, b in itertools.combinations(members, 2))
    want = []
    for s in range(1, top + 1):
        parent = {e: e for e in members}
        for a, b in itertools.combinations(sorted(members), 2):
            if len(members[a] & members[b]) >= s:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
        groups = [find(parent, e) for e in members]
        want.append((s, len(set(groups)), max(map(groups.count, groups))))
        assert {r["edge_id"]: r["component"] for r in paths.s_components(g, s).collect()} == {e: find(parent, e) for e in members}
    assert rows(paths.s_persistence(g)) == want


def test_components_of_a_long_chain(spark):
    g = graph(spark, [(f"e{k:03}", [f"n{k:03}"], [f"n{k + 1:03}"]) for k in range(60)] + [("z", ["z1"], ["z2"])])
    found = {r["id"]: r["component"] for r in paths.connected_components(g).collect()}
    assert found["n060"] == "n000" and found["z2"] == "z1" and len(set(found.values())) == 2


def test_gates(spark):
    g = graph(spark, [("e", ["a", "b", "c"], ["t"], "x", 1.0)])
    seed = lambda **e: spark.createDataFrame(list(e.items()), "id string, energy double")
    out = lambda mode, **e: {r["id"]: round(r["energy"], 6) for r in retrieval.diffuse(g, seed(**e), mode, 1).collect()}.get("t", 0)
    assert out("linear", a=0.9) == round(0.3 * 0.85, 6)
    assert out("and", a=0.9, b=0.9) == 0 and out("and", a=0.9, b=0.9, c=0.9) == round(0.9 * 0.85, 6)
    assert out("or", a=0.9, b=0.3) == round(0.9 * 0.85, 6)
    assert out("majority", a=0.9) == 0 and out("majority", a=0.8, b=0.4) == round(0.6 * 0.85, 6)


def test_allen_relations(spark):
    want = {(0, 1): "before", (0, 2): "meets", (0, 3): "overlaps", (2, 3): "starts", (3, 4): "during", (3, 5): "finishes", (2, 5): "equals", (0, 5): "finished_by", (0, 6): "contains", (2, 6): "started_by", (3, 6): "overlapped_by", (5, 6): "met_by", (6, 7): "after", (2, 2): "meets"}
    events = spark.createDataFrame([(f"{a},{b}", float(a), float(b)) for a, b in want], "event_id string, start double, end double")
    assert {r["event_id"]: r["relation"] for r in temporal.relate_to(events, 2.0, 5.0).collect()} == {f"{a},{b}": x for (a, b), x in want.items()}


def test_close_pairs_in_small_cells(spark):
    rng = random.Random(1)
    spans = [(k, rng.random() * 50, rng.random() * 9) for k in range(60)]
    events = spark.createDataFrame([(k, s, s + d) for k, s, d in spans], "event_id bigint, start double, end double")
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(spans, 2) if max(0, max(a[1], b[1]) - min(a[1] + a[2], b[1] + b[2])) <= 2)
    for width in (0.7, 5.0, 100.0):
        assert rows(temporal.close_pairs(events, 2.0, width=width), "a", "b") == want


def test_search_language(spark):
    q = search.parse("red -kind:a,b size:1..5 ^kind:2 blue age:..3")
    assert q.text == "red blue" and q.boosts == {"kind": 2.0}
    assert q.filters == [search.Filter("kind", ("a", "b"), negated=True), search.Filter("size", (), 1.0, 5.0), search.Filter("age", (), None, 3.0)]
    g = graph(spark, [("e", ["n1"], ["n2", "n3"])])
    assert rows(search.matching(g, search.parse("-kind:1").filters), "id") == [("n2",), ("n3",)]
    assert rows(search.matching(g, search.parse("-other:1").filters), "id") == []  # a missing field never fits
    assert rows(search.matching(g, [])) == []


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    for f in (degrees.degrees, degrees.triangles, paths.hops, paths.connected_components, paths.levels, paths.minimum_spanning_edges, centrality.pagerank, centrality.betweenness, rules.discover_transitive, lookup.labeled_edges, maintenance.equivalences):
        assert f(g).collect() == [], f.__name__


def test_updates(spark):
    g = graph(spark, [("e1", ["a"], ["b"]), ("e2", ["b"], ["c"])])
    more = spark.createDataFrame([("e3", ["a"], ["c"], "x", 1.0), ("e4", ["a"], ["ghost"], "x", 1.0), ("e1", ["c"], ["a"], "x", 1.0)], EDGES)
    assert rows(maintenance.add_edges(g, more).edges, "edge_id") == [("e1",), ("e2",), ("e3",)]
    merged = maintenance.merge_node(g, "a", "b")
    assert rows(merged.edges, "edge_id", "source_ids", "target_ids") == [("e1", ["a"], ["a"]), ("e2", ["a"], ["a", "c"])]
    assert rows(maintenance.remove_nodes(g, merged.nodes.where(F.col("id") == "a")).edges, "edge_id") == [("e2",)]
