"""Operators whose pairs are many: the same rows as over all pairs, and no more work than they need."""

import itertools
import random

import pytest

from weft.operators import classes, inference, maintenance, matrices, rewriting, states
from weft.plans.graph import Graph

EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"
NODES = "id string, label string, data map<string,string>, weight double"


def graph(spark, data, sets=()):
    nodes = spark.createDataFrame([(i, i, d, 1.0) for i, d in data.items()], NODES)
    return Graph(nodes, spark.createDataFrame([(f"e{k}", sorted(s)[:1], sorted(s)[1:], "x", 1.0) for k, s in enumerate(sets)], EDGES))


class NoEdges(Graph):
    """Fails where the neighbours are asked for."""

    @property
    def adj(self):
        raise AssertionError("neighbours were not needed")


def test_encapsulation_over_one_hub(spark, monkeypatch):
    rng = random.Random(11)
    sets = [{"hub", *rng.sample([f"n{k}" for k in range(30)], rng.randint(1, 6))} for _ in range(150)]
    g = graph(spark, {"hub": {}}, sets)
    # all edges meet in the hub: their pairs, made one by one, were counted member by member
    monkeypatch.setattr(matrices, "dual_walk", lambda g: pytest.fail("all pairs of edges over a node"))
    want = {(f"e{a}", f"e{b}") for a, b in itertools.permutations(range(150), 2) if sets[a] < sets[b]}
    assert {(r.child, r.parent) for r in matrices.encapsulation(g).collect()} == want


def test_equivalences_decided_by_payloads_read_no_neighbours(spark):
    data = {f"n{k}": {"a": str(k % 2), "b": "x", "c": str(k % 3)} for k in range(12)}
    g = graph(spark, data)
    got = {(r.a, r.b): r.score for r in maintenance.equivalences(NoEdges(g.nodes, g.edges), 0.6, ("a", "b")).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(data), 2) if data[a]["a"] == data[b]["a"]]
    assert got.keys() == set(pairs)
    assert all(abs(got[p] - (2 + (data[p[0]]["c"] == data[p[1]]["c"])) / 3) < 1e-12 for p in pairs)


def test_equivalences_still_lifted_by_neighbours(spark):
    data = {"p": {"a": "1", "b": "1"}, "q": {"a": "1", "b": "2"}, "r": {"a": "1", "b": "3"}, **{f"z{k}": {} for k in range(3)}}
    g = graph(spark, data, [{"p", "z0"}, {"p", "z1"}, {"q", "z0"}, {"q", "z1"}, {"r", "z2"}])
    got = {(r.a, r.b): round(r.score, 6) for r in maintenance.equivalences(g, 0.7, ("a",)).collect()}
    assert got == {("p", "q"): 0.8}


def test_merge_of_equal_payloads_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "disjoint", lambda pairs: pytest.fail("all pairs of a class"))
    data = {f"n{k:02d}": {"a": str(k % 2), "b": "x"} for k in range(11)} | {"m0": {"a": None, "b": "x"}, "m1": {"a": None, "b": "x"}, "k0": {"b": "x"}, "k1": {"b": "x"}}
    left = {r.id for r in maintenance.merge_equivalences(graph(spark, data), 1.0, ("a", "b")).nodes.collect()}
    want = set(data)
    for c in "01":
        own = sorted(i for i, d in data.items() if d.get("a") == c)
        want -= set(own[1::2])
    assert left == want


def test_equal_sets_meet_as_one(spark):
    sets = {f"s{k}": [["a", "b", "c"], ["a", "b", "d"], ["e"], [], ["c", "b", "a", "a"]][k % 5] for k in range(40)}
    rows = spark.createDataFrame(list(sets.items()), "id string, items array<string>")
    found, _ = states.similar_classes(rows, 0.5)
    assert found.count() == 4  # three classes with themselves, and the first with the second
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}
    got = [(r.a, r.b) for r in states.similar_sets(rows, 0.5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_merged_states_make_no_pairs_of_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(states, "spread", lambda *a: pytest.fail("all pairs of states"))
    monkeypatch.setattr(inference, "convergent", lambda *a: pytest.fail("all pairs of states"))
    rows = [(f"s{k:02d}", None, ["a", "b", "c"] if k % 2 else ["a", "b", "c", "d"]) for k in range(20)] + [("x", None, ["z"]), ("y", None, ["u"]), ("w", None, ["u"])]
    t = spark.createDataFrame(rows, "state string, parent string, nodes array<string>")
    assert {(r.state, r.into) for r in states.merged(t, 0.7).collect()} == {(f"s{k:02d}", "s00") for k in range(20)} | {("y", "w"), ("w", "w")}


def test_like_data_meet_as_classes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rewriting, "spread", lambda pairs, members: (seen.append(pairs.count()), classes.spread(pairs, members))[1])
    data = {f"n{k}": {"a": str(k % 2), "b": "x", "c": "y"} for k in range(30)} | {"z": {"a": None, "b": "x", "c": "y"}}
    got = {(r.a, r.b) for r in rewriting.similar_data(graph(spark, data), 0.8).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(data), 2) if data[a] == data[b]}
    assert seen == [2]


def test_pieces_of_a_class_meet_once(spark):
    rows = spark.createDataFrame([(f"n{k:02d}", "x") for k in range(23)] + [("m", "y")], "id string, by string")
    kinds, members = classes.classes(rows, "by", piece=5)
    pairs = kinds.select("c").crossJoin(kinds.select("c").withColumnRenamed("c", "d")).where("c <= d").toDF("ca", "cb")
    got = [(r.a, r.b) for r in classes.spread(pairs, members).collect()]
    assert sorted(got) == list(itertools.combinations(sorted(["m", *[f"n{k:02d}" for k in range(23)]]), 2))


def test_merge_reads_the_edges_once(spark):
    data = {f"n{k}": {"a": "x"} for k in range(4)} | {"z": {"a": "y"}}
    g = graph(spark, data, [{"n0", "n1", "z"}, {"n1", "n3"}, {"z"}, set()])
    merged = maintenance.merge_equivalences(g, 1.0, ("a",)).edges
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    got = {r.edge_id: (r.source_ids, r.target_ids, r.label, r.weight) for r in merged.collect()}
    assert got == {"e0": (["n0"], ["n0", "z"], "x", 1.0), "e1": (["n0"], ["n2"], "x", 1.0), "e2": (["z"], [], "x", 1.0), "e3": ([], [], "x", 1.0)}


def test_pairs_left_out_of_their_lists(spark):
    ids = [f"n{k:02d}" for k in range(23)] + ["m", "o"]
    rows = spark.createDataFrame([(i, i[0]) for i in ids], "id string, by string")
    kinds, members = classes.classes(rows, "by", piece=5)
    pairs = kinds.select("c").crossJoin(kinds.select("c").withColumnRenamed("c", "d")).where("c >= d").toDF("ca", "cb")
    every = list(itertools.combinations(sorted(ids), 2))
    out = random.Random(12).sample(every, 90)
    but = spark.createDataFrame([*out, out[0], ("n00", "unknown")], "a string, b string")
    got = classes.spread(pairs, members, but)
    assert sorted((r.a, r.b) for r in got.collect()) == [p for p in every if p not in set(out)]


def test_rules_on_like_data_shuffle_no_pairs(spark):
    data = {f"n{k:02d}": {"a": str(k % 2), "b": "x"} for k in range(9)}
    g = graph(spark, data, [{"n00", "n02"}])
    for apply in (rewriting.apply_generalization, rewriting.apply_substitution):
        plan = apply(g).edges._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Generate explode")]
        assert "Join" not in above and "Aggregate" not in above


def test_rules_on_like_data_add_once(spark):
    data = {f"n{k:02d}": {"a": str(k % 2), "b": "x"} for k in range(9)}
    g = graph(spark, data, [{"n00", "n02"}])
    have = [("g", ["z"], ["n02", "n04", "n99"], "generalizes", 1.0), ("s", ["n03"], ["n01"], "substitutes", 1.0), ("substitution:n01:n05", ["n00"], ["n08"], "old", 1.0), ("generalizes:abstract:n01:n07", [], [], "old", 1.0)]
    g = Graph(g.nodes, g.edges.unionByName(spark.createDataFrame(have, EDGES)))
    pairs = {(a, b) for a, b in itertools.combinations(sorted(data), 2) if data[a] == data[b]}
    assert {(r.a, r.b) for r in rewriting.generalizations(g, 0.8).collect()} == pairs - {("n02", "n04")}
    assert {(r.a, r.b) for r in rewriting.substitutions(g, 0.8).collect()} == pairs - {("n01", "n03")}
    once = rewriting.apply_substitution(g)
    got = [r.edge_id for r in once.edges.where("label = 'substitutes' and edge_id <> 's'").collect()]
    want = {f"substitution:{a}:{b}" for p in pairs - {("n01", "n03")} for a, b in (p, p[::-1])} - {"substitution:n01:n05"}
    assert set(got) == want and len(got) == len(want)
    assert rewriting.substitutions(once).collect() == []
    once = rewriting.apply_generalization(g).edges
    assert {r.edge_id for r in once.where("label = 'generalizes' and edge_id <> 'g'").collect()} == {f"generalizes:abstract:{a}:{b}" for a, b in pairs - {("n02", "n04")}} - {"generalizes:abstract:n01:n07"}


def test_links_known_as_lists_make_no_pairs(spark):
    data = {f"n{k:02d}": {"a": str(k % 3), "b": "x"} for k in range(20)}
    have = spark.createDataFrame([("s", ["n03"], ["n00"], "substitutes", 1.0)], EDGES)
    g = graph(spark, data)
    once = rewriting.apply_substitution(Graph(g.nodes, have))
    left = rewriting.substitutions(once)
    assert left.collect() == []
    # the edges that were added are not made to be looked up
    assert "substitution" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert rewriting.substitutions(Graph(once.nodes, once.edges)).collect() == []
    # nodes that came later are not in the lists
    more = spark.createDataFrame([("m0", "m0", {"a": "0", "b": "x"}, 1.0), ("m1", "m1", {"a": "2", "b": "x"}, 1.0)], NODES)
    grown = rewriting.Substituted(once.nodes.unionByName(more), once.edges, once.before, once.label, once.lists)
    got = [(r.a, r.b) for r in rewriting.substitutions(grown).collect()]
    want = {(m, i) for m, a in (("m0", "0"), ("m1", "2")) for i, d in data.items() if d["a"] == a}
    assert set(got) == want and len(got) == len(want)
    assert {(r.a, r.b) for r in rewriting.substitutions(once, label="other").collect()} == {(a, b) for a, b in itertools.combinations(sorted(data), 2) if data[a] == data[b]}


def test_known_lists_across_pieces(spark):
    ids = [f"n{k:02d}" for k in range(23)] + ["m", "o"]
    rows = spark.createDataFrame([(i, i[0]) for i in ids], "id string, by string")
    kinds, members = classes.classes(rows, "by", piece=5)
    pairs = kinds.select("c").crossJoin(kinds.select("c").withColumnRenamed("c", "d")).where("c >= d").toDF("ca", "cb")
    known = [(ids[3:14], ids[3:14], True), (ids[1:3], ids[12:20] + ["m", "z"], False), (["n20", "n22"], ["n21"], False)]
    gone = {tuple(sorted((x, y))) for xs, ys, _ in known for x in xs for y in ys}
    but = spark.createDataFrame([("n00", "n22"), ("n04", "n05")], "a string, b string")
    got = classes.spread(pairs, members, but, spark.createDataFrame(known, "xs array<string>, ys array<string>, own boolean"))
    want = [p for p in itertools.combinations(sorted(ids), 2) if p not in gone and p not in {("n00", "n22")}]
    assert sorted((r.a, r.b) for r in got.collect()) == want
