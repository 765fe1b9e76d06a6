"""The queries without SQL against plain versions, and cases of the new operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.functions import columns
from weft.operators import structure
from weft.plans.graph import Graph
from weft.sources import files, generators

SF = "/root/testdata/sf0.001"
EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"


def graph(spark, pairs, more=()):
    ids = sorted({x for p in pairs for x in p} | set(more))
    nodes = spark.createDataFrame([(i, i, {}, 1.0) for i in ids], "id string, label string, data map<string,string>, weight double")
    return Graph(nodes, spark.createDataFrame([(f"{a}-{b}", [a], [b], "x", 1.0) for a, b in pairs], EDGES))


def ids(df):
    return sorted(r.id for r in df.collect())


def linked(pairs, ids_, without=None):
    """The least id that each is linked with."""
    of = {i: i for i in ids_}
    for _ in ids_:
        for a, b in pairs:
            if (a, b) != without:
                of[a] = of[b] = min(of[a], of[b])
    return of


def test_bridges_are_links_that_part_a_component(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("g", "h")]
    g = graph(spark, pairs, ["i"])
    nodes = ids(g.nodes)
    whole = len(set(linked(pairs, nodes).values()))
    want = sorted(p for p in pairs if len(set(linked(pairs, nodes, p).values())) > whole)
    assert sorted(map(tuple, structure.bridges(g).collect())) == want
    rest = [p for p in pairs if p not in want]
    assert {r.id: r.component for r in structure.two_edge_components(g).collect()} == linked(rest, nodes)


def test_chordal_graphs_vanish_and_circles_stay(spark):
    assert ids(structure.unchordal(graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "c"), ("d", "e")]))) == []
    assert ids(structure.unchordal(graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")]))) == ["a", "b", "c", "d"]


def test_structure_tests(spark):
    tree = structure.tests(graph(spark, [("a", "b"), ("b", "c"), ("b", "d")])).first()
    assert (tree.components, tree.connected, tree.tree, tree.forest, tree.eulerian, tree.dag) == (1, True, True, True, False, True)
    ring = structure.tests(graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])).first()
    assert (ring.tree, ring.forest, ring.eulerian, ring.eulerian_path, ring.loops, ring.dag) == (False, False, True, True, False, False)
    loop = structure.tests(graph(spark, [("a", "a"), ("a", "b")], ["c"])).first()
    assert (loop.components, loop.connected, loop.forest, loop.loops) == (2, False, True, True)


def test_tree_center(spark):
    assert ids(structure.tree_center(graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]))) == ["c"]
    assert ids(structure.tree_center(graph(spark, [("a", "b"), ("b", "c"), ("c", "d")]))) == ["b", "c"]
    assert ids(structure.tree_center(graph(spark, [("a", "b"), ("b", "c"), ("a", "c")]))) == []


def test_voterank(spark):
    star = graph(spark, [("a", x) for x in "bcde"] + [("f", "g"), ("f", "h")])
    assert [r.id for r in structure.voterank(star, 2).orderBy("rank").collect()] == ["a", "f"]


def test_empty_graph(spark):
    g = graph(spark, [])
    for run in (structure.matching, structure.edge_cover, structure.independent_set, structure.coloring, structure.maximal_cliques, structure.unchordal, structure.bridges, structure.simplices, structure.tree_center, structure.simrank):
        assert run(g).count() == 0
    assert structure.tests(g).first().components == 0


@pytest.mark.parametrize("name", ["unchordal", "structure_tests", "bridges", "two_edge_components", "voterank", "random_walks", "uniform_graph", "small_world"])
def test_queries_without_sql_give_the_same_twice(spark, name):
    first, second = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == second


def test_random_walks_follow_links(spark):
    from weft.sources.graphs import trade

    links = {(r.u, r.v) for r in trade(spark, SF).adj.collect()}
    rows = sorted((r.source, r.step, r.id) for r in catalog.QUERIES["random_walks"](spark, SF).collect())
    for (s, t, a), (s2, t2, b) in itertools.pairwise(rows):
        if s == s2:
            assert t2 == t + 1 and (a, b) in links


def test_uniform_edges_have_k_members(spark):
    rows = generators.uniform(spark, 5, 200, 3, 4).edges.select(F.concat("source_ids", "target_ids").alias("ids")).collect()
    assert len(rows) == 200 and all(len(set(r.ids)) == 3 for r in rows)
    assert len({tuple(sorted(r.ids)) for r in rows}) == 10  # every set of 3 of 5


def test_small_world_has_no_loops_and_keeps_its_size(spark):
    rows = generators.small_world(spark, 20, 4, 1.0, 3).edges.collect()
    assert len(rows) == 40 and all(r.source_ids != r.target_ids for r in rows)
    assert all((int(r.target_ids[0][1:]) - int(r.source_ids[0][1:])) % 20 != int(r.edge_id.split("-")[1]) for r in rows)


def test_edge_lists(spark, tmp_path):
    bad = Graph(graph(spark, []).nodes, spark.createDataFrame([("e", ["a,b"], ["c"], "x", 1.0)], EDGES))
    with pytest.raises(Exception, match="not to be written"):
        files.write_edgelist(bad, str(tmp_path / "bad"))
    (tmp_path / "list.txt").write_text("a,b\tc\tx\t2.5\na\tb\nc\ta\ty\nc\ta\ty\n")
    g = files.read_edgelist(spark, str(tmp_path / "list.txt"))
    assert sorted((r.source_ids, r.target_ids, r.label, r.weight) for r in g.edges.collect()) == [(["a", "b"], ["c"], "x", 2.5), (["c"], ["a"], "y", 1.0), (["c"], ["a"], "y", 1.0)]
    assert g.edges.select("edge_id").distinct().count() == 3 and ids(g.nodes) == ["a", "b", "c"]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "id string, x int")
    assert sorted(map(tuple, files.upsert(old, new, "id").collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_column_functions(spark):
    row = spark.range(1).select(columns.set_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"), columns.path_cost(F.lit(0.0)).alias("c"), columns.chance(1, F.lit("x")).alias("p")).first()
    assert row.j == 0.5 and round(row.c) == 10**9 and 0 <= row.p < 1
