"""Distances, closures, orders and components. Loops run on the driver; what they iterate over stays distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans import packed
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, fixpoint


def hops(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """source, id, d: directed hops from each of sources.id (all nodes by default) to each node that it reaches; itself 0."""
    start = (g.nodes if sources is None else sources).select(F.col("id").alias("source"), "id", F.lit(0).cast("bigint").alias("d"))
    arcs = checkpoint(g.arcs)
    grow = lambda new: new.join(arcs, F.col("id") == F.col("src")).select("source", F.col("tgt").alias("id"), (F.col("d") + 1).alias("d"))
    return fixpoint(start, grow, ["source", "id"])


def distances(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """source, id, d: the least sum of 1 / max(weight, 1e-9) over the arcs of a path, for all that is reached; itself 0.

    Labels are corrected in rounds, each over the distances that the last one improved.
    """
    cost = checkpoint(g.pairs.where("src <> tgt").groupBy("src", "tgt").agg(F.min(1 / F.greatest("weight", F.lit(1e-9))).alias("cost")))
    best = new = checkpoint((g.nodes if sources is None else sources).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("d")))
    while not new.isEmpty():
        found = new.join(cost, F.col("id") == F.col("src")).groupBy("source", F.col("tgt").alias("id")).agg(F.min(F.col("d") + F.col("cost")).alias("better"))
        new = checkpoint(found.join(best, ["source", "id"], "left").where("d is null or better < d - 1e-12").select("source", "id", F.col("better").alias("d")))
        best = checkpoint(best.join(new.select("source", "id"), ["source", "id"], "left_anti").unionByName(new))
    return best


def eccentricity(g: Graph) -> DataFrame:
    """id, ecc: the most hops to a node that it reaches; 0 without any."""
    return hops(g).groupBy(F.col("source").alias("id")).agg(F.max("d").alias("ecc"))


def extent(g: Graph) -> DataFrame:
    """id, ecc, center and periphery: whether ecc is the least (radius) and the greatest (diameter)."""
    ecc = eccentricity(g)
    ends = ecc.agg(F.min("ecc").alias("radius"), F.max("ecc").alias("diameter"))
    return ecc.join(F.broadcast(ends)).select("id", "ecc", (F.col("ecc") == F.col("radius")).alias("center"), (F.col("ecc") == F.col("diameter")).alias("periphery"))


def closure(g: Graph) -> DataFrame:
    """src, tgt: what is reached over one arc or more."""
    arcs = checkpoint(g.arcs)
    step = arcs.select(F.col("src").alias("via"), F.col("tgt").alias("to"))
    return fixpoint(arcs, lambda new: new.join(step, F.col("tgt") == F.col("via")).select("src", F.col("to").alias("tgt")), ["src", "tgt"])


def transitive_reduction(g: Graph) -> DataFrame:
    """The arcs whose target no other direct target of their source reaches."""
    arcs, reach = g.arcs, closure(g)
    implied = arcs.join(reach.select(F.col("src").alias("other"), F.col("tgt").alias("far")), F.col("tgt") == F.col("other")).where("far <> other").select("src", F.col("far").alias("tgt")).distinct()
    return arcs.join(implied, ["src", "tgt"], "left_anti")


def levels(g: Graph) -> DataFrame:
    """id, level: the longest path to a node of a graph without cycles; nodes on or behind a cycle are missing."""
    arcs = checkpoint(g.arcs)
    left, level, out = checkpoint(g.nodes.select("id")), 0, None
    while not left.isEmpty():
        inner = arcs.join(left, F.col("src") == F.col("id"), "left_semi").select(F.col("tgt").alias("id")).distinct()
        free = checkpoint(left.join(inner, "id", "left_anti").withColumn("level", F.lit(level).cast("bigint")))
        if free.isEmpty():
            break
        out = free if out is None else checkpoint(out.unionByName(free))
        left = checkpoint(left.join(free.select("id"), "id", "left_anti"))
        level += 1
    return g.nodes.select("id", F.lit(0).cast("bigint").alias("level")).limit(0) if out is None else out


def is_dag(g: Graph) -> bool:
    return levels(g).count() == g.nodes.count()


def simple_paths(g: Graph, source: str, target: str, max_depth: int = 5, label: str | None = None) -> DataFrame:
    """path, hops: all directed paths without repeats of max_depth hops at most."""
    return paths_between(g, g.nodes.where(F.col("id") == source), target, max_depth, label)


def paths_between(g: Graph, sources: DataFrame, target: str, max_depth: int = 5, label: str | None = None) -> DataFrame:
    """path, hops: all directed paths without repeats of max_depth hops at most from sources.id to the target."""
    rows = g.pairs if label is None else g.pairs.where(F.col("label") == label)
    arcs = checkpoint(rows.where("src <> tgt").select("src", "tgt").distinct())
    at = arcs.join(sources.select(F.col("id").alias("src")), "src", "left_semi").where(F.col("src") != target).select(F.array("src", "tgt").alias("path"), "tgt").withColumnRenamed("tgt", "end")
    out = at.where(F.col("end") == target)
    for _ in range(max_depth - 1):
        at = checkpoint(at.where(F.col("end") != target).join(arcs, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path"), F.col("tgt").alias("end")))
        out = out.unionByName(at.where(F.col("end") == target))
    return out.select("path", (F.size("path") - 1).cast("bigint").alias("hops"))


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the smallest id that each of nodes.id is connected with over pairs (u, v).

    Each round points nodes to their smallest neighbour, follows pointers to their ends, by doubling, and contracts the pairs.
    """
    links, roots = checkpoint(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")))
        moved = True
        while moved:
            far = checkpoint(to.join(to.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            to, moved = far.select("a", "to"), not far.where("moved").isEmpty()
        old = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        roots = checkpoint(old if roots is None else roots.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = links.join(to.withColumnRenamed("to", "ra"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("rb")), "b")
        links = checkpoint(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if roots is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def connected_components(g: Graph) -> DataFrame:
    """id, component over common edges. Members are linked with the least of their edge, so an edge of n members makes n - 1 links."""
    first = g.edges.select(F.explode(F.array_union("source_ids", "target_ids")).alias("v"), F.array_min(F.array_union("source_ids", "target_ids")).alias("u"))
    return components(first, g.nodes)


def overlaps(g: Graph, s: int = 1) -> DataFrame:
    """e1 < e2, shared: the pairs of edges that share s members or more."""
    a, b = (g.members.select("node_id", F.col("edge_id").alias(e)) for e in ("e1", "e2"))
    return a.join(b, "node_id").where("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("shared")).where(F.col("shared") >= s)


def s_components(g: Graph, s: int = 1) -> DataFrame:
    """edge_id, component: edges connected over overlaps of s members or more."""
    pairs = overlaps(g, s).select(F.col("e1").alias("u"), F.col("e2").alias("v"))
    return components(pairs, g.edges.select(F.col("edge_id").alias("id"))).withColumnRenamed("id", "edge_id")


def s_persistence(g: Graph) -> DataFrame:
    """s, components and largest, for s from 1 to the greatest overlap."""
    table = checkpoint(overlaps(g))
    top = table.agg(F.max("shared")).first()[0] or 0
    out = None
    for s in range(1, top + 1):
        sizes = components(table.where(F.col("shared") >= s).select(F.col("e1").alias("u"), F.col("e2").alias("v")), g.edges.select(F.col("edge_id").alias("id"))).groupBy("component").agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit(s).cast("bigint").alias("s"), F.count("*").alias("components"), F.max("n").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return g.edges.sparkSession.createDataFrame([], "s bigint, components bigint, largest bigint") if out is None else out


def strong_components(g: Graph) -> DataFrame:
    """id, component: the smallest id of the nodes that reach each other.

    In each round all nodes take the smallest id that reaches them; those that reach back to it, over nodes with the same one, are its
    component and go. Only nodes and arcs are kept, never the pairs that reach each other. Nodes without an arc in or out go first.
    """
    arcs, left, out = checkpoint(g.arcs), checkpoint(g.nodes.select("id")), None
    while True:
        ends = arcs.select(F.col("src").alias("id")).distinct().join(arcs.select(F.col("tgt").alias("id")).distinct(), "id")
        alone = checkpoint(left.join(ends, "id", "left_anti").select("id", F.col("id").alias("component")))
        if alone.isEmpty():
            if left.isEmpty():
                break
            color = changed = checkpoint(left.select("id", F.col("id").alias("color")))
            while not changed.isEmpty():
                found = changed.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("tgt").alias("id")).agg(F.min("color").alias("less"))
                new = checkpoint(color.join(found, "id", "left").select("id", F.least("color", "less").alias("color"), (F.col("less") < F.col("color")).alias("moved")))
                color, changed = new.select("id", "color"), new.where("moved").select("id", "color")
            side = lambda c: color.select(F.col("id").alias(c), F.col("color").alias(f"c{c}"))  # noqa: E731, B023
            back = checkpoint(arcs.join(side("src"), "src").join(side("tgt"), "tgt").where("csrc = ctgt").select("src", "tgt"))
            start = color.where("id = color").select("id", "color")
            alone = fixpoint(start, lambda new: new.join(back, F.col("id") == F.col("tgt")).select(F.col("src").alias("id"), "color"), ["id"]).withColumnRenamed("color", "component")  # noqa: B023
        out = checkpoint(alone if out is None else out.unionByName(alone))
        left = checkpoint(left.join(alone.select("id"), "id", "left_anti"))
        arcs = checkpoint(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "tgt"), "tgt", "left_semi"))
    return g.nodes.select("id", F.col("id").alias("component")).limit(0) if out is None else out


def onion_layers(g: Graph) -> DataFrame:
    """id, layer: the round in which a node goes when, again and again, all nodes with at most k neighbours left go; k rises when none does."""
    links = checkpoint(g.adj.select("u", "v"))
    left, layer, k, out = checkpoint(g.nodes.select("id")), 1, 0, None
    while not left.isEmpty():
        size = links.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
        now = checkpoint(left.join(size, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k")))
        k = max(k, now.agg(F.min("k")).first()[0])
        gone = now.where(F.col("k") <= k).select("id", F.lit(layer).cast("bigint").alias("layer"), F.lit(k).cast("bigint").alias("core"))
        out = checkpoint(gone if out is None else out.unionByName(gone))
        left = checkpoint(now.where(F.col("k") > k).select("id"))
        links = checkpoint(links.join(left.withColumnRenamed("id", "u"), "u", "left_semi").join(left.withColumnRenamed("id", "v"), "v", "left_semi"))
        layer += 1
    return out


def minimum_spanning_edges(g: Graph) -> DataFrame:
    """edge_id of a spanning forest by ascending weight, ties by id: in rounds, each component takes its least outgoing pair."""
    pairs = checkpoint(g.cliq.select("u", "v", "weight", "edge_id"))
    of = checkpoint(g.nodes.select("id", F.col("id").alias("component")))
    chosen = None
    while True:
        side = lambda x: of.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        open_ = pairs.join(side("u"), "u").join(side("v"), "v").where("cu <> cv").select("cu", "cv", F.struct("weight", "edge_id", "u", "v").alias("key"))
        both = open_.unionByName(open_.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "key"))
        least = checkpoint(both.groupBy("cu").agg(F.min(F.struct("key", "cv")).alias("m")).select("cu", "m.cv", "m.key.edge_id"))
        if least.isEmpty():
            break
        chosen = checkpoint((least.select("edge_id") if chosen is None else chosen.unionByName(least.select("edge_id"))).distinct())
        merged = components(least.select(F.col("cu").alias("u"), F.col("cv").alias("v")), of.select(F.col("component").alias("id")).distinct())
        of = checkpoint(of.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component").select("id", F.col("to").alias("component")))
    return g.edges.select("edge_id").limit(0) if chosen is None else chosen


def label_propagation(g: Graph, rounds_: int = 5) -> DataFrame:
    """id, community: in each round all nodes take the most frequent community around them, weighted by shared edges; ties go to the smallest.

    The neighbours are packed once; a round reads them where they lie, with all nodes' communities as one array of numbers, and shuffles nothing.
    """
    near = packed.packed(g)
    now = np.arange(near.size)
    for _ in range(rounds_):
        now = packed.most_frequent(near, now)
    of = near.with_values(community=now).select("id", "community")
    return of.join(near.numbers.select(F.col("n").alias("community"), F.col("id").alias("_c")), "community").select("id", F.col("_c").alias("community"))


def wiener(g: Graph) -> DataFrame:
    """One row, pairs and value: the hops between all pairs of nodes that are connected over common edges, each pair once."""
    step = checkpoint(g.adj.select(F.col("u").alias("src"), F.col("v").alias("tgt")))
    start = g.nodes.select(F.col("id").alias("source"), "id", F.lit(0).cast("bigint").alias("d"))
    grow = lambda new: new.join(step, F.col("id") == F.col("src")).select("source", F.col("tgt").alias("id"), (F.col("d") + 1).alias("d"))
    return fixpoint(start, grow, ["source", "id"]).where("source < id").agg(F.count("*").alias("pairs"), F.coalesce(F.sum("d"), F.lit(0)).alias("value"))


def shortest_path(g: Graph, source: str, target: str, weighted: bool = True) -> DataFrame:
    """place, id, d: the nodes of a shortest directed path in order, with the distance from the source; no row if there is none. Ties by the smallest node before.

    The distances of one source are found first; the path is followed back from the target, one arc after another.
    """
    start = g.nodes.where(F.col("id") == source)
    found = checkpoint((distances(g, start) if weighted else hops(g, start)).select("id", F.col("d").cast("double").alias("d")))
    cost = F.min(1 / F.greatest("weight", F.lit(1e-9))) if weighted else F.lit(1.0)
    arcs = g.pairs.where("src <> tgt").groupBy("src", "tgt").agg((cost if weighted else F.max(cost)).alias("cost"))
    ends = arcs.join(found.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(found.select(F.col("id").alias("tgt"), F.col("d").alias("dt")), "tgt")
    before = checkpoint(ends.where(F.abs(F.col("ds") + F.col("cost") - F.col("dt")) <= 1e-12 * F.greatest(F.col("dt"), F.lit(1.0))).groupBy("tgt").agg(F.min("src").alias("src")))
    end = found.where(F.col("id") == target).select("id", F.lit(0).cast("bigint").alias("back"))
    walk = fixpoint(end, lambda new: new.where(F.col("id") != source).join(before, F.col("id") == F.col("tgt")).select(F.col("src").alias("id"), (F.col("back") + 1).alias("back")), ["id"])
    return walk.join(found, "id").withColumn("n", walk.agg(F.max("back")).scalar()).select((F.col("n") - F.col("back")).alias("place"), "id", "d")


def s_distance_matrix(g: Graph, s: int = 1, sources: DataFrame | None = None) -> DataFrame:
    """source, id, d: steps between edges over pairs that share s members or more, from each of sources.edge_id (all by default)."""
    from weft.operators.matrices import as_line_graph

    line = as_line_graph(g, s)
    return hops(line, None if sources is None else sources.select(F.col("edge_id").alias("id")))


def component_sizes(found: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """component, size of the components(id, component) of least to most members."""
    rows = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return rows if most is None else rows.where(F.col("size") <= most)


def is_connected(g: Graph) -> DataFrame:
    """One row: components, and connected, whether there is just one."""
    return connected_components(g).agg(F.countDistinct("component").alias("components")).withColumn("connected", F.col("components") == 1)


def largest_component(g: Graph) -> DataFrame:
    """id of the members of the component with the most, ties by the smallest id."""
    found = checkpoint(connected_components(g))
    best = component_sizes(found).orderBy(F.desc("size"), "component").limit(1)
    return found.join(best, "component", "left_semi").select("id")


def component_of(g: Graph, node: str) -> DataFrame:
    """id of all nodes that are connected with the given one: a search from it, without the other components."""
    from weft.operators.lookup import breadth_first

    return breadth_first(g, g.nodes.where(F.col("id") == node), 1 << 30).select("id")


def acyclic(g: Graph) -> DataFrame:
    """One row: dag (no directed cycle; loops don't count) and has_cycle (loops count)."""
    free = levels(g).count() == g.nodes.count()
    loops = g.edges.where(F.arrays_overlap("source_ids", "target_ids")).limit(1).agg(F.count("*").alias("n"))
    return loops.select(F.lit(free).alias("dag"), ((F.col("n") > 0) | F.lit(not free)).alias("has_cycle"))


def spanning_pairs(g: Graph) -> DataFrame:
    """u, v: the two smallest members of each edge of the spanning forest."""
    ids = F.array_sort(F.array_union("source_ids", "target_ids"))
    return g.edges.join(minimum_spanning_edges(g), "edge_id", "left_semi").select(F.get(ids, F.lit(0)).alias("u"), F.get(ids, F.lit(1)).alias("v"))


def tree_center(g: Graph) -> DataFrame:
    """id: what is left of a tree when leaves are taken off, all at once, again and again: one node or two. Of a graph with cycles, what no longer has leaves."""
    links, left = checkpoint(g.adj.select("u", "v")), checkpoint(g.nodes.select("id"))
    while left.count() > 2:
        degree = links.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
        leaves = checkpoint(left.join(degree, "id", "left").where("coalesce(k, 0) <= 1").select("id"))
        if leaves.isEmpty():
            break
        left = checkpoint(left.join(leaves, "id", "left_anti"))
        links = checkpoint(links.join(left.withColumnRenamed("id", "u"), "u", "left_semi").join(left.withColumnRenamed("id", "v"), "v", "left_semi"))
    return left
