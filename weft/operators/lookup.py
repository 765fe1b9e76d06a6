"""Scans, lookups and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.graph import Graph
from weft.plans.iterate import fixpoint


def incident_edges(g: Graph, node: str, role: str | None = None) -> DataFrame:
    """Edges with the node among their sources, targets, or either."""
    source, target = F.array_contains("source_ids", node), F.array_contains("target_ids", node)
    return g.edges.where({"source": source, "target": target, None: source | target}[role])


def edges_by_label(g: Graph, label: str) -> DataFrame:
    return g.edges.where(F.col("label") == label)


def neighbors(g: Graph, direction: str = "any", label: str | None = None) -> DataFrame:
    """id, neighbor of all nodes: any (members of a common edge), out (targets of own edges) or in."""
    if direction == "any":
        rows = g.cliq if label is None else g.cliq.where(F.col("label") == label)
        both = rows.select(F.col("u").alias("id"), F.col("v").alias("neighbor"))
        return both.unionByName(rows.select(F.col("v").alias("id"), F.col("u").alias("neighbor"))).distinct()
    a, b = ("src", "tgt") if direction == "out" else ("tgt", "src")
    rows = g.pairs if label is None else g.pairs.where(F.col("label") == label)
    return rows.where("src <> tgt").select(F.col(a).alias("id"), F.col(b).alias("neighbor")).distinct()


def cocoverage(g: Graph) -> DataFrame:
    """u, v, shared: how many edges two nodes share."""
    return g.adj


def labeled_edges(g: Graph) -> DataFrame:
    """Edges with the labels of their sources and targets, sorted and comma-joined."""
    named = g.incidence.join(g.nodes.select(F.col("id").alias("node_id"), F.col("label").alias("name")), "node_id")
    side = lambda role: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("name")))), ",")
    return named.groupBy("edge_id", "label", "weight").agg(side("source").alias("sources"), side("target").alias("targets"))


def by_order(g: Graph, orders: list[int]) -> Graph:
    """The graph with the edges that have one more member than one of orders, and all nodes."""
    return Graph(g.nodes, g.edges.where((F.size(F.array_union("source_ids", "target_ids")) - 1).isin(orders)))


def pattern_match(g: Graph, edge_label: str | None = None, source_label: str | None = None, target_label: str | None = None) -> DataFrame:
    """Pairs of an edge's source and target whose labels are the given ones; a label that is None matches all."""
    name = lambda side: g.nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    rows = g.pairs if edge_label is None else g.pairs.where(F.col("label") == edge_label)
    rows = rows.join(name("src"), "src").join(name("tgt"), "tgt")
    for want, column in ((source_label, "src_label"), (target_label, "tgt_label")):
        rows = rows if want is None else rows.where(F.col(column) == want)
    return rows.select("edge_id", "src_label", "tgt_label")


def subgraph(g: Graph, keep: DataFrame) -> Graph:
    """The nodes whose id is in keep.id, and the edges all of whose members are."""
    outside = g.members.join(keep.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("edge_id").distinct()
    return Graph(g.nodes.join(keep.select("id"), "id", "left_semi"), g.edges.join(outside, "edge_id", "left_anti"))


def query_hyperedges(g: Graph, min_sources: int = 1, min_targets: int = 1, label: str | None = None, containing: str | None = None) -> DataFrame:
    rows = g.edges.where((F.size("source_ids") >= min_sources) & (F.size("target_ids") >= min_targets))
    rows = rows if label is None else rows.where(F.col("label") == label)
    return rows if containing is None else rows.where(F.array_contains("source_ids", containing) | F.array_contains("target_ids", containing))


def breadth_first(g: Graph, start: DataFrame, max_depth: int = 5, directed: bool = False) -> DataFrame:
    """id, depth: the nodes within max_depth hops of start.id, over neighbours or, if directed, from source to target."""
    step = g.arcs if directed else g.adj.select(F.col("u").alias("src"), F.col("v").alias("tgt"))
    grow = lambda new: new.join(step, F.col("id") == F.col("src")).select(F.col("tgt").alias("id"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(start.select("id", F.lit(0).cast("bigint").alias("depth")), grow, ["id"], max_depth)
