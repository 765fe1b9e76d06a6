"""Sets of concepts with scores, and recall: bounded slices of a node's surroundings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import lookup, maintenance, paths, retrieval
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


@dataclass(frozen=True)
class ConceptSet:
    """Nodes of a graph with scores: rows(id, label, score). Every method returns a new set, or a new graph."""

    graph: Graph
    rows: DataFrame

    def _with(self, rows: DataFrame) -> ConceptSet:
        return ConceptSet(self.graph, rows.select("id", "label", "score"))

    def _scored(self, scores: DataFrame) -> ConceptSet:
        """The nodes in scores(id, score)."""
        return self._with(self.graph.nodes.select("id", "label").join(scores.select("id", F.col("score").cast("double").alias("score")), "id"))

    def top(self, k: int) -> ConceptSet:
        """The k best, ties by id."""
        return self._with(self.rows.orderBy(F.desc("score"), "id").limit(k))

    def filter(self, test: Column) -> ConceptSet:
        return self._with(self.rows.where(test))

    def threshold(self, least: float) -> ConceptSet:
        return self._with(self.rows.where(F.col("score") >= least))

    def exclude(self, *labels: str) -> ConceptSet:
        return self._with(self.rows.where(~F.col("label").isin(*labels)))

    def unique(self) -> ConceptSet:
        """Of the rows of one label the best, ties by id."""
        best = self.rows.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("score"), "id")).alias("m"))
        return self._with(best.select("m.id", "label", (-F.col("m.score")).alias("score")))

    def neighbors(self, edge_label: str | None = None, direction: str = "any") -> ConceptSet:
        """The neighbours of its nodes, each with the best score of a node that it neighbours."""
        near = lookup.neighbors(self.graph, direction, edge_label).join(self.rows.select("id", "score"), "id")
        return self._scored(near.groupBy(F.col("neighbor").alias("id")).agg(F.max("score").alias("score")))

    def similar(self, vectors: DataFrame, top_k: int = 10, threshold: float | None = None) -> ConceptSet:
        """The top_k nearest to any of its nodes by vectors(id, embedding), without them, with the best cosine."""
        own = vectors.join(self.rows.select("id"), "id", "left_semi")
        near = retrieval.similar(vectors, own, top_k, "id").groupBy("id").agg(F.max("cosine").alias("score")).join(self.rows.select("id"), "id", "left_anti")
        return self._scored(near if threshold is None else near.where(F.col("score") >= threshold))

    def activate(self, energy: float = 1.0, top_k: int = 10, n: int = 5) -> ConceptSet:
        """The top_k that spreading from all of its nodes activates."""
        found = retrieval.spread(self.graph, self.rows.select("id", F.lit(energy).alias("energy")), n)
        return self._scored(found.withColumnRenamed("energy", "score")).top(top_k)

    def diffuse(self, energy: float = 1.0, mode: str = "linear", n: int = 5) -> ConceptSet:
        """All that diffusion over edges with a gate reaches."""
        found = retrieval.diffuse(self.graph, self.rows.select("id", F.lit(energy).alias("energy")), mode, n)
        return self._scored(found.withColumnRenamed("energy", "score"))

    def query(self, vectors: DataFrame | None = None, top_k: int = 10) -> ConceptSet:
        """The top_k of what activation and similarity find from its nodes, by reciprocal ranks, without them."""
        return self._scored(retrieval.retrieve(self.graph, self.rows.select("id"), vectors, top_k).select("id", "score"))

    def paths_to(self, target: str, label: str | None = None, max_depth: int = 5) -> DataFrame:
        """path, hops: the directed paths without repeats from any of its nodes to the target."""
        found = paths.paths_between(self.graph, self.rows.select("id"), target, max_depth, label)
        return found.orderBy("hops", "path")

    def centrality(self, scores: DataFrame) -> ConceptSet:
        """Its nodes with the scores of a centrality(id, score)."""
        return self._scored(scores.join(self.rows.select("id"), "id", "left_semi"))

    def link_to(self, target: str, label: str = "", weight: float = 1.0) -> Graph:
        """The graph with an edge from each of its nodes but the target itself."""
        rows = self.rows.where(F.col("id") != target).select(F.array("id").alias("source_ids"), F.array(F.lit(target)).alias("target_ids"))
        return maintenance.add_edges(self.graph, maintenance.links(rows, label, weight))

    def link_all(self, label: str = "", weight: float = 1.0) -> Graph:
        """The graph with an edge from each of its nodes to each that follows by id. This is a feature of sets of few nodes: n nodes make n (n - 1) / 2 edges."""
        ids = self.rows.agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids", F.posexplode("ids").alias("k", "a"))
        rows = ids.select(F.array("a").alias("source_ids"), F.explode(F.slice("ids", F.col("k") + 2, F.size("ids"))).alias("b")).select("source_ids", F.array("b").alias("target_ids"))
        return maintenance.add_edges(self.graph, maintenance.links(rows, label, weight))

    def add_data(self, **fields: str) -> Graph:
        """The graph with these fields set on its nodes."""
        more = F.create_map(*[F.lit(str(x)) for k, v in fields.items() for x in (k, v)])
        hit = self.rows.select("id", F.lit(True).alias("_hit")).distinct()
        merged = F.map_concat(F.map_filter("data", lambda k, _: ~k.isin(*fields)), more)
        nodes = self.graph.nodes.join(hit, "id", "left").withColumn("data", F.when(F.col("_hit"), merged).otherwise(F.col("data"))).drop("_hit")
        return Graph(nodes, self.graph.edges)


def find(g: Graph, label: str | None = None, data: dict[str, str] | None = None, labels: list[str] | None = None, limit: int | None = None) -> ConceptSet:
    """The nodes of a label, or of one of labels, whose fields are equal to data, with score 1; ``limit``: only the first by id."""
    rows = g.nodes if label is None else g.nodes.where(F.col("label") == label)
    rows = rows if labels is None else rows.where(F.col("label").isin(*labels))
    for field, value in (data or {}).items():
        rows = rows.where(F.col("data")[field] == value)
    rows = rows.select("id", "label", F.lit(1.0).alias("score"))
    return ConceptSet(g, rows if limit is None else rows.orderBy("id").limit(limit))


def tagged(g: Graph, modality: str, field: str = "modality") -> DataFrame:
    """The nodes one of whose tags, the words of a field, is the modality."""
    return g.nodes.where(F.array_contains(F.split(F.col("data")[field], r"[\s,]+"), modality))


def recall(g: Graph, start: DataFrame, max_depth: int = 3, max_nodes: int = 50, modality: str | None = None, field: str = "modality", directed: bool = False) -> DataFrame:
    """id, depth: the nearest max_nodes around start.id within max_depth hops, ties by id; of a modality only where one is given, though the way may lead over others."""
    found = lookup.breadth_first(g, start, max_depth, directed)
    if modality is not None:
        found = found.join(tagged(g, modality, field).select("id"), "id", "left_semi")
    return found.orderBy("depth", "id").limit(max_nodes)


def slice_around(g: Graph, start: str, max_depth: int = 5, max_nodes: int = 100, test: Column | None = None, min_weight: float = 0.0) -> DataFrame:
    """id, depth, strength: level by level the neighbours by the greatest weight of an edge to the level before, ties by id, until there are max_nodes.

    Only nodes that pass the test (a column over nodes) and edges of min_weight or more count; strength of the start is null.
    """
    allowed = checkpoint(g.nodes.where(F.lit(True) if test is None else test).select("id"))
    rows = g.cliq.where(F.col("weight") >= min_weight)
    near = checkpoint(rows.select(F.col("u").alias("a"), F.col("v").alias("id"), "weight").unionByName(rows.select(F.col("v").alias("a"), F.col("u").alias("id"), "weight")).groupBy("a", "id").agg(F.max("weight").alias("strength")))
    seen = level = checkpoint(g.nodes.where(F.col("id") == start).select("id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("double").alias("strength")))
    left = max_nodes - 1
    for depth in range(1, max_depth + 1):
        found = near.join(level.select(F.col("id").alias("a")), "a").groupBy("id").agg(F.max("strength").alias("strength"))
        found = found.join(allowed, "id", "left_semi").join(seen.select("id"), "id", "left_anti")
        level = checkpoint(found.orderBy(F.desc("strength"), "id").limit(max(left, 0)).select("id", F.lit(depth).cast("bigint").alias("depth"), "strength"))
        n = level.count()
        if not n:
            break
        seen, left = checkpoint(seen.unionByName(level)), left - n
    return seen


def neighbor_edges(g: Graph, node: str) -> DataFrame:
    """id, edges: each neighbour of a node with the ids of the edges that they share, in order."""
    own = lookup.incident_edges(g, node).select("edge_id", F.explode(F.array_union("source_ids", "target_ids")).alias("id")).where(F.col("id") != node)
    return own.groupBy("id").agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))


def strongest(g: Graph, node: str, top_k: int = 10) -> DataFrame:
    """id, weight: the neighbours with the greatest weight of a common edge, ties by id."""
    own = lookup.incident_edges(g, node).select("weight", F.explode(F.array_union("source_ids", "target_ids")).alias("id")).where(F.col("id") != node)
    w = Window.orderBy(F.desc("weight"), "id")
    best = own.groupBy("id").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(w).cast("bigint"))
