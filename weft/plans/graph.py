"""The hypergraph as tables, and the views that nearly all operators are queries over."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, data map<string,string>, weight) and edges(edge_id, source_ids, target_ids, label, weight).

    source_ids and target_ids are sorted and without repeats. Tables are never changed: updates return a new Graph.
    """

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def incidence(self) -> DataFrame:
        """edge_id, node_id, role (source or target), label, weight."""
        both = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f"{role}_ids").alias("ids")) for role in ("source", "target")])
        sides = self.edges.select("edge_id", "label", "weight", F.explode(both).alias("side"))
        return sides.select("edge_id", F.explode("side.ids").alias("node_id"), "side.role", "label", "weight")

    @cached_property
    def members(self) -> DataFrame:
        """edge_id, node_id of each member of each edge, whatever its role."""
        ids = F.array_union("source_ids", "target_ids")
        return self.edges.select("edge_id", F.explode(ids).alias("node_id"), F.size(ids).alias("size"), "label", "weight")

    @cached_property
    def pairs(self) -> DataFrame:
        """src, tgt, edge_id, label, weight of each source with each target: built in the row, without a join."""
        return self.edges.select("edge_id", F.explode("source_ids").alias("src"), "target_ids", "label", "weight").select("src", F.explode("target_ids").alias("tgt"), "edge_id", "label", "weight")

    @cached_property
    def cliq(self) -> DataFrame:
        """u < v, edge_id, label, weight of each two members of an edge: built in the row, without a join."""
        ids = F.array_sort(F.array_union("source_ids", "target_ids"))
        rows = self.edges.select("edge_id", "label", "weight", ids.alias("ids")).select("edge_id", "label", "weight", "ids", F.posexplode("ids").alias("i", "u"))
        return rows.select("u", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("v"), "edge_id", "label", "weight")

    @cached_property
    def links(self) -> DataFrame:
        """u < v, each neighbouring pair once, with the number of edges that they share."""
        return self.cliq.groupBy("u", "v").agg(F.count("*").alias("shared"))

    @cached_property
    def adj(self) -> DataFrame:
        """u, v in both directions, with the number of edges that they share."""
        return self.links.unionByName(self.links.select(F.col("v").alias("u"), F.col("u").alias("v"), "shared"))

    @cached_property
    def arcs(self) -> DataFrame:
        """src, tgt, each once, without loops."""
        return self.pairs.where("src <> tgt").select("src", "tgt").distinct()

    @cached_property
    def degree(self) -> DataFrame:
        """id, degree: the number of edges of each node, 0 included."""
        found = self.members.groupBy("node_id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(found, F.col("id") == F.col("node_id"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    @cached_property
    def neighbor_degree(self) -> DataFrame:
        """id, k: the number of neighbours of each node, 0 included."""
        found = self.adj.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
        return self.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"))
