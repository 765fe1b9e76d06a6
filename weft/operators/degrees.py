"""Degree statistics, assortativity and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans import packed
from weft.plans.graph import Graph


def _pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """r, from sums, so that it can be stated in SQL alike; 0 where it is not defined."""
    s = rows.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    c = {k: F.col(k).cast("double") for k in ("n", "sx", "sy", "sxy", "sxx", "syy")}
    below = (c["n"] * c["sxx"] - c["sx"] * c["sx"]) * (c["n"] * c["syy"] - c["sy"] * c["sy"])
    return s.select(F.when(below > 0, (c["n"] * c["sxy"] - c["sx"] * c["sy"]) / F.sqrt(below)).otherwise(0.0).alias("r"))


def _with(rows: DataFrame, g: Graph, side: str, name: str) -> DataFrame:
    return rows.join(g.degree.select(F.col("id").alias(side), F.col("degree").alias(name)), side)


def degrees(g: Graph) -> DataFrame:
    """id, degree, in_degree, out_degree, strength (sum of edge weights)."""
    role = lambda r: F.coalesce(F.sum((F.col("role") == r).cast("bigint")), F.lit(0)).alias("in_degree" if r == "target" else "out_degree")
    sides = g.incidence.groupBy(F.col("node_id").alias("id")).agg(role("target"), role("source"))
    weights = g.members.groupBy(F.col("node_id").alias("id")).agg(F.sum("weight").alias("strength"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.degree.join(sides, "id", "left").join(weights, "id", "left").select("id", "degree", zero("in_degree"), zero("out_degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def degree_distribution(g: Graph) -> DataFrame:
    return g.degree.groupBy("degree").agg(F.count("*").alias("nodes"))


def edge_sizes(g: Graph) -> DataFrame:
    """size, edges: how many edges have how many members."""
    return g.edges.groupBy(F.size(F.array_union("source_ids", "target_ids")).cast("bigint").alias("size")).agg(F.count("*").alias("edges"))


def summary(g: Graph) -> DataFrame:
    """nodes, edges, density (edges per ordered pair of nodes) and max_order (most members less one)."""
    n, m = g.nodes.agg(F.count("*").alias("nodes")), g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.max(F.size(F.array_union("source_ids", "target_ids"))) - 1, F.lit(0)).cast("bigint").alias("max_order"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.join(F.broadcast(m)).select("nodes", "edges", density.alias("density"), "max_order")


def degree_correlation(g: Graph) -> DataFrame:
    """r over the degrees of each two members u < v of each edge."""
    return _pearson(_with(_with(g.cliq, g, "u", "x"), g, "v", "y"), "x", "y")


def degree_assortativity(g: Graph) -> DataFrame:
    """r over the degrees of each source and target."""
    return _pearson(_with(_with(g.pairs, g, "src", "x"), g, "tgt", "y"), "x", "y")


def attribute_assortativity(g: Graph, attribute: str) -> DataFrame:
    """Nominal assortativity of an attribute over neighbouring pairs that both have it; null if all are alike."""
    value = lambda side, name: g.nodes.select(F.col("id").alias(side), F.col("data")[attribute].alias(name)).where(F.col(name).isNotNull())
    mix = g.adj.join(value("u", "a"), "u").join(value("v", "b"), "v").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = mix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    square = mix.groupBy("a").agg(F.sum("n").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    same, square_share = F.col("same") / F.col("total"), F.col("square") / (F.col("total") * F.col("total"))
    return total.join(F.broadcast(square)).select(F.when(square_share < 1, (same - square_share) / (1 - square_share)).alias("r"))


def average_neighbor_degree(g: Graph) -> DataFrame:
    """id, value: the mean number of neighbours of a node's neighbours; 0 without any."""
    k = g.neighbor_degree.select(F.col("id").alias("v"), "k")
    found = g.adj.join(k, "v").groupBy(F.col("u").alias("id")).agg((F.sum("k") / F.count("*")).alias("value"))
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def degree_connectivity(g: Graph) -> DataFrame:
    """k, value: the mean number of neighbours over the neighbours of nodes that have k."""
    k = g.neighbor_degree
    rows = g.adj.join(k.select(F.col("id").alias("u"), "k"), "u").join(k.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    return rows.groupBy("k").agg((F.sum("kv") / F.count("*")).alias("value"))


def s_metric(g: Graph) -> DataFrame:
    """The sum over neighbouring pairs of the product of their numbers of neighbours."""
    k = g.neighbor_degree
    rows = g.links.join(k.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    return rows.agg(F.coalesce(F.sum(F.col("ku") * F.col("kv")), F.lit(0)).cast("double").alias("s"))


def rich_club(g: Graph) -> DataFrame:
    """k, phi: the density among nodes of more than k neighbours, where there are two or more, not normalised."""
    k = g.neighbor_degree.where("k > 0")
    levels = k.groupBy("k").agg(F.count("*").alias("n"))
    low = g.links.join(k.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v").groupBy(F.least("ku", "kv").alias("k")).agg(F.count("*").alias("m"))
    from pyspark.sql import Window

    # one row per distinct degree, however many nodes there are
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    rows = levels.join(low, "k", "left").select("k", F.sum("n").over(above).alias("n"), F.sum(F.coalesce("m", F.lit(0))).over(above).alias("m"))
    return rows.where("n > 1").select("k", (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("phi"))


def triangles(g: Graph) -> DataFrame:
    """id, k, triangles and clustering (links among neighbours over possible ones; 0 below two neighbours).

    Neighbours are packed as numbers and met as lists: no row is made for a wedge.
    """
    near = packed.packed(g, g.nodes.select("id").unionByName(g.members.select(F.col("node_id").alias("id"))).distinct())
    k, t = packed.triangles(near)
    found = near.with_values(k=k, triangles=t).select("id", "k", "triangles", F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))
    return g.nodes.select("id").join(found, "id")


def average_clustering(g: Graph) -> DataFrame:
    """The mean clustering of nodes that are in two edges or more; 0 if there are none."""
    rows = triangles(g).join(g.degree, "id").where("degree >= 2")
    return rows.agg(F.coalesce(F.sum("clustering") / F.count("*"), F.lit(0.0)).alias("value"))


def transitivity(g: Graph) -> DataFrame:
    """Three times the triangles over the connected triples; 0 without triples."""
    s = triangles(g).agg(F.sum("triangles").alias("t"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("w"))
    return s.select(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("value"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """df with the columns rounded and without negative zeros."""
    value: dict[str, Column] = {c: F.round(F.col(c), digits) + 0.0 for c in columns}
    return df.withColumns(value)
