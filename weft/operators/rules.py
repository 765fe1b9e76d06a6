"""Rules as joins that produce new edges, and checks of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.graph import Graph


def transitive(g: Graph, label: str, confidence: float = 0.9) -> DataFrame:
    """a, b, c, score: a to b to c by edges of the label, a and c different and without an edge of any label from a to c."""
    own = g.pairs.where((F.col("label") == label) & (F.col("src") != F.col("tgt"))).groupBy("src", "tgt").agg(F.max("weight").alias("w"))
    first, second = own.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("w").alias("w1")), own.select(F.col("src").alias("b"), F.col("tgt").alias("c"), F.col("w").alias("w2"))
    rows = first.join(second, "b").where("a <> c").join(g.arcs.select(F.col("src").alias("a"), F.col("tgt").alias("c")), ["a", "c"], "left_anti")
    return rows.select("a", "b", "c", F.least(F.col("w1") * F.col("w2") * confidence * confidence, F.lit(1.0)).alias("score"))


def inverse(g: Graph, label: str, inverse_label: str) -> DataFrame:
    """src, tgt of the edges of inverse_label that are missing: from the target to the source of each edge of the label."""
    have = g.pairs.where(F.col("label") == inverse_label).select("src", "tgt")
    return g.pairs.where(F.col("label") == label).select(F.col("tgt").alias("src"), F.col("src").alias("tgt")).distinct().join(have, ["src", "tgt"], "left_anti")


def hub_inference(g: Graph, support: int = 2, confidence: float = 0.6) -> DataFrame:
    """src, tgt, n, share: targets that enough edges of a source have, and a large enough share of them."""
    pair = g.pairs.groupBy("src", "tgt").agg(F.count("*").alias("n"))
    own = g.incidence.where(F.col("role") == "source").groupBy(F.col("node_id").alias("src")).agg(F.count("*").alias("total"))
    return pair.join(own, "src").select("src", "tgt", "n", (F.col("n") / F.col("total")).alias("share")).where((F.col("n") >= support) & (F.col("share") >= confidence))


def propagate_property(g: Graph, key: str) -> DataFrame:
    """id, value that a node without the property gets over an edge from a node with it; of several the smallest."""
    have = g.nodes.select("id", F.col("data")[key].alias("value"))
    return g.pairs.join(have.where(F.col("value").isNotNull()).withColumnRenamed("id", "src"), "src").join(have.where(F.col("value").isNull()).select(F.col("id").alias("tgt")), "tgt").groupBy(F.col("tgt").alias("id")).agg(F.min("value").alias("value"))


def inductive(g: Graph, least: int = 3) -> DataFrame:
    """label, tgt, members: the targets that as many different nodes have by edges of one label."""
    return g.pairs.select("label", "src", "tgt").distinct().groupBy("label", "tgt").agg(F.count("*").alias("members")).where(F.col("members") >= least)


def analogies(g: Graph, least: float = 0.6, labels: int = 2) -> DataFrame:
    """a < b, similarity: nodes whose outgoing edges have similar sets of labels, of as many labels each. Nodes meet over equal sets, so pairs are of sets."""
    sets = g.incidence.where(F.col("role") == "source").groupBy("node_id").agg(F.array_sort(F.collect_set("label")).alias("s")).where(F.size("s") >= labels)
    kinds = sets.groupBy("s").agg(F.count("*").alias("n"))
    side = lambda p: kinds.select(F.col("s").alias(p), F.col("n").alias(f"n{p}"), F.explode("s").alias("label"))
    j = F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q"))
    return side("p").join(side("q"), "label").select("p", "q", "np", "nq").distinct().withColumn("similarity", j).where((F.col("similarity") >= least) & (F.array_join("p", "|") <= F.array_join("q", "|"))).select(F.array_join("p", "|").alias("p"), F.array_join("q", "|").alias("q"), "np", "nq", "similarity")


def discover_transitive(g: Graph, least: int = 2) -> DataFrame:
    """label, chains: labels with as many two-hop chains between different ends."""
    own = g.pairs.where("src <> tgt").select("label", "src", "tgt").distinct()
    rows = own.alias("p").join(own.alias("q"), (F.col("p.label") == F.col("q.label")) & (F.col("p.tgt") == F.col("q.src"))).where("p.src <> q.tgt")
    return rows.groupBy(F.col("p.label").alias("label")).agg(F.count("*").alias("chains")).where(F.col("chains") >= least)


def discover_inverse(g: Graph, least: int = 2) -> DataFrame:
    """label, back, pairs: how often an edge of one label has one of the other in the opposite direction."""
    own = g.pairs.where("src <> tgt").select("label", "src", "tgt").distinct()
    rows = own.alias("p").join(own.alias("q"), (F.col("p.src") == F.col("q.tgt")) & (F.col("p.tgt") == F.col("q.src")))
    return rows.groupBy(F.col("p.label").alias("label"), F.col("q.label").alias("back")).agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)


def discover_hubs(g: Graph, least: int = 3) -> DataFrame:
    """id, label, edges: nodes that are a source of as many edges of one label."""
    return g.incidence.where(F.col("role") == "source").groupBy(F.col("node_id").alias("id"), "label").agg(F.count("*").alias("edges")).where(F.col("edges") >= least)


def contradictions(g: Graph, negations: list[tuple[str, str]]) -> DataFrame:
    """first, second: edges of the same sources and targets whose labels negate each other."""
    # as many rows as negations are given
    pairs = g.edges.sparkSession.createDataFrame(negations, "l string, r string")
    key = g.edges.select("edge_id", "label", F.col("source_ids").alias("s"), F.col("target_ids").alias("t"))
    rows = key.alias("p").join(F.broadcast(pairs), F.col("p.label") == F.col("l")).join(key.alias("q"), (F.col("q.label") == F.col("r")) & (F.col("p.s") == F.col("q.s")) & (F.col("p.t") == F.col("q.t")))
    return rows.select(F.col("p.edge_id").alias("first"), F.col("q.edge_id").alias("second"))


def discover_all(g: Graph, least: int = 2, hubs: int = 3) -> DataFrame:
    """kind, label, other, n: what the three discoveries find: labels with chains, pairs of labels, and labels of hubs (their number)."""
    chains = discover_transitive(g, least).select(F.lit("transitive").alias("kind"), "label", F.lit("").alias("other"), F.col("chains").alias("n"))
    back = discover_inverse(g, least).select(F.lit("inverse").alias("kind"), "label", F.col("back").alias("other"), F.col("pairs").alias("n"))
    hub = discover_hubs(g, hubs).groupBy("label").agg(F.count("*").alias("n")).select(F.lit("hub").alias("kind"), "label", F.lit("").alias("other"), "n")
    return chains.unionByName(back).unionByName(hub)


def violations(g: Graph, most: float = 100.0) -> DataFrame:
    """edge_id, violation: self_loop (a node on both sides), weight (not positive or over most), duplicate (not the first of equal sides and label)."""
    loops = g.edges.where(F.arrays_overlap("source_ids", "target_ids")).select("edge_id", F.lit("self_loop").alias("violation"))
    weights = g.edges.where((F.col("weight") <= 0) | (F.col("weight") > most)).select("edge_id", F.lit("weight").alias("violation"))
    key = ["source_ids", "target_ids", "label"]
    first = g.edges.groupBy(*key).agg(F.min("edge_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = g.edges.join(first, key).where("edge_id <> first").select("edge_id", F.lit("duplicate").alias("violation"))
    return loops.unionByName(weights).unionByName(twice)


def dangling(g: Graph) -> DataFrame:
    """edge_id, node_id: members that aren't in nodes; and nodes without edges, with a null edge_id."""
    missing = g.members.select("edge_id", "node_id").join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("edge_id", "node_id")
    alone = g.degree.where("degree = 0").select(F.lit(None).cast("string").alias("edge_id"), F.col("id").alias("node_id"))
    return missing.unionByName(alone)
