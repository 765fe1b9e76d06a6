"""Chains of inference, structural patterns, learning from activations, and states of a multiway expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, fixpoint


def forward_chain(g: Graph, label: str, depth: int = 3, confidence: float = 0.9) -> DataFrame:
    """src, tgt, depth, score of what transitive steps over a label infer, in rounds: a pair of different ends keeps the depth at which it first appears, and the best score at that depth.

    A step multiplies the scores of a known pair and an edge (at most 1) with the confidence.
    """
    return forward_chain_from(g, label, None, depth, confidence)


def forward_chain_from(g: Graph, label: str, sources: DataFrame | None, depth: int = 3, confidence: float = 0.9) -> DataFrame:
    """forward_chain of the pairs whose source is one of sources.id (all if None)."""
    own = checkpoint(g.pairs.where((F.col("label") == label) & (F.col("src") != F.col("tgt"))).groupBy("src", "tgt").agg(F.least(F.max("weight"), F.lit(1.0)).alias("w")))
    start = own if sources is None else own.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    known = new = checkpoint(start.select("src", "tgt", F.lit(0).cast("bigint").alias("depth"), F.col("w").alias("score")))
    step = own.select(F.col("src").alias("via"), F.col("tgt").alias("to"), "w")
    for k in range(1, depth + 1):
        found = new.join(step, F.col("tgt") == F.col("via")).where("src <> to").groupBy("src", F.col("to").alias("tgt")).agg(F.max(F.col("score") * F.col("w") * confidence).alias("score"))
        new = checkpoint(found.join(known.select("src", "tgt"), ["src", "tgt"], "left_anti").select("src", "tgt", F.lit(k).cast("bigint").alias("depth"), "score"))
        if new.isEmpty():
            break
        known = checkpoint(known.unionByName(new))
    return known.where("depth > 0")


def derivations(g: Graph, target: str) -> DataFrame:
    """label, a, b: two edges of one label from a over b to the target, a different from it."""
    last = g.pairs.where((F.col("tgt") == target) & (F.col("src") != target)).select("label", F.col("src").alias("b")).distinct()
    first = g.pairs.where("src <> tgt").select("label", F.col("src").alias("a"), F.col("tgt").alias("b")).distinct()
    return first.join(last, ["label", "b"]).where(F.col("a") != target).select("label", "a", "b")


def abductions(g: Graph, effect: str, explained: str) -> DataFrame:
    """id of targets of an effect edge that no edge of the label ``explained`` points to."""
    to = lambda label: g.pairs.where(F.col("label") == label).select(F.col("tgt").alias("id")).distinct()
    return to(effect).join(to(explained), "id", "left_anti")


def confidence_paths(g: Graph, source: str, depth: int = 10) -> DataFrame:
    """id, confidence, hops: the greatest product of weights (at most 1 each) over a path from source of depth arcs at most, and the fewest hops that reach it."""
    arcs = checkpoint(g.pairs.where("src <> tgt").groupBy("src", "tgt").agg(F.least(F.max("weight"), F.lit(1.0)).alias("w")))
    best = new = checkpoint(g.nodes.where(F.col("id") == source).select("id", F.lit(1.0).alias("confidence"), F.lit(0).cast("bigint").alias("hops")))
    for k in range(1, depth + 1):
        found = new.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("tgt").alias("id")).agg(F.max(F.col("confidence") * F.col("w")).alias("better"))
        new = checkpoint(found.join(best, "id", "left").where("confidence is null or better > confidence + 1e-12").select("id", F.col("better").alias("confidence"), F.lit(k).cast("bigint").alias("hops")))
        if new.isEmpty():
            break
        best = checkpoint(best.join(new.select("id"), "id", "left_anti").unionByName(new))
    return best


def open_chains(g: Graph, label: str | None = None, least: int = 2, most: int = 5) -> DataFrame:
    """path, nodes: the directed paths of least to most nodes without repeats from nodes that nothing points to, each as far as it got."""
    rows = g.pairs if label is None else g.pairs.where(F.col("label") == label)
    arcs = checkpoint(rows.where("src <> tgt").select("src", "tgt").distinct())
    heads = arcs.select("src").distinct().join(arcs.select(F.col("tgt").alias("src")), "src", "left_anti")
    at = heads.select(F.array("src").alias("path"), F.col("src").alias("end"))
    out = None
    for n in range(2, most + 1):
        at = checkpoint(at.join(arcs, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path"), F.col("tgt").alias("end")))
        if n >= least:
            out = at if out is None else out.unionByName(at)
    return out.select("path", F.size("path").cast("bigint").alias("nodes"))


def cycles(g: Graph, most: int = 4) -> DataFrame:
    """path, hops: directed cycles of two to most different nodes, each once, from its smallest node on."""
    arcs = checkpoint(g.arcs)
    at, out = arcs.where("src < tgt").select(F.array("src", "tgt").alias("path"), F.col("src").alias("first"), F.col("tgt").alias("end")), None
    for n in range(2, most + 1):
        closed = at.join(arcs, (F.col("end") == F.col("src")) & (F.col("first") == F.col("tgt")), "left_semi").select("path", F.lit(n).cast("bigint").alias("hops"))
        out = closed if out is None else out.unionByName(closed)
        if n < most:
            at = checkpoint(at.join(arcs, F.col("end") == F.col("src")).where("tgt > first").where(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path"), "first", F.col("tgt").alias("end")))
    return out


def girth(g: Graph) -> DataFrame:
    """One row, girth: the hops of the shortest directed cycle of two nodes or more; 0 without any."""
    from weft.operators.paths import hops

    back = hops(g).join(g.arcs, (F.col("source") == F.col("tgt")) & (F.col("id") == F.col("src")))
    return back.agg(F.coalesce(F.min(F.col("d") + 1), F.lit(0)).alias("girth"))


def fan_out(g: Graph, least: int = 3) -> DataFrame:
    """id, label, targets: nodes with as many different targets over edges of a label."""
    return g.pairs.groupBy(F.col("src").alias("id"), "label").agg(F.countDistinct("tgt").alias("targets")).where(F.col("targets") >= least)


def collapse(g: Graph, ids: DataFrame, summary: str) -> Graph:
    """g with the nodes ids.id made into one, of the given id: edges within are gone, others point to it."""
    gone = ids.select(F.col("id").alias("node_id")).distinct()
    inner = g.members.join(gone.withColumn("in", F.lit(1)), "node_id", "left").groupBy("edge_id").agg(F.bool_and(F.col("in").isNotNull()).alias("inside"), F.bool_or(F.col("in").isNotNull()).alias("touched"))
    hit = inner.where("touched")
    moved = g.incidence.select("edge_id", "node_id", "role").join(hit.where("not inside").select("edge_id"), "edge_id", "left_semi").join(gone.withColumn("in", F.lit(1)), "node_id", "left")
    to = F.when(F.col("in").isNotNull(), summary).otherwise(F.col("node_id"))
    side = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, to)))
    new = moved.groupBy("edge_id").agg(side("source").alias("source_ids"), side("target").alias("target_ids"))
    rest = g.edges.join(hit.select("edge_id"), "edge_id", "left_anti")
    edges = rest.unionByName(g.edges.select("edge_id", "label", "weight").join(new, "edge_id").select(*g.edges.columns))
    one = g.nodes.sparkSession.createDataFrame([(summary, summary, {}, 1.0)], "id string, label string, data map<string,string>, weight double")
    return Graph(g.nodes.join(ids.select("id"), "id", "left_anti").unionByName(one), edges)


def hebbian(g: Graph, activation: DataFrame, least: float = 0.1, rate: float = 0.1, factor: float = 1.2, most: float = 100.0, decay: float = 0.01, low: float = 0.01) -> DataFrame:
    """edge_id, weight after learning from activation(id, energy).

    An edge with two active members or more (of least or more) strengthens by factor and rate times its second largest energy, up to
    most; any other decays, down to low, or to its own weight where that is less.
    """
    hot = activation.where(F.col("energy") >= least).groupBy("id").agg(F.max("energy").alias("energy"))
    both = g.members.join(hot.withColumnRenamed("id", "node_id"), "node_id").groupBy("edge_id").agg(F.sort_array(F.slice(F.sort_array(F.collect_list("energy"), False), 1, 2)).alias("top"))
    co = F.when(F.size("top") > 1, F.get("top", F.lit(0)))
    # least and greatest pass over nulls
    up, down = F.when(co.isNotNull(), F.least(F.col("weight") * factor + rate * co, F.lit(most))), F.greatest(F.col("weight") - decay, F.least("weight", F.lit(low)))
    return g.edges.select("edge_id", "weight").join(both, "edge_id", "left").select("edge_id", F.coalesce(up, down).alias("weight"))


def successors(visits: DataFrame, top_k: int = 3) -> DataFrame:
    """key, next, n: what most often follows a key in visits(who, ts, key), one after the other for each who; ties by key."""
    follow = F.lead("key").over(Window.partitionBy("who").orderBy("ts"))
    counts = visits.select("key", follow.alias("next")).where("next is not null").groupBy("key", "next").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "next"))
    return counts.withColumn("k", rank).where(F.col("k") <= top_k).drop("k")


def ancestors(states: DataFrame) -> DataFrame:
    """state, ancestor, d: each state with itself and those before it in states(state, parent)."""
    return ancestors_of(states, states)


def ancestors_of(states: DataFrame, some: DataFrame) -> DataFrame:
    """ancestors of some.state only."""
    up = checkpoint(states.select(F.col("state").alias("s"), "parent").where("parent is not null"))
    start = some.select("state", F.col("state").alias("ancestor"), F.lit(0).cast("bigint").alias("d"))
    return fixpoint(start, lambda new: new.join(up, F.col("ancestor") == F.col("s")).select("state", F.col("parent").alias("ancestor"), (F.col("d") + 1).alias("d")), ["state", "ancestor"])


def common_ancestors(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor, distance: the nearest common ancestor of pairs(a, b), ties by id, and the steps between the two over it."""
    up = checkpoint(ancestors(states))
    side = lambda c: up.select(F.col("state").alias(c), "ancestor", F.col("d").alias(f"d{c}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "ancestor"])
    best = rows.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("distance"), "ancestor")).alias("m"))
    return best.select("a", "b", "m.ancestor", "m.distance")


def convergent(states: DataFrame, least: float = 0.5, digits: int | None = None) -> DataFrame:
    """a < b, similarity (rounded to so many digits) of leaves of states(state, parent, nodes) whose node sets have a Jaccard of least or more, above 0."""
    from weft.operators.states import leaves, similar_sets

    return similar_sets(leaves(states).select(F.col("state").alias("id"), F.col("nodes").alias("items")), least, digits)


def siblings(states: DataFrame, least: int = 2) -> DataFrame:
    """parent, n: states that share a parent, where there are least or more."""
    return states.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def flagged_confidence(found: DataFrame, least: float) -> DataFrame:
    """The rows of confidence_paths under ``least``, the lowest first."""
    return found.where(F.col("confidence") < least).orderBy("confidence", "id")


def provable(g: Graph, label: str, targets: DataFrame, known: DataFrame, depth: int = 5) -> DataFrame:
    """id, proven, depth of targets.id: whether arcs of the label lead there from known.id in ``depth`` steps or fewer, and in how many."""
    from weft.operators.lookup import breadth_first

    own = Graph(g.nodes, g.edges.where(F.col("label") == label))
    found = breadth_first(own, known, depth, True)
    return targets.select("id").join(found, "id", "left").select("id", F.col("depth").isNotNull().alias("proven"), "depth")


def template(g: Graph, edges: list[tuple[str, str, str | None, float]]) -> DataFrame:
    """A column for each role: the matches of a pattern whose edges (role, role, label or None, least weight) hang together in order. Roles may have the same node."""
    out = None
    for a, b, label, least in edges:
        rows = g.pairs.where(F.col("weight") >= least)
        rows = rows if label is None else rows.where(F.col("label") == label)
        rows = rows.select(F.col("src").alias(a), F.col("tgt").alias(b)).distinct()
        shared = [] if out is None else [c for c in (a, b) if c in out.columns]
        if out is not None and not shared:
            raise ValueError("each edge of a pattern must have a role of those before it")
        out = rows if out is None else out.join(rows, shared)
    return out


def diamonds(g: Graph, label: str | None = None, least: int = 2) -> DataFrame:
    """a < b, shared, score: sources that have ``least`` targets or more in common, with the Jaccard index of their targets."""
    from weft.operators.matrices import projection

    own = Graph(g.nodes, g.edges if label is None else g.edges.where(F.col("label") == label))
    found = projection(own).where(F.col("shared") >= least)
    return found.select(F.col("u").alias("a"), F.col("v").alias("b"), "shared", F.col("jaccard").alias("score"))


def hypotheses(visits: DataFrame, least: int = 2, ratio: float = 0.5) -> DataFrame:
    """cause, effect, n, precedence, confidence: keys of which one follows the other at once ``least`` times or more in visits(who, ts, key), and does so in a share of ``ratio`` or more of both orders.

    confidence is the mean of a Beta distribution that has counted both orders, from one each on.
    """
    counts = checkpoint(successors(visits, 1 << 30).where("key <> next"))
    back = counts.select(F.col("next").alias("key"), F.col("key").alias("next"), F.col("n").alias("m"))
    rows = counts.join(back, ["key", "next"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    rows = rows.select(F.col("key").alias("cause"), F.col("next").alias("effect"), "n", (F.col("n") / (F.col("n") + F.col("m"))).alias("precedence"), ((F.col("n") + 1) / (F.col("n") + F.col("m") + 2)).alias("confidence"))
    return rows.where((F.col("n") >= least) & (F.col("precedence") >= ratio))
