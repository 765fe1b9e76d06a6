"""Centralities by a fixed number of rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.paths import hops
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, rounds


def degree_centrality(g: Graph) -> DataFrame:
    """id, score: degree over the number of other nodes; 1 in a graph of one node."""
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.degree.join(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("score"))


def closeness(g: Graph) -> DataFrame:
    """id, score: nodes reached / ((n - 1) * their total hops); 0 if none is reached."""
    n = g.nodes.agg(F.count("*").alias("n"))
    found = hops(g).groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("reach"), F.sum("d").alias("far"))
    return found.join(F.broadcast(n)).select("id", F.when((F.col("far") > 0) & (F.col("n") > 1), F.col("reach") / ((F.col("n") - 1) * F.col("far"))).otherwise(0.0).alias("score"))


def harmonic(g: Graph) -> DataFrame:
    """id, score: the sum of 1 / hops from all others, over neighbouring pairs in either direction."""
    both = Graph(g.nodes, g.edges.select("edge_id", F.array_union("source_ids", "target_ids").alias("source_ids"), F.array_union("source_ids", "target_ids").alias("target_ids"), "label", "weight"))
    return hops(both).groupBy("id").agg(F.sum(F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0)).alias("score"))


def _power(g: Graph, start: DataFrame, spread, norm: str, n: int) -> DataFrame:
    """id, score after n rounds of spread, divided after each by the sum of scores (l1) or their length (l2)."""

    def step(now: DataFrame) -> DataFrame:
        new = checkpoint(spread(now))
        size = new.agg((F.sum("score") if norm == "l1" else F.sqrt(F.sum(F.col("score") * F.col("score")))).alias("size"))
        return new.join(F.broadcast(size)).select("id", F.when(F.col("size") > 0, F.col("score") / F.col("size")).otherwise(F.col("score")).alias("score"))

    return rounds(start, step, n)


def _uniform(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.nodes.select("id").join(F.broadcast(n)).select("id", (1 / F.col("n")).alias("score"))


def _gathered(g: Graph, links: DataFrame, now: DataFrame) -> DataFrame:
    """id, got: the sum over links (u, v, w) of w times the score of v; 0 for nodes without links."""
    got = links.join(now.select(F.col("id").alias("v"), "score"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
    return g.nodes.select("id").join(got, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))


def _around(members: DataFrame, now: DataFrame) -> DataFrame:
    """id, got: the sum over a node's edges of the scores of their other members, so of each neighbour's score times the edges shared; 0 for nodes without edges.

    From nodes to edges and back, less the own part: work grows with the members, not with their pairs.
    """
    of = members.join(now.withColumnRenamed("id", "node_id"), "node_id")
    edge = of.groupBy("edge_id").agg(F.sum("score").alias("all"))
    got = of.join(edge, "edge_id").groupBy(F.col("node_id").alias("id")).agg(F.sum(F.col("all") - F.col("score")).alias("got"))
    return now.select("id").join(got, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))


def eigenvector(g: Graph, n: int = 10) -> DataFrame:
    """id, score: n rounds of summing neighbours' scores by shared edges, to unit length each time, from equal scores."""
    members = checkpoint(g.members.where("size > 1").select("edge_id", "node_id"))
    return _power(g, _uniform(g), lambda now: _around(members, now).withColumnRenamed("got", "score"), "l2", n)


def tensor_eigenvector(g: Graph, root: bool = True, n: int = 5) -> DataFrame:
    """id, score: n rounds in which each edge of two members or more gives each member the product of the others' scores, to sum 1 after each round, from equal scores.

    root (the H variant): sums are raised to 1 / (size of the largest edge - 1); otherwise (Z) they are left as they are. Products
    are sums of logarithms; a node without such edges gets 0 and is in no product. Without any such edge scores stay equal.
    """
    members = checkpoint(g.members.where("size > 1").select("edge_id", F.col("node_id").alias("id"), "size"))
    top = members.agg(F.max("size")).first()[0]
    if top is None:
        return _uniform(g)
    power = 1 / (top - 1) if root else 1.0

    def spread(now: DataFrame) -> DataFrame:
        rows = members.join(now.where("score > 0").select("id", F.log("score").alias("l")), "id")
        whole = rows.groupBy("edge_id").agg(F.sum("l").alias("all"))
        got = rows.join(whole, "edge_id").groupBy("id").agg(F.pow(F.sum(F.exp(F.col("all") - F.col("l"))), F.lit(power)).alias("score"))
        return g.nodes.select("id").join(got, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    return _power(g, _uniform(g), spread, "l1", n)


def katz(g: Graph, alpha: float = 0.1, beta: float = 1.0, n: int = 10) -> DataFrame:
    """id, score: n rounds of alpha times the neighbours' scores plus beta, to unit length after each round."""
    members = checkpoint(g.members.where("size > 1").select("edge_id", "node_id"))
    return _power(g, _uniform(g), lambda now: _around(members, now).select("id", (alpha * F.col("got") + beta).alias("score")), "l2", n)


def pagerank(g: Graph, alpha: float = 0.85, n: int = 10) -> DataFrame:
    """id, score: alpha is the share that is spread evenly, 1 - alpha follows edges from source to target.

    Over an edge a source gives a target weight / (sources + targets), divided by the weights of all edges in which it
    is a source. Scores add up to 1 after each of the n rounds.
    """
    rows = g.edges.select(F.explode("source_ids").alias("v"), "target_ids", "weight", (F.size("source_ids") + F.size("target_ids")).alias("size"))
    out = rows.groupBy("v").agg(F.sum("weight").alias("total"))
    links = checkpoint(rows.select("v", F.explode("target_ids").alias("u"), (F.col("weight") / F.col("size")).alias("part")).join(out, "v").where("total > 0").groupBy("u", "v").agg(F.sum(F.col("part") / F.col("total")).alias("w")))
    size = g.nodes.agg(F.count("*").alias("n"))
    spread = lambda now: _gathered(g, links, now).join(F.broadcast(size)).select("id", (alpha / F.col("n") + (1 - alpha) * F.col("got")).alias("score"))
    return _power(g, _uniform(g), spread, "l1", n)


def core_periphery(g: Graph, n: int = 5) -> DataFrame:
    """id, score: shared edges over the most of any node, then n rounds of the mean over neighbours by shared edges."""
    links = checkpoint(g.adj.select("u", "v", F.col("shared").cast("double").alias("w")))
    total = g.nodes.select("id").join(links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("total")), "id", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total"))
    top = total.agg(F.max("total").alias("top"))
    start = total.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("total") / F.col("top")).otherwise(F.col("total")).alias("score"))

    def step(now: DataFrame) -> DataFrame:
        return _gathered(g, links, now).join(total, "id").join(now, "id").select("id", F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(F.col("score")).alias("score"))

    return rounds(start, step, n).select("id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def node_edge(g: Graph, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, score) and (edge_id, score): nodes and edges that raise each other, by square roots, each to a sum of 1 in each round."""
    of = checkpoint(g.members.select("edge_id", "node_id"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    x = _uniform(g)
    y = g.edges.select("edge_id").join(F.broadcast(count(g.edges))).select("edge_id", (1 / F.col("n")).alias("score"))

    def raised(own: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        a, b = ("node_id", "edge_id") if key == "id" else ("edge_id", "node_id")
        got = of.join(other.select(F.col(other_key).alias(b), "score"), b).groupBy(F.col(a).alias(key)).agg(F.sum(F.col("score") * F.col("score")).alias("got"))
        new = own.join(got, key, "left").select(key, F.sqrt(F.col("score") * F.sqrt(F.coalesce("got", F.lit(0.0)))).alias("score"))
        total = new.agg(F.sum("score").alias("total"))
        return new.join(F.broadcast(total)).select(key, F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.col("score")).alias("score"))

    for _ in range(n):
        x, y = checkpoint(raised(x, "id", y, "edge_id")), checkpoint(raised(y, "edge_id", x, "id"))
    return x, y


def _dependencies(g: Graph) -> DataFrame | None:
    """s, id, dep: of the shortest directed paths from s to each other node the shares that pass id, added up; none if there are no arcs.

    Breadth-first from all nodes at once, with path counts; then dependencies are added up from the farthest level back.
    """
    arcs = checkpoint(g.pairs.where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("m")))
    seen = front = checkpoint(g.nodes.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    depth = 0
    while True:
        new = front.join(arcs, F.col("id") == F.col("src")).groupBy("s", F.col("tgt").alias("id")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        new = checkpoint(new.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(depth + 1).alias("d"), "paths"))
        if new.isEmpty():
            break
        seen, front, depth = checkpoint(seen.unionByName(new)), new, depth + 1
    total = None
    below = None
    for d in range(depth, 0, -1):
        level = seen.where(F.col("d") == d).select("s", "id", "paths")
        own = level.withColumn("dep", F.lit(0.0)) if below is None else level.join(below, ["s", "id"], "left").select("s", "id", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        own = checkpoint(own)
        up = seen.where(F.col("d") == d - 1).select("s", F.col("id").alias("src"), F.col("paths").alias("above"))
        back = own.join(arcs, F.col("id") == F.col("tgt")).join(up, ["s", "src"])
        below = checkpoint(back.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("above") * F.col("m") / F.col("paths") * (1 + F.col("dep"))).alias("dep")))
        total = own.select("s", "id", "dep") if total is None else total.unionByName(own.select("s", "id", "dep"))
    return total


def betweenness(g: Graph) -> DataFrame:
    """id, score: the share of shortest directed paths between two others that pass a node, over (n - 1)(n - 2); parallel edges are paths of their own."""
    total = _dependencies(g)
    n = g.nodes.agg(F.count("*").alias("n"))
    sums = g.nodes.select("id", F.lit(0.0).alias("dep")) if total is None else g.nodes.select("id", F.lit(0.0).alias("dep")).unionByName(total.select("id", "dep"))
    return sums.groupBy("id").agg(F.sum("dep").alias("dep")).join(F.broadcast(n)).select("id", F.when(F.col("n") > 2, F.col("dep") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("score"))


def percolation(g: Graph, states: DataFrame) -> DataFrame:
    """id, score: betweenness in which a path counts by the state of its source, states(id, x), as a share of the states of all but the node itself, over n - 2."""
    total = _dependencies(g)
    if total is None:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    x = checkpoint(g.nodes.select("id").join(states.select("id", "x"), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x")))
    sums = total.join(x.withColumnRenamed("id", "s"), "s").groupBy("id").agg(F.sum(F.col("dep") * F.col("x")).alias("dep"))
    rows = x.join(sums, "id", "left").withColumn("all", x.agg(F.sum("x")).scalar()).withColumn("n", x.agg(F.count("*")).scalar())
    return rows.select("id", F.when((F.col("all") > F.col("x")) & (F.col("n") > 2), F.coalesce("dep", F.lit(0.0)) / (F.col("all") - F.col("x")) / (F.col("n") - 2)).otherwise(0.0).alias("score"))


def katz_solved(g: Graph, alpha: float = 0.1, beta: float = 1.0, n: int = 40) -> DataFrame:
    """id, score: (I - alpha A)^-1 beta 1 over its length, by n terms of its series; alpha has to be under 1 over the greatest eigenvalue of A (shared edges)."""
    members = checkpoint(g.members.where("size > 1").select("edge_id", "node_id"))
    start = g.nodes.select("id", F.lit(beta).alias("score"))
    found = checkpoint(rounds(start, lambda now: _around(members, now).select("id", (alpha * F.col("got") + beta).alias("score")), n))
    return found.withColumn("size", F.sqrt(found.agg(F.sum(F.col("score") * F.col("score"))).scalar())).select("id", (F.col("score") / F.col("size")).alias("score"))


def s_walk_closeness(g: Graph, s: int = 1) -> DataFrame:
    """id, score: the closeness of the edges over pairs that share s members or more."""
    from weft.operators.matrices import as_line_graph

    return closeness(as_line_graph(g, s))


def s_walk_betweenness(g: Graph, s: int = 1) -> DataFrame:
    """id, score: the betweenness of the edges over pairs that share s members or more."""
    from weft.operators.matrices import as_line_graph

    return betweenness(as_line_graph(g, s))
