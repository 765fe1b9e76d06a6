"""Graphs made from numbers. Nothing is kept on the driver, and random ones come from hashes of the seed, so each run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.columns import chance
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def _node(i: Column, prefix: str = "n") -> Column:
    return F.concat(F.lit(prefix), i.cast("string"))


def _graph(spark: SparkSession, n: int, members: DataFrame, prefix: str) -> Graph:
    """From members.ids, ascending numbers; the first is the source."""
    ids = members.select(F.transform("ids", lambda i: _node(i, prefix)).alias("ids"))
    edges = ids.select(F.array_join("ids", "-").alias("edge_id"), F.slice("ids", 1, 1).alias("source_ids"), F.array_sort(F.slice("ids", 2, 1 << 30)).alias("target_ids"), F.lit("").alias("label"), F.lit(1.0).alias("weight"))
    nodes = spark.range(n).select(_node(F.col("id"), prefix).alias("id"), _node(F.col("id"), prefix).alias("label"), F.create_map().cast("map<string,string>").alias("data"), F.lit(1.0).alias("weight"))
    return Graph(nodes, edges)


def complete(spark: SparkSession, n: int, order: int = 1, prefix: str = "n") -> Graph:
    """Every set of order + 1 nodes; each set grows by larger numbers in its own row."""
    rows = spark.range(n).select(F.array("id").alias("ids"))
    for _ in range(order):
        last = F.element_at("ids", -1)
        grown = rows.where(last < n - 1).select("ids", F.explode(F.sequence(last + 1, F.lit(n - 1).cast("bigint"))).alias("x"))
        rows = grown.select(F.concat("ids", F.array("x")).alias("ids"))
    return _graph(spark, n, rows, prefix)


def star(spark: SparkSession, n: int, prefix: str = "n") -> Graph:
    """Node 0 with each other one."""
    return _graph(spark, n, spark.range(1, n).select(F.array(F.lit(0).cast("bigint"), "id").alias("ids")), prefix)


def ring_lattice(spark: SparkSession, n: int, d: int, k: int, prefix: str = "n") -> Graph:
    """Each node with every k - 1 of those at most d / 2 away on a ring; equal sets once, the smallest number is the source."""
    half = d // 2
    near = F.array(*[F.pmod(F.col("id") + o, F.lit(n)) for o in range(-half, half + 1) if o]) if half else F.array().cast("array<bigint>")
    rows = spark.range(n).select(F.array("id").alias("ids"), F.array_sort(F.array_except(F.array_distinct(near), F.array("id"))).alias("near"))
    for step in range(k - 1):
        open_ = F.col("near") if step == 0 else F.filter("near", lambda x: x > F.element_at("ids", -1))
        rows = rows.select("ids", "near", F.explode(open_).alias("x")).select(F.concat("ids", F.array("x")).alias("ids"), "near")
    return _graph(spark, n, rows.select(F.array_sort("ids").alias("ids")).distinct(), prefix)


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: int = 0, prefix: str = "n") -> Graph:
    """A ring where each node leads to the next k / 2; with chance p an edge leads to any node but its two ends instead."""
    k = min(k + k % 2, n - 1)
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(max(k // 2, 1)))).alias("j")).where(F.lit(k >= 2)).select("id", "j", F.pmod(F.col("id") + F.col("j"), F.lit(n)).alias("to"))
    # one of the n - 2 others, counted on from the own end, past the old one
    skip = F.floor(chance(seed, F.lit("to"), F.col("id"), F.col("j")) * (n - 2)).cast("bigint") + 1
    other = F.pmod(F.col("id") + F.when(skip >= F.col("j"), skip + 1).otherwise(skip), F.lit(n))
    to = F.when(chance(seed, F.lit("re"), F.col("id"), F.col("j")) < p, other).otherwise(F.col("to"))
    g = _graph(spark, n, rows.select(F.array("id", to).alias("ids"), "j"), prefix)
    edges = rows.select("id", "j", to.alias("to")).select(F.concat_ws("-", _node(F.col("id"), prefix), F.col("j").cast("string")).alias("edge_id"), F.array(_node(F.col("id"), prefix)).alias("source_ids"), F.array(_node(F.col("to"), prefix)).alias("target_ids"), F.lit("").alias("label"), F.lit(1.0).alias("weight"))
    return Graph(g.nodes, edges)


def block_model(spark: SparkSession, sizes: list[int], p_in: float, p_out: float, seed: int = 0, prefix: str = "n") -> Graph:
    """Pairs of nodes of one block with chance p_in, of two with p_out. Nodes carry their block as data."""
    n = sum(sizes)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    block = lambda c: sum((F.when(c >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    rows = spark.range(max(n - 1, 0)).select("id", F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("bigint"))).alias("x"))
    p = F.when(block(F.col("id")) == block(F.col("x")), p_in).otherwise(p_out)
    g = _graph(spark, n, rows.where(chance(seed, "id", "x") < p).select(F.array("id", "x").alias("ids")), prefix)
    number = F.substring(F.col("id"), len(prefix) + 1, 20).cast("bigint")
    return Graph(g.nodes.withColumn("data", F.create_map(F.lit("block"), block(number).cast("string"))), g.edges)


def uniform(spark: SparkSession, n: int, m: int, k: int, seed: int = 0, prefix: str = "n") -> Graph:
    """m edges of k different nodes each; two edges may be alike. The i-th draw counts on among the n - i numbers not drawn yet."""
    if k > n:
        raise ValueError("an edge can't have more members than there are nodes")
    ids = F.array().cast("array<bigint>")
    rows = spark.range(m).select("id", ids.alias("ids"))
    for i in range(k):
        draw = F.floor(chance(seed, F.lit(i), F.col("id")) * (n - i)).cast("bigint")
        # past each smaller number that is taken, in ascending order
        free = F.aggregate(F.array_sort("ids"), draw, lambda x, taken: F.when(taken <= x, x + 1).otherwise(x))
        rows = rows.select("id", F.concat("ids", F.array(free)).alias("ids"))
    g = _graph(spark, n, rows.select(F.array_sort("ids").alias("ids")), prefix)
    named = rows.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("edge_id"), F.transform(F.array_sort("ids"), lambda i: _node(i, prefix)).alias("ids"))
    edges = named.select("edge_id", F.slice("ids", 1, 1).alias("source_ids"), F.array_sort(F.slice("ids", 2, max(k - 1, 1))).alias("target_ids"), F.lit("").alias("label"), F.lit(1.0).alias("weight"))
    return Graph(g.nodes, edges)


def random_sets(spark: SparkSession, n: int, chances: list[float], seed: int = 0, prefix: str = "n") -> Graph:
    """Every set of d + 2 nodes with chance chances[d], for each d."""
    rows = None
    for d, p in enumerate(chances):
        g = complete(spark, n, d + 1, prefix)
        kept = g.edges.where(chance(seed, "edge_id") < p)
        rows = kept if rows is None else rows.unionByName(kept)
    return Graph(complete(spark, n, 0, prefix).nodes, rows)


def chung_lu(spark: SparkSession, weights: list[float], seed: int = 0, prefix: str = "n") -> Graph:
    """Each pair of nodes with chance min(1, product of their weights / sum of all)."""
    n, total = len(weights), sum(weights)
    w = lambda i: F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (i + 1).cast("int"))
    rows = spark.range(max(n - 1, 0)).select("id", F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("bigint"))).alias("x"))
    return _graph(spark, n, rows.where(chance(seed, "id", "x") < F.least(w(F.col("id")) * w(F.col("x")) / total, F.lit(1.0))).select(F.array("id", "x").alias("ids")), prefix)


def preferential(spark: SparkSession, n: int, m: int, seed: int = 0, prefix: str = "n") -> Graph:
    """Preferential attachment: each node but the first leads to ``m`` earlier ends, drawn by their degrees so far; equal targets count once, loops go.

    Ends stand in a row, two for each edge: at 2 i the new node, at 2 i + 1 a copy of a uniformly drawn earlier place, which a hash of i
    gives. A copy of a copy is followed back, for all edges at once, so no edge waits for those before it.
    """
    edges = spark.range((n - 1) * m).select(F.col("id").alias("i"), (F.floor(F.col("id") / m) + 1).alias("own"))
    place = F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.floor(chance(seed, "i") * 2 * F.col("i"))).cast("bigint")
    drawn = edges.select("i", "own", place.alias("at"))

    def followed(rows: DataFrame) -> DataFrame:
        back = drawn.select((2 * F.col("i") + 1).alias("at"), F.col("at").alias("next"))
        return rows.join(back, "at", "left").select("i", "own", F.coalesce("next", "at").alias("at"))

    rows = drawn
    while not (odd := rows.where("at > 0 and at % 2 = 1")).isEmpty():
        rows = checkpoint(rows.where("at <= 0 or at % 2 = 0").unionByName(followed(odd)))
    to = F.when(F.col("at") < 0, F.lit(0)).otherwise(F.floor(F.col("at") / (2 * m)) + 1).cast("bigint")
    ids = rows.select(F.col("own").alias("a"), to.alias("b")).where("a <> b").distinct()
    return _graph(spark, n, ids.select(F.array("b", "a").alias("ids")), prefix)


def shuffled(g: Graph, p: float, seed: int = 0) -> Graph:
    """g with the targets of each edge, with chance p, in place of those of the edge that stands before it among the chosen ones, by a hash.

    So every node keeps its numbers of edges. The chosen edges are put in order within 64 parts of the hash, and each part is a ring.
    """
    h = chance(seed, F.lit("order"), "edge_id")
    chosen = g.edges.where(chance(seed, F.lit("pick"), "edge_id") < p).withColumn("h", h).withColumn("part", F.floor(h * 64))
    w = Window.partitionBy("part").orderBy("h", "edge_id")
    last = F.last("target_ids").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = chosen.withColumn("target_ids", F.coalesce(F.lag("target_ids").over(w), last))
    return Graph(g.nodes, g.edges.where(chance(seed, F.lit("pick"), "edge_id") >= p).unionByName(moved.select(*g.edges.columns)))


def block_sets(spark: SparkSession, sizes: list[int], k: int, p_in: float, p_out: float, seed: int = 0, prefix: str = "n") -> Graph:
    """Every set of k nodes, with chance p_in if all are of one block, else p_out. Nodes carry their block as data."""
    n, ends = sum(sizes), [sum(sizes[: i + 1]) for i in range(len(sizes))]
    number = lambda c: F.substring(c, len(prefix) + 1, 20).cast("bigint")
    block = lambda c: sum((F.when(number(c) >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    g = complete(spark, n, k - 1, prefix)
    blocks = F.array_distinct(F.transform(F.concat("source_ids", "target_ids"), block))
    edges = g.edges.where(chance(seed, "edge_id") < F.when(F.size(blocks) == 1, p_in).otherwise(p_out))
    return Graph(g.nodes.withColumn("data", F.create_map(F.lit("block"), block(F.col("id")).cast("string"))), edges)
