"""Biconnected components and articulation points, without a search in depth.

A spanning forest in levels gives each node a number in preorder and the size of its subtree. Of each subtree the least and greatest number
that it or a neighbour of it has says whether its link to the parent lies on a cycle with the link above. Tree links are joined by these tests and by the
links outside the forest, and the connected classes of tree links are the biconnected components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.paths import components, connected_components
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, fixpoint


def _forest(g: Graph, adj: DataFrame) -> DataFrame:
    """id, parent, d of a spanning forest in levels, from the smallest id of each component."""
    comp = connected_components(g)
    roots = comp.where("id = component").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("d"))
    grow = lambda new: new.join(adj, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent"), (F.min("d") + 1).alias("d"))
    return checkpoint(fixpoint(roots, grow, ["id"]))


def biconnected(g: Graph) -> DataFrame:
    """block, id: the members of each biconnected component, of two nodes or more; block is the smallest child of a tree link in it. Links join the members of an edge."""
    adj = checkpoint(g.adj.select("u", "v"))
    tree = _forest(g, adj)
    depth = tree.agg(F.max("d")).first()[0] or 0
    # sizes of subtrees, from the leaves up
    size, level = None, tree.where(F.col("d") == depth).select("id", "parent", "d", F.lit(1).cast("bigint").alias("n"))
    for d in range(depth, -1, -1):
        size = level if size is None else checkpoint(size.unionByName(level))
        if d:
            up = level.groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("m"))
            level = checkpoint(tree.where(F.col("d") == d - 1).join(up, "id", "left").select("id", "parent", "d", (1 + F.coalesce("m", F.lit(0))).alias("n")))
    # numbers in preorder, from the roots down: a child's follow those of its siblings before it; each tree counts from 0, and its root tells trees apart
    before = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    at = checkpoint(size.where("d = 0").select("id", "parent", "n", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("pre")))
    numbered = at
    for d in range(1, depth + 1):
        kids = size.where(F.col("d") == d).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
        up = at.select(F.col("id").alias("parent"), "root", F.col("pre").alias("above"))
        at = checkpoint(kids.join(up, "parent").select("id", "parent", "n", "root", (F.col("above") + 1 + F.col("off")).alias("pre")))
        numbered = checkpoint(numbered.unionByName(at))
    # the least and greatest number next to a subtree, over links outside the forest
    of = lambda c: numbered.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("n").alias(f"n{c}"), F.col("parent").alias(f"up{c}"))
    outside = checkpoint(adj.join(of("u"), "u").join(of("v"), "v").where("not (upu <=> v) and not (upv <=> u)"))
    near = outside.groupBy(F.col("u").alias("id")).agg(F.min("pv").alias("lo"), F.max("pv").alias("hi"))
    own = checkpoint(numbered.join(tree.select("id", "d"), "id").join(near, "id", "left").select("id", "parent", "d", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi")))
    low, level = None, own.where(F.col("d") == depth)
    for d in range(depth, 0, -1):
        low = level if low is None else checkpoint(low.unionByName(level))
        up = level.groupBy(F.col("parent").alias("id")).agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
        level = checkpoint(own.where(F.col("d") == d - 1).join(up, "id", "left").select("id", "parent", "d", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi")))
    if low is None:
        return g.nodes.select(F.col("id").alias("block"), "id").limit(0)
    # a tree link is named after its child
    unrelated = outside.where("pu + nu <= pv").select("u", "v")
    above = low.join(numbered.select(F.col("id").alias("parent"), F.col("pre").alias("pp"), F.col("n").alias("np"), F.col("parent").alias("grand")), "parent")
    joined = above.where("grand is not null and (lo < pp or hi >= pp + np)").select(F.col("parent").alias("u"), F.col("id").alias("v"))
    links = low.select("id", "parent")
    of_link = checkpoint(components(unrelated.unionByName(joined), links.select("id")).withColumnRenamed("component", "block"))
    return of_link.join(links, "id").select("block", F.explode(F.array("id", "parent")).alias("id")).distinct()


def articulation_points(g: Graph) -> DataFrame:
    """id of the nodes in more than one biconnected component: without one of them others are no longer connected."""
    return biconnected(g).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
