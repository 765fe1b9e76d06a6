"""Connected components of a graph given as a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that has a link to another one: node and root, the smallest node reachable from it.

    In every round each node points to its smallest neighbour or itself, pointers are followed to their ends, by doubling,
    and the links are replaced by those between these ends. The number of nodes with links at least halves each time,
    so there are about log2 of it many rounds at most, and usually two or three. Neighbours are combined by minimum before they are
    shuffled and are never gathered in a list; links and pointers stay distributed.
    """
    links = checkpoint(links.select(links[a].alias("a"), links[b].alias("b")).where("a <> b").distinct())
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to"))
        to, moved = checkpoint(to), True
        while moved:
            far = checkpoint(to.join(to.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            to, moved = far.select("a", "to"), not far.where("moved").isEmpty()
        if roots is None:
            roots = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = checkpoint(roots)
        of_a, of_b = to.select("a", F.col("to").alias("ra")), to.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        links = checkpoint(links.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if roots is None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
