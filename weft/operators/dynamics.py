"""Processes over a graph in steps. Random choices are hashes of seed, step and ids, so that they don't change when a task runs again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import chance
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def contagion(g: Graph, infected: DataFrame, steps: int, beta: float = 0.1, beta_group: float = 0.05, mu: float = 0.1, seed: int = 0) -> DataFrame:
    """step, infected: the number of infected nodes from step 0 on.

    In each step infected nodes recover with chance mu. Then each edge infects each of its healthy members with chance
    1 - (1 - beta)^k, k its infected members, and, where k is 2 or more, once more with beta_group. An edge's draws are independent, so a
    node stays healthy with the product of its edges' chances.
    """
    now = checkpoint(infected.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi"))
    members = checkpoint(g.members.select("edge_id", F.col("node_id").alias("id")))
    counts = [now.agg(F.lit(0).cast("bigint").alias("step"), F.count("*").alias("infected"))]
    for t in range(1, steps + 1):
        sick = now.where(chance(seed, F.lit(f"r{t}"), F.col("id")) >= mu)
        k = members.join(sick, "id", "left_semi").groupBy("edge_id").agg(F.count("*").alias("k"))
        healthy = F.pow(F.lit(1 - beta), F.col("k")) * F.when(F.col("k") >= 2, 1 - beta_group).otherwise(1.0)
        caught = members.join(k, "edge_id").join(sick, "id", "left_anti").where(chance(seed, F.lit(f"i{t}"), F.col("edge_id"), F.col("id")) < 1 - healthy)
        now = checkpoint(sick.unionByName(caught.select("id")).distinct())
        counts.append(now.agg(F.lit(t).cast("bigint").alias("step"), F.count("*").alias("infected")))
    out = counts[0]
    for row in counts[1:]:
        out = out.unionByName(row)
    return out


def kuramoto(g: Graph, theta: DataFrame, omega: float = 1.0, k2: float = 1.0, k3: float = 0.5, steps: int = 10, dt: float = 0.01) -> DataFrame:
    """id, theta after as many Euler steps from theta(id, theta).

    The sine of the difference to each other member of an edge of two pulls with k2, and in an edge of three the sine of the sum of
    the other two less twice the own phase with k3; edges of other sizes don't pull.
    """
    pairs = checkpoint(g.members.where("size = 2").select("edge_id", "node_id").alias("p").join(g.members.where("size = 2").select("edge_id", F.col("node_id").alias("other")), "edge_id").where("node_id <> other").select("node_id", "other"))
    three = checkpoint(g.members.where("size = 3").select("edge_id", "node_id"))
    now = checkpoint(theta.select("id", F.col("theta").cast("double").alias("theta")))
    for _ in range(steps):
        at = lambda c: now.select(F.col("id").alias(c), F.col("theta").alias(f"t_{c}"))
        pull2 = pairs.join(at("node_id"), "node_id").join(at("other"), "other").select(F.col("node_id").alias("id"), (k2 * F.sin(F.col("t_other") - F.col("t_node_id"))).alias("pull"))
        sums = three.join(at("node_id"), "node_id")
        total = sums.groupBy("edge_id").agg(F.sum("t_node_id").alias("all"))
        pull3 = sums.join(total, "edge_id").select(F.col("node_id").alias("id"), (k3 * F.sin(F.col("all") - 3 * F.col("t_node_id"))).alias("pull"))
        pull = pull2.unionByName(pull3).groupBy("id").agg(F.sum("pull").alias("pull"))
        now = checkpoint(now.join(pull, "id", "left").select("id", (F.col("theta") + dt * (omega + F.coalesce("pull", F.lit(0.0)))).alias("theta")))
    return now


def order_parameter(theta: DataFrame) -> DataFrame:
    """One row, r: the length of the mean of the phases as unit vectors, 1 if all agree; null without rows."""
    return theta.agg(F.sqrt(F.pow(F.avg(F.cos("theta")), 2) + F.pow(F.avg(F.sin("theta")), 2)).alias("r"))


def random_walks(g: Graph, sources: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """source, step, id: a walk from each of sources.id. A step goes to a neighbour, the likelier the more edges are shared; it ends where there is none.

    Of a node's neighbours the one with the least -ln(chance) / shared is drawn, which needs no order among them.
    """
    adj = checkpoint(g.adj)
    at = out = checkpoint(sources.select(F.col("id").alias("source"), F.lit(0).cast("bigint").alias("step"), "id").distinct())
    for t in range(1, steps + 1):
        draw = -F.log(F.greatest(chance(seed, F.lit(t), F.col("source"), F.col("v")), F.lit(1e-300))) / F.col("shared")
        moves = at.join(adj, F.col("id") == F.col("u")).groupBy("source").agg(F.min(F.struct(draw.alias("x"), "v")).alias("m"))
        at = checkpoint(moves.select("source", F.lit(t).cast("bigint").alias("step"), F.col("m.v").alias("id")))
        out = out.unionByName(at)
    return out
