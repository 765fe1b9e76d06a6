"""Flows, cuts, spectral partitions and communities: driver loops over distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import chance
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def _levels(residual: DataFrame, source: str, target: str | None) -> DataFrame:
    """id, d: hops from source over residual(src, tgt, cap > 0), until the target is reached or nothing is new."""
    arcs = residual.where("cap > 1e-9").select("src", "tgt")
    spark = residual.sparkSession
    seen = new = checkpoint(spark.createDataFrame([(source, 0)], "id string, d int"))
    while not new.isEmpty() and (target is None or seen.where(F.col("id") == target).isEmpty()):
        found = new.join(arcs, F.col("id") == F.col("src")).select(F.col("tgt").alias("id"), (F.col("d") + 1).alias("d")).distinct()
        new = checkpoint(found.join(seen.select("id"), "id", "left_anti"))
        seen = checkpoint(seen.unionByName(new))
    return seen


def max_flow(g: Graph, source: str, target: str) -> tuple[float, DataFrame, DataFrame]:
    """The value of a maximal flow, its flows (src, tgt, flow above 0), and id of the source's side of a minimal cut.

    The capacity of a pair is the sum of its weights. Each round finds a shortest augmenting path: only that path, at most as
    long as there are nodes, and the value come to the driver. Rounds may be many; the tables stay distributed.
    """
    if source == target:
        raise ValueError("source and target are the same node")
    cap = g.pairs.where("src <> tgt").groupBy("src", "tgt").agg(F.sum("weight").alias("cap"))
    both = cap.unionByName(cap.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit(0.0).alias("cap")))
    residual = checkpoint(both.groupBy("src", "tgt").agg(F.sum("cap").alias("cap")))
    whole, value, spark = residual, 0.0, g.nodes.sparkSession
    while True:
        level = _levels(residual, source, target)
        if level.where(F.col("id") == target).isEmpty():
            break
        back = checkpoint(residual.where("cap > 1e-9").join(level.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(level.select(F.col("id").alias("tgt"), F.col("d").alias("dt")), "tgt").where("ds = dt - 1").select("src", "tgt", "cap"))
        path, at = [], target
        while at != source:
            row = back.where(F.col("tgt") == at).agg(F.min(F.struct((-F.col("cap")).alias("c"), "src")).alias("m")).first()[0]
            path.append((row.src, at, -row.c))
            at = row.src
        push = min(c for _, _, c in path)
        value += push
        steps = spark.createDataFrame([(a, b, -push) for a, b, _ in path] + [(b, a, push) for a, b, _ in path], "src string, tgt string, x double")
        residual = checkpoint(residual.join(F.broadcast(steps), ["src", "tgt"], "left").select("src", "tgt", (F.col("cap") + F.coalesce("x", F.lit(0.0))).alias("cap")))
    flow = whole.join(residual.select("src", "tgt", F.col("cap").alias("left")), ["src", "tgt"]).select("src", "tgt", (F.col("cap") - F.col("left")).alias("flow")).where("flow > 1e-9")
    return value, flow, level.select("id")


def fiedler(g: Graph, rounds: int = 20) -> DataFrame:
    """id, x after rounds of power iteration on c I - L, without the constant part, from hashes of ids; c is twice the largest weighted degree. L weighs links by the edges shared.

    x tends to the Fiedler vector; its sign is such that the smallest id is not negative. Sides of a bisection are x < 0 and the rest.
    """
    adj = checkpoint(g.adj)
    deg = adj.groupBy(F.col("u").alias("id")).agg(F.sum("shared").cast("double").alias("d"))
    start = 2 * chance(0, "id") - 1
    now = checkpoint(g.nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"), start.alias("x")))
    c = 2 * (now.agg(F.max("d")).first()[0] or 1.0)
    for _ in range(rounds):
        pull = adj.join(now.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("shared") * F.col("x")).alias("s"))
        raw = now.join(pull, "id", "left").select("id", "d", ((c - F.col("d")) * F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        raw = checkpoint(raw)
        mean, spread, n = raw.agg(F.avg("x"), F.stddev_pop("x"), F.count("*")).first()
        if not spread:
            return raw.select("id", F.lit(0.0).alias("x"))
        now = raw.select("id", "d", ((F.col("x") - mean) / (spread * n**0.5)).alias("x"))
    now = checkpoint(now)
    first = now.agg(F.min_by("x", "id")).first()[0]
    return now.select("id", (F.col("x") * (-1 if first is not None and first < 0 else 1)).alias("x"))


def algebraic_connectivity(g: Graph, rounds: int = 60) -> DataFrame:
    """One row, value: the Rayleigh quotient of fiedler's vector, which tends to the second smallest eigenvalue from above."""
    x = checkpoint(fiedler(g, rounds))
    side = lambda c: x.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"))
    top = g.links.join(side("u"), "u").join(side("v"), "v").agg(F.sum(F.col("shared") * F.pow(F.col("xu") - F.col("xv"), 2)).alias("a"))
    return top.join(F.broadcast(x.agg(F.sum(F.col("x") * F.col("x")).alias("b")))).select((F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("value"))


def local_moves(g: Graph, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """id, community: nodes go where modularity gains most, ties to the smallest, in rounds until none would move.

    In a round only those whose hash is even, then odd, with the round may move, and no pair of neighbouring movers swaps: the one
    of smaller gain, ties by id, stays. So each move still gains what was computed, but for the shift of the communities' totals.
    """
    adj = checkpoint(g.adj)
    k = adj.groupBy(F.col("u").alias("id")).agg(F.sum("shared").cast("double").alias("k"))
    now = checkpoint(g.nodes.select("id").join(k, "id", "left").select("id", F.col("id").alias("community"), F.coalesce("k", F.lit(0.0)).alias("k")))
    m2 = now.agg(F.sum("k")).first()[0]
    if not m2:
        return now.select("id", "community")
    idle = 0
    for t in range(rounds * 2):
        total = now.groupBy("community").agg(F.sum("k").alias("tot"))
        to = adj.join(now.select(F.col("id").alias("v"), "community"), "v").groupBy(F.col("u").alias("id"), "community").agg(F.sum("shared").cast("double").alias("w"))
        own = now.select("id", F.col("community").alias("old"), "k").where(F.pmod(F.xxhash64("id"), F.lit(2)) == t % 2)
        rows = own.select("id", F.col("old").alias("community")).join(to, ["id", "community"], "left").select("id", "community", F.coalesce("w", F.lit(0.0)).alias("w"))
        rows = rows.unionByName(to.join(own.select("id", F.col("old").alias("community")), ["id", "community"], "left_anti").join(own.select("id"), "id", "left_semi").select("id", "community", "w"))
        rows = rows.join(total, "community").join(own, "id")
        rest = F.col("tot") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / m2, 9)
        rows = rows.select("id", "community", "old", gain.alias("gain"))
        best = rows.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "community")).alias("m"), F.max(F.when(F.col("community") == F.col("old"), F.col("gain"))).alias("stay"), F.max("old").alias("old"))
        want = checkpoint(best.where("-m.g > stay").select("id", F.col("m.community").alias("to"), "old", (-F.col("m.g") - F.col("stay")).alias("more")))
        side = lambda c: want.select(F.col("id").alias(c), F.struct((-F.col("more")).alias("more"), F.col("id").alias("i")).alias(f"r{c}"))  # noqa: E731, B023
        beaten = adj.join(side("u"), "u").join(side("v"), "v").where("rv < ru").select(F.col("u").alias("id")).distinct()
        moves = checkpoint(want.join(beaten, "id", "left_anti").select("id", "to"))
        idle = idle + 1 if moves.isEmpty() else 0
        if idle == 2:
            break
        if not idle:
            now = checkpoint(now.join(moves, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k"))
    least = now.groupBy("community").agg(F.min("id").alias("name"))
    return now.join(least, "community").select("id", F.col("name").alias("community"))
