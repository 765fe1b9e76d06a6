"""Event logs, feedback, degradation, agreement of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.degrees import triangles
from weft.operators.lookup import breadth_first
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def log_query(events: DataFrame, event_type: str | None = None, since: Column | None = None, last: int | None = None) -> DataFrame:
    """The events of a type, from a time on; ``last``: only so many newest, ties by event_id."""
    rows = events if event_type is None else events.where(F.col("event_type") == event_type)
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    return rows if last is None else rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)


def signals(feedback: DataFrame, least: int = 2) -> DataFrame:
    """id, good, bad, verdict over feedback(id, relevant): reinforced (more good than bad), suppressed (as many bad as ``least``, and as many as good), or neutral; of ``least`` signals or more."""
    rows = feedback.groupBy("id").agg(F.count_if(F.col("relevant")).alias("good"), F.count_if(~F.col("relevant")).alias("bad")).where(F.col("good") + F.col("bad") >= least)
    verdict = F.when(F.col("good") > F.col("bad"), "reinforced").when(F.col("bad") >= least, "suppressed").otherwise("neutral")
    return rows.select("id", "good", "bad", verdict.alias("verdict"))


def degradation(runs: DataFrame, recent: int = 10, factor: float = 1.5) -> DataFrame:
    """operation, recent, before, degraded: the mean of the newest ``recent`` durations (runs of operation, ts, id, value) against that of all before.

    The newest are ranked in 32 parts of an operation first, so that one task never sorts all rows of a frequent one.
    """
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id")))
    part = runs.select("operation", "ts", "id", F.pmod(F.hash("id", "ts"), F.lit(32)).alias("part"))
    top = part.withColumn("k", newest("operation", "part")).where(F.col("k") <= recent).withColumn("k", newest("operation")).where(F.col("k") <= recent)
    first = top.groupBy("operation").agg(F.min(F.struct("ts", "id")).alias("first"))
    new = F.struct("ts", "id") >= F.col("first")
    rows = runs.join(first, "operation").groupBy("operation").agg(F.avg(F.when(new, F.col("value"))).alias("recent"), F.avg(F.when(~new, F.col("value"))).alias("before"))
    return rows.select("operation", "recent", "before", F.coalesce(F.col("recent") > factor * F.col("before"), F.lit(False)).alias("degraded"))


def consensus(views: DataFrame, n_views: int, how: str = "intersection") -> DataFrame:
    """id, share of n_views that have it in views(view, id): of all of them (intersection), of more than half (majority), of any (union).

    The number is given, since a view without rows counts as well: with one, nothing is in the intersection.
    """
    rows = views.distinct().groupBy("id").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n_views)
    test = {"intersection": F.col("n") == n_views, "majority": 2 * F.col("n") > n_views, "union": F.lit(True)}[how]
    return rows.where(test).select("id", "share")


def compare_sets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: common, jaccard, precision, recall, f1 of two sets of ids; 0 where there is nothing to divide by."""
    both = found.select("id").distinct().withColumn("f", F.lit(1)).join(truth.select("id").distinct().withColumn("t", F.lit(1)), "id", "full_outer")
    s = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("common"), F.count("f").alias("f"), F.count("t").alias("t"), F.count("*").alias("all"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col("common")
    return s.select("common", ratio(c, F.col("all")).alias("jaccard"), ratio(c, F.col("f")).alias("precision"), ratio(c, F.col("t")).alias("recall"), ratio(2 * c, F.col("f") + F.col("t")).alias("f1"))


def density_map(points: DataFrame, resolution: int = 10) -> DataFrame:
    """x, y, n: points(px, py) in the cells of a square grid over their range; the greatest values belong to the last cell."""
    box = points.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    cell = lambda v, a, b: F.when(F.col(b) > F.col(a), F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * resolution), F.lit(resolution - 1))).otherwise(0).cast("bigint")
    return points.where("px is not null and py is not null").join(F.broadcast(box)).groupBy(cell("px", "x0", "x1").alias("x"), cell("py", "y0", "y1").alias("y")).agg(F.count("*").alias("n"))


def trend(history: DataFrame, last: int = 5, least: float = 0.02) -> DataFrame:
    """operation, slope, trend of history(operation, ts, id, fitness): last value less first over the newest ``last``, by their number.

    improving or declining beyond ``least``, else stable; insufficient_data of fewer than two values.
    """
    w = Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("id"))
    part = history.withColumn("part", F.pmod(F.hash("id", "ts"), F.lit(32)))
    rows = part.withColumn("k", F.row_number().over(Window.partitionBy("operation", "part").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("k") <= last)
    rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    ends = rows.groupBy("operation").agg(F.max_by("fitness", F.struct("ts", "id")).alias("new"), F.min_by("fitness", F.struct("ts", "id")).alias("old"), F.count("*").alias("n"))
    slope = F.when(F.col("n") > 1, (F.col("new") - F.col("old")) / F.col("n"))
    name = F.when(F.col("n") < 2, "insufficient_data").when(slope > least, "improving").when(slope < -least, "declining").otherwise("stable")
    return ends.select("operation", slope.alias("slope"), name.alias("trend"))


def effectiveness(log: DataFrame) -> DataFrame:
    """rule, n, success, share, mean of log(rule, ok, value): runs, successes, the rule's share of all runs, mean value."""
    rows = log.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("good"), F.avg("value").alias("mean"))
    return rows.withColumn("all", log.agg(F.count("*")).scalar()).select("rule", "n", (F.col("good") / F.col("n")).alias("success"), (F.col("n") / F.col("all")).alias("share"), "mean")


def bias(log: DataFrame) -> DataFrame:
    """One row: rules, entropy (bits) of the rules' shares, evenness (entropy over the greatest possible one), favourite (ties by name)."""
    p = effectiveness(log).select("rule", F.col("share").alias("p"))
    rows = p.agg(F.count("*").alias("rules"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.min(F.struct((-F.col("p")).alias("p"), "rule")).alias("m"))
    return rows.select("rules", "entropy", F.when(F.col("rules") > 1, F.col("entropy") / F.log2(F.col("rules").cast("double"))).otherwise(1.0).alias("evenness"), F.col("m.rule").alias("favourite"))


def health(g: Graph) -> DataFrame:
    """One row of a graph's state: nodes, edges, alone (share of nodes without edges), degree (mean), weight (mean of edges), fitness (mean of connectedness and of weight up to 1)."""
    d = g.degree.agg(F.count("*").alias("nodes"), F.avg((F.col("degree") == 0).cast("double")).alias("alone"), F.avg("degree").alias("degree"))
    e = g.edges.agg(F.count("*").alias("edges"), F.avg("weight").alias("weight"))
    # one row each
    rows = d.withColumn("edges", e.select("edges").scalar()).withColumn("weight", F.coalesce(e.select("weight").scalar(), F.lit(0.0)))
    return rows.select("nodes", "edges", "alone", "degree", "weight", ((1 - F.col("alone") + F.least("weight", F.lit(1.0))) / 2).alias("fitness"))


def alarms(state: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """name, value, low, high: the measures of one row of state that are outside their limits."""
    rows = [F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high")) for k, (a, b) in limits.items()]
    return state.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("value < low or value > high")


def regress(g: Graph, least: int = 4) -> DataFrame:
    """label, src, hops: directed chains of ``least`` arcs over one label from a node, without repeated nodes: their number of arcs and starts, one row per start and label."""
    arcs = checkpoint(g.pairs.where("src <> tgt").select("label", "src", "tgt").distinct())
    at = arcs.select("label", "src", F.array("src", "tgt").alias("path"), F.col("tgt").alias("end"))
    step = arcs.select(F.col("label").alias("l"), F.col("src").alias("s"), F.col("tgt").alias("t"))
    for _ in range(least - 1):
        at = checkpoint(at.join(step, (F.col("label") == F.col("l")) & (F.col("end") == F.col("s"))).where(~F.array_contains("path", F.col("t"))).select("label", "src", F.concat("path", F.array("t")).alias("path"), F.col("t").alias("end")))
    return at.groupBy("label", "src").agg(F.count("*").alias("chains"))


def negation_cycles(g: Graph, label: str, denial: str, most: int = 6) -> DataFrame:
    """path (comma-joined): directed cycles of an even number of arcs, most at most, whose labels take turns between label and denial, from the smallest node that begins one on."""
    arcs = checkpoint(g.pairs.where(F.col("label").isin(label, denial) & (F.col("src") != F.col("tgt"))).select("label", "src", "tgt").distinct())
    step = arcs.select(F.col("label").alias("l"), F.col("src").alias("s"), F.col("tgt").alias("t"))
    at = arcs.where(F.col("label") == label).select(F.array("src", "tgt").alias("path"), F.col("src").alias("first"), F.col("tgt").alias("end"), "label")
    out = None
    for n in range(2, most + 1):
        at = at.join(step, (F.col("end") == F.col("s")) & (F.col("label") != F.col("l")))
        if n % 2 == 0:
            closed = at.where("t = first").select("path")
            out = closed if out is None else out.unionByName(closed)
        at = checkpoint(at.where(~F.array_contains("path", F.col("t"))).select(F.concat("path", F.array("t")).alias("path"), "first", F.col("t").alias("end"), F.col("l").alias("label")))
    starts = F.filter("path", lambda _, i: i % 2 == 0)
    return out.where(F.get("path", F.lit(0)) == F.array_min(starts)).select(F.array_join("path", ",").alias("path"))


def stable(views: DataFrame, n_views: int) -> DataFrame:
    """id, property, value that all of n_views have alike in views(view, id, property, value)."""
    rows = views.groupBy("id", "property").agg(F.countDistinct("view").alias("n"), F.countDistinct("value").alias("k"), F.min("value").alias("value"))
    return rows.where((F.col("n") == n_views) & (F.col("k") == 1)).select("id", "property", "value")


def local_clustering(g: Graph, seeds: DataFrame) -> DataFrame:
    """One row, value: the mean clustering coefficient of the seeds and their neighbours."""
    near = g.adj.select(F.col("u").alias("id"), "v").join(seeds.select("id"), "id", "left_semi").select(F.col("v").alias("id")).unionByName(seeds.select("id")).distinct()
    return triangles(g).join(near, "id", "left_semi").agg(F.avg("clustering").alias("value"))


def boundaries(g: Graph) -> DataFrame:
    """id, zone: core (as many neighbours as the mean or more), edge (fewer), or isolated (none)."""
    k = g.neighbor_degree
    return k.withColumn("mean", k.agg(F.avg("k")).scalar()).select("id", F.when(F.col("k") == 0, "isolated").when(F.col("k") >= F.col("mean"), "core").otherwise("edge").alias("zone"))


def bridging(g: Graph, node: str, top_k: int = 5) -> DataFrame:
    """id, gain: the nodes two hops away by which an edge from the node would bring most new neighbours into reach of two hops, ties by id."""
    first = g.adj.where(F.col("u") == node).select(F.col("v").alias("id"))
    second = g.adj.join(first.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
    known = checkpoint(first.unionByName(second).distinct())
    far = second.where(F.col("id") != node).join(first, "id", "left_anti")
    gain = g.adj.select(F.col("u").alias("id"), F.col("v").alias("x")).join(far, "id", "left_semi").where(F.col("x") != node).join(known.withColumnRenamed("id", "x"), "x", "left_anti")
    return far.join(gain.groupBy("id").agg(F.count("*").alias("gain")), "id", "left").select("id", F.coalesce("gain", F.lit(0)).alias("gain")).orderBy(F.desc("gain"), "id").limit(top_k)


def robust_reach(g: Graph, seeds: DataFrame, depths: list[int]) -> DataFrame:
    """id: what is within reach of the seeds in every one of the frames: directed, against the direction, and undirected, each with its depth."""
    back = Graph(g.nodes, g.edges.select("edge_id", F.col("target_ids").alias("source_ids"), F.col("source_ids").alias("target_ids"), "label", "weight"))
    runs = [breadth_first(g, seeds, depths[0], True), breadth_first(back, seeds, depths[1], True), breadth_first(g, seeds, depths[2])]
    out = runs[0].select("id")
    for r in runs[1:]:
        out = out.join(r.select("id"), "id", "left_semi")
    return out


def perspectives(g: Graph, seeds: DataFrame, frames: dict[str, tuple[int, bool]]) -> DataFrame:
    """frame, reach, far, density: what is within reach of the seeds in each frame (depth, directed): nodes, the greatest depth, and links among them over their possible number."""
    out = None
    for name, (depth, directed) in frames.items():
        found = checkpoint(breadth_first(g, seeds, depth, directed))
        size = found.agg(F.count("*").alias("reach"), F.max("depth").alias("far"))
        inside = g.links.join(found.select(F.col("id").alias("u")), "u", "left_semi").join(found.select(F.col("id").alias("v")), "v", "left_semi").agg(F.count("*").alias("m"))
        density = F.when(F.col("reach") > 1, 2 * F.col("m") / (F.col("reach") * (F.col("reach") - 1))).otherwise(0.0)
        row = size.withColumn("m", inside.scalar()).select(F.lit(name).alias("frame"), "reach", "far", density.alias("density"))
        out = row if out is None else out.unionByName(row)
    return out
