"""Updates and versions: each returns a new Graph or table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.classes import classes, spread
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, fixpoint


def add_nodes(g: Graph, more: DataFrame) -> Graph:
    """Inserts the nodes whose id is new; of several new ones with one id any one."""
    return Graph(g.nodes.unionByName(more.dropDuplicates(["id"]).join(g.nodes.select("id"), "id", "left_anti"), allowMissingColumns=True), g.edges)


def add_edges(g: Graph, more: DataFrame) -> Graph:
    """Inserts the edges whose id is new and all of whose members exist."""
    members = more.select("edge_id", F.explode(F.array_union("source_ids", "target_ids")).alias("id"))
    bad = members.join(g.nodes.select("id"), "id", "left_anti").select("edge_id").distinct()
    return Graph(g.nodes, g.edges.unionByName(more.join(bad, "edge_id", "left_anti").join(g.edges.select("edge_id"), "edge_id", "left_anti").select(*g.edges.columns)))


def links(rows: DataFrame, label: str = "", weight: float = 1.0) -> DataFrame:
    """Edges of rows(source_ids, target_ids), named after label and ends. The weight must be above 0 and no side empty."""
    if weight <= 0:
        raise ValueError("an edge's weight must be above 0")
    rows = rows.where((F.size("source_ids") > 0) & (F.size("target_ids") > 0)).select(*[F.array_sort(F.array_distinct(c)).alias(c) for c in ("source_ids", "target_ids")])
    name = F.concat_ws(":", F.lit(label), F.array_join("source_ids", "+"), F.array_join("target_ids", "+"))
    return rows.select(name.alias("edge_id"), "source_ids", "target_ids", F.lit(label).alias("label"), F.lit(float(weight)).alias("weight")).dropDuplicates(["edge_id"])


def link(g: Graph, sources: list[str], targets: list[str], label: str = "", weight: float = 1.0, both_ways: bool = False) -> Graph:
    """g with an edge from sources to targets, and one back if both_ways. Ends must exist, else g is as it was."""
    sides = [(sources, targets)] + [(targets, sources)] * both_ways
    rows = g.edges.sparkSession.createDataFrame(sides, "source_ids array<string>, target_ids array<string>")
    return add_edges(g, links(rows, label, weight))


def upsert_nodes(g: Graph, more: DataFrame, boost: float = 1.0) -> Graph:
    """g with the nodes of more, which take the place of those with their id; boost multiplies the weight of replaced ones, 100 at most."""
    more = more.select(*g.nodes.columns).dropDuplicates(["id"])
    old = g.nodes.select("id", F.col("weight").alias("_old"))
    weight = F.when(F.col("_old").isNull(), F.col("weight")).otherwise(F.least(F.col("_old") * boost, F.lit(100.0)) if boost != 1 else F.col("weight"))
    new = more.join(old, "id", "left").withColumn("weight", weight).drop("_old")
    return Graph(g.nodes.join(more.select("id"), "id", "left_anti").unionByName(new), g.edges)


def upsert_edges(g: Graph, more: DataFrame) -> Graph:
    """g with the edges of more, which take the place of those with their id; those with a member that isn't there are left out."""
    return add_edges(remove_edges(g, more.select("edge_id")), more)


def remove_edges(g: Graph, gone: DataFrame) -> Graph:
    """Without the edges gone.edge_id."""
    return Graph(g.nodes, g.edges.join(gone.select("edge_id"), "edge_id", "left_anti"))


def add_all(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """add_nodes, then add_edges."""
    return add_edges(add_nodes(g, nodes), edges)


def remove_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Without the nodes gone.id and all edges that have one of them."""
    touched = g.members.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("edge_id").distinct()
    return Graph(g.nodes.join(gone.select("id"), "id", "left_anti"), g.edges.join(touched, "edge_id", "left_anti"))


def merge_node(g: Graph, primary: str, secondary: str) -> Graph:
    """Contracts secondary into primary, whose weight becomes the greater one. In edges of secondary, primary stands on both sides."""
    touched = F.array_contains("source_ids", secondary) | F.array_contains("target_ids", secondary)
    side = lambda c: F.when(touched, F.array_sort(F.array_union(F.array_remove(c, secondary), F.array(F.lit(primary))))).otherwise(F.col(c))
    weight = g.nodes.where(F.col("id").isin(primary, secondary)).agg(F.max("weight").alias("_w"))
    nodes = g.nodes.where(F.col("id") != secondary).join(F.broadcast(weight)).withColumn("weight", F.when(F.col("id") == primary, F.col("_w")).otherwise(F.col("weight"))).drop("_w")
    return Graph(nodes, g.edges.withColumn("_s", side("source_ids")).withColumn("target_ids", side("target_ids")).withColumn("source_ids", F.col("_s")).drop("_s"))


def decay(g: Graph, factor: float = 0.95) -> Graph:
    return Graph(g.nodes.withColumn("weight", F.col("weight") * factor), g.edges.withColumn("weight", F.col("weight") * factor))


def reinforce(g: Graph, ids: DataFrame, factor: float = 1.1, most: float = 100.0) -> Graph:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    nodes = g.nodes.join(hit, "id", "left").withColumn("weight", F.when(F.col("_hit"), F.least(F.col("weight") * factor, F.lit(most))).otherwise(F.col("weight"))).drop("_hit")
    return Graph(nodes, g.edges)


def prune(g: Graph, weight: float) -> Graph:
    """Without the nodes of weight or less that have no edges."""
    dead = g.nodes.where(F.col("weight") <= weight).join(g.degree.where("degree = 0"), "id", "left_semi")
    return Graph(g.nodes.join(dead.select("id"), "id", "left_anti"), g.edges)


def evolve(g: Graph, reinforced: DataFrame | None = None, suppressed: DataFrame | None = None, factor: float = 0.95, boost: float = 1.1, dead: float = 0.05) -> Graph:
    """One cycle of upkeep: all weights decay; reinforced.id are boosted, suppressed.id decay once more; nodes of weight ``dead`` or less without edges go."""
    g = decay(g, factor)
    g = g if reinforced is None else reinforce(g, reinforced, boost)
    g = g if suppressed is None else reinforce(g, suppressed, factor)
    return prune(g, dead)


def edge_diff(old: Graph, new: Graph) -> DataFrame:
    """edge_id, change: added, removed, or modified in any column."""
    text = lambda g, name: g.edges.select("edge_id", F.to_json(F.struct("source_ids", "target_ids", "label", "weight")).alias(name))
    both = text(old, "a").join(text(new, "b"), "edge_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("edge_id", change.alias("change")).where("change is not null")


def overlay(base: Graph, delta: DataFrame) -> Graph:
    """base with the edges of delta, which hide base edges of the same id."""
    return Graph(base.nodes, base.edges.join(delta.select("edge_id"), "edge_id", "left_anti").unionByName(delta.select(*base.edges.columns)))


def dependents(provenance: DataFrame, roots: DataFrame) -> DataFrame:
    """edge_id, depth: what was inferred, directly or not, from roots.edge_id. provenance: edge_id, input (a row per input)."""
    start = roots.select("edge_id", F.lit(0).cast("bigint").alias("depth"))
    step = provenance.select(F.col("edge_id").alias("made"), "input")
    found = fixpoint(start, lambda new: new.join(step, F.col("edge_id") == F.col("input")).select(F.col("made").alias("edge_id"), (F.col("depth") + 1).alias("depth")), ["edge_id"])
    return found.where("depth > 0")


def equivalences(g: Graph, least: float = 0.8, block: tuple[str, ...] = ()) -> DataFrame:
    """a < b, score: pairs whose payloads agree in enough of their shared keys, or with the neighbours' Jaccard: the larger of s and 0.4 s + 0.6 J.

    Only nodes with the same set of keys that agree in the block fields are compared.
    """
    keys = F.array_sort(F.map_keys("data"))
    rows = g.nodes.where(F.size("data") > 0).select("id", keys.alias("keys"), F.transform(keys, lambda k: F.col("data")[k]).alias("values"), *[F.col("data")[b].alias(f"_{b}") for b in block])
    # nodes with the same payload are one class; classes are compared, then their members are paired
    kinds, members = classes(rows, "keys", "values", *[f"_{b}" for b in block])
    side = lambda p: kinds.select(F.col("c").alias(f"c{p}"), "keys", F.col("values").alias(f"v{p}"), *[f"_{b}" for b in block])
    s = F.size(F.filter(F.zip_with("va", "vb", lambda x, y: x == y), lambda e: e)) / F.size("keys")
    alike = checkpoint(side("a").join(side("b"), ["keys", *[f"_{b}" for b in block]]).where("ca <= cb").select("ca", "cb", s.alias("s")))
    # the neighbours only count where the payloads alone don't decide, and where they could lift the score enough
    done = spread(alike.where(F.col("s") >= least), members).select("a", "b", F.col("s").alias("score"))
    if least <= 0:
        return done
    left = alike.where((F.col("s") < least) & (0.4 * F.col("s") + 0.6 >= least))
    if left.isEmpty():
        return done
    left = checkpoint(spread(left, members))
    nbr = g.adj.select("u", F.col("v").alias("w"))
    k = g.neighbor_degree
    shared = left.join(nbr.withColumnRenamed("u", "a"), "a").join(nbr.select(F.col("u").alias("b"), "w"), ["b", "w"]).groupBy("a", "b").agg(F.count("*").alias("c"))
    rows = left.join(shared, ["a", "b"], "left").join(k.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    j = F.when(F.col("c") > 0, F.col("c") / (F.col("ka") + F.col("kb") - F.col("c"))).otherwise(0.0)
    return done.unionByName(rows.select("a", "b", F.greatest("s", 0.4 * F.col("s") + 0.6 * j).alias("score")).where(F.col("score") >= least))


def merge_pairs(g: Graph, pairs: DataFrame) -> Graph:
    """g with the second node of pairs(a, b) merged into the first: edges point to it, and it keeps its own fields. No node may be in two pairs."""
    to = pairs.select(F.col("b").alias("node_id"), F.col("a").alias("to"))
    # edges are read once: taken apart, looked up and put together again; one without members keeps a row
    part = lambda role: F.transform(f"{role}_ids", lambda x: F.struct(F.lit(role).alias("role"), x.alias("node_id")))
    ends = g.edges.select("edge_id", "label", "weight", F.explode_outer(F.concat(part("source"), part("target"))).alias("end")).select("edge_id", "label", "weight", "end.role", "end.node_id")
    moved = ends.join(to, "node_id", "left").select("edge_id", "label", "weight", "role", F.coalesce("to", "node_id").alias("node_id")).repartition("edge_id")
    side = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("node_id")))).alias(f"{role}_ids")
    edges = moved.groupBy("edge_id").agg(side("source"), side("target"), F.any_value("label").alias("label"), F.any_value("weight").alias("weight")).select(*g.edges.columns)
    return Graph(g.nodes.join(pairs.select(F.col("b").alias("id")), "id", "left_anti"), edges)


def disjoint(pairs: DataFrame) -> DataFrame:
    """a, b, score of a greedy choice of pairs(a, b, score) that have no node in common: by descending score, then a, then b."""
    left, out = checkpoint(pairs.select("a", "b", "score")), None
    while not left.isEmpty():
        ends = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
        first = ends.groupBy("end").agg(F.min(F.struct((-F.col("score")).alias("score"), "a", "b")).alias("m"))
        now = checkpoint(first.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m.a", "m.b", (-F.col("m.score")).alias("score")))
        out = now if out is None else checkpoint(out.unionByName(now))
        taken = now.select(F.explode(F.array("a", "b")).alias("end"))
        left = checkpoint(left.join(taken.withColumnRenamed("end", "a"), "a", "left_anti").join(taken.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b", "score"))
    return left if out is None else out


def merge_equivalences(g: Graph, least: float = 0.8, block: tuple[str, ...] = ()) -> Graph:
    """g with equivalent nodes merged pair by pair, the most alike first, each node once.

    At ``least`` 1 only nodes with the same payload are equivalent, each with all others of its class, so the choice pairs a class's nodes in order of their ids,
    without a row for each of its pairs.
    """
    if least < 1:
        return merge_pairs(g, checkpoint(disjoint(equivalences(g, least, block))))
    data = F.col("data")
    whole = (F.size(data) > 0) & ~F.exists(F.map_values(data), lambda x: x.isNull())
    for b in block:
        whole &= data[b].isNotNull()
    payload = F.to_json(F.array_sort(F.map_entries(data))).alias("payload")
    rows = g.nodes.where(whole).select("id", payload)
    place = F.row_number().over(Window.partitionBy("payload").orderBy("id"))
    after = F.lead("id").over(Window.partitionBy("payload").orderBy("id"))
    pairs = rows.select(F.col("id").alias("a"), after.alias("b"), place.alias("place")).where("place % 2 = 1 and b is not null").select("a", "b")
    return merge_pairs(g, checkpoint(pairs if least == 1 else pairs.limit(0)))


def capture(g: Graph, path: str) -> str:
    """Writes a version of the graph to a folder, which is returned."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    return path


def version(spark: SparkSession, path: str) -> Graph:
    """The graph of a version: to roll back is to go on with it."""
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def save_tables(tables: dict[str, DataFrame], path: str) -> str:
    """A snapshot of any tables, by name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def layered(layers: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """The edges of named layers (edges, weight): ids are prefixed with the layer's name, weights multiplied by its weight, and a column says which layer it is."""
    out = None
    for name, (edges, weight) in layers.items():
        rows = edges.select(F.concat_ws("/", F.lit(name), "edge_id").alias("edge_id"), "source_ids", "target_ids", "label", (F.col("weight") * weight).alias("weight"), F.lit(name).alias("layer"))
        out = rows if out is None else out.unionByName(rows)
    return out


def retract(g: Graph, provenance: DataFrame, roots: DataFrame) -> Graph:
    """g without the edges roots.edge_id and all that was inferred from them."""
    gone = dependents(provenance, roots).select("edge_id").unionByName(roots.select("edge_id"))
    return remove_edges(g, gone.distinct())


def rollback(g: Graph, provenance: DataFrame) -> Graph:
    """g without the edges that have a provenance."""
    return remove_edges(g, provenance.select("edge_id").distinct())


def link_impact(g: Graph, source: str, target: str) -> DataFrame:
    """One row: what an edge from source to target would do: merges (two components), closes (a directed cycle), and how many nodes the smaller component has."""
    from weft.operators.lookup import breadth_first
    from weft.operators.paths import component_of

    one = lambda n: g.nodes.where(F.col("id") == n)
    near = checkpoint(component_of(g, source))
    apart = near.where(F.col("id") == target).isEmpty()
    back = not breadth_first(g, one(target), 1 << 30, True).where(F.col("id") == source).isEmpty()
    size = min(near.count(), component_of(g, target).count()) if apart else 0
    return g.nodes.limit(1).select(F.lit(apart).alias("merges"), F.lit(back).alias("closes"), F.lit(size).cast("bigint").alias("gained"))
