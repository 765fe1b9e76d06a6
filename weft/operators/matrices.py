"""Matrices as tables of their entries that aren't zero, and transforms of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, rounds


def incidence(g: Graph) -> DataFrame:
    """edge_id, id, value: 1 for a source, -1 for a target; a node that is both counts as a target."""
    return g.incidence.groupBy("edge_id", F.col("node_id").alias("id")).agg(F.min(F.when(F.col("role") == "source", 1).otherwise(-1)).cast("bigint").alias("value"))


def adjacency(g: Graph) -> DataFrame:
    """i, j, value: the number of edges that two nodes share."""
    return g.adj.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("shared").alias("value"))


def _flow(g: Graph) -> DataFrame:
    """i, j, w: weight / (sources + targets) summed over the edges of both; a node with itself as well."""
    side = lambda c: g.members.select("edge_id", F.col("node_id").alias(c))
    sizes = g.edges.select("edge_id", (F.col("weight") / (F.size("source_ids") + F.size("target_ids"))).alias("w"))
    return side("i").join(side("j"), "edge_id").join(sizes, "edge_id").groupBy("i", "j").agg(F.sum("w").alias("w"))


def laplacian(g: Graph) -> DataFrame:
    """i, j, value of D - H W De^-1 H': the weights of a node's edges on the diagonal, less the flow."""
    own = g.members.groupBy(F.col("node_id").alias("i")).agg(F.sum("weight").alias("d"))
    return _flow(g).join(own, "i").select("i", "j", (F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0) - F.col("w")).alias("value"))


def transition(g: Graph) -> DataFrame:
    """i, j, value: the flow, divided by each row's sum."""
    flow = _flow(g)
    return flow.join(flow.groupBy("i").agg(F.sum("w").alias("total")), "i").select("i", "j", (F.col("w") / F.col("total")).alias("value"))


def walk_density(g: Graph, start: DataFrame, steps: int = 5) -> DataFrame:
    """id, rho: start's (id, rho) moved on by the transition matrix."""
    p = checkpoint(transition(g))
    return rounds(start, lambda now: now.join(p, F.col("id") == F.col("i")).groupBy(F.col("j").alias("id")).agg(F.sum(F.col("rho") * F.col("value")).alias("rho")), steps)


def dual_walk(g: Graph) -> DataFrame:
    """e1, e2, value: the members that two different edges share, in both directions."""
    a, b = (g.members.select("node_id", F.col("edge_id").alias(e)) for e in ("e1", "e2"))
    return a.join(b, "node_id").where("e1 <> e2").groupBy("e1", "e2").agg(F.count("*").alias("value"))


def bethe_hessian(g: Graph, r: float) -> DataFrame:
    """i, j, value of (r - 1) I - r A + D, with D the row sums of A."""
    a = adjacency(g)
    found = g.nodes.select(F.col("id").alias("i")).join(a.groupBy("i").agg(F.sum("value").alias("d")), "i", "left")
    own = found.select("i", F.col("i").alias("j"), (r - 1 + F.coalesce("d", F.lit(0))).alias("value"))
    return own.unionByName(a.select("i", "j", (-r * F.col("value")).alias("value")))


def tensor(g: Graph) -> DataFrame:
    """members (sorted, comma-joined), order, weight: the weights of edges with the same members."""
    ids = F.array_sort(F.array_union("source_ids", "target_ids"))
    return g.edges.groupBy(F.array_join(ids, ",").alias("members"), F.size(ids).cast("bigint").alias("order")).agg(F.sum("weight").alias("weight"))


def encapsulation(g: Graph) -> DataFrame:
    """child, parent: edges all of whose members are among those of an edge with more.

    A child only meets the edges that have the member of it that is in the fewest edges, and of these only those whose 64 bits, set by hashes of
    the members, include the child's. What is left is compared member by member.
    """
    ids = F.array_union("source_ids", "target_ids")
    bits = F.aggregate(ids, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    sets = g.edges.select("edge_id", ids.alias("ids"), F.size(ids).alias("n"), bits.alias("bits"))
    rare = F.min(F.struct("df", "node_id", "n", "bits")).alias("m")
    members = sets.select("edge_id", F.explode("ids").alias("node_id"), "n", "bits")
    df = members.groupBy("node_id").agg(F.count("*").alias("df"))
    child = members.join(df, "node_id").groupBy(F.col("edge_id").alias("child")).agg(rare).select("child", "m.node_id", F.col("m.n").alias("cn"), F.col("m.bits").alias("cb"))
    parent = members.select(F.col("edge_id").alias("parent"), "node_id", "n", "bits")
    pairs = checkpoint(child.join(parent, "node_id").where((F.col("cn") < F.col("n")) & (F.col("cb").bitwiseAND(F.col("bits")) == F.col("cb"))).select("child", "parent"))
    own = lambda c: sets.select(F.col("edge_id").alias(c), F.col("ids").alias(f"i{c}")).join(pairs.select(c).distinct(), c, "left_semi")
    return pairs.join(own("child"), "child").join(own("parent"), "parent").where(F.size(F.array_except("ichild", "iparent")) == 0).select("child", "parent")


def boundary(g: Graph) -> DataFrame:
    """simplex, face, sign: the faces of each edge's members, without the k-th one, signed by (-1)^k."""
    ids = F.array_sort(F.array_union("source_ids", "target_ids"))
    rows = g.edges.select(ids.alias("ids")).distinct().where(F.size("ids") > 1).select("ids", F.posexplode("ids").alias("k", "x"))
    return rows.select(F.array_join("ids", ",").alias("simplex"), F.array_join(F.array_remove("ids", F.col("x")), ",").alias("face"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).cast("bigint").alias("sign"))


def dual(g: Graph) -> DataFrame:
    """id, edges: each node that has edges as an edge over them (sorted, comma-joined)."""
    return g.members.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("edge_id")), ",").alias("edges"))


def line_graph(g: Graph, directed: bool = False) -> DataFrame:
    """e1, e2: edges with a common member (e1 < e2), or, directed, with a target of the first among the sources of the second."""
    if not directed:
        return dual_walk(g).where("e1 < e2").select("e1", "e2")
    out, into = (g.incidence.where(F.col("role") == role).select("node_id", F.col("edge_id").alias(e)) for role, e in (("target", "e1"), ("source", "e2")))
    return out.join(into, "node_id").where("e1 <> e2").select("e1", "e2").distinct()


def digraph(g: Graph) -> DataFrame:
    """src, tgt, edge_id, weight: of parallel pairs the one with the last edge id."""
    last = g.pairs.groupBy("src", "tgt").agg(F.max(F.struct("edge_id", "weight")).alias("m"))
    return last.select("src", "tgt", "m.edge_id", "m.weight")


def projection(g: Graph, onto: str = "source") -> DataFrame:
    """u < v, shared, jaccard: over the nodes of one role, by the nodes of the other role that both are paired with."""
    a, b = ("src", "tgt") if onto == "source" else ("tgt", "src")
    rows = g.pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    size = rows.groupBy("x").agg(F.count("*").alias("n"))
    side = lambda c: rows.select(F.col("x").alias(c), "y")
    shared = side("u").join(side("v"), "y").where("u < v").groupBy("u", "v").agg(F.count("*").alias("shared"))
    n = lambda c: size.select(F.col("x").alias(c), F.col("n").alias(f"n{c}"))
    return shared.join(n("u"), "u").join(n("v"), "v").select("u", "v", "shared", (F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))).alias("jaccard"))


def hyperedge_similarity(g: Graph, edge: str) -> DataFrame:
    """edge_id, shared, jaccard, dice, overlap of all edges that share a member with the given one."""
    own = g.members.where(F.col("edge_id") == edge).select("node_id", F.col("size").alias("n"))
    rows = g.members.where(F.col("edge_id") != edge).join(own, "node_id").groupBy("edge_id").agg(F.count("*").alias("shared"), F.max("size").alias("m"), F.max("n").alias("n"))
    s = F.col("shared")
    return rows.select("edge_id", "shared", (s / (F.col("m") + F.col("n") - s)).alias("jaccard"), (2 * s / (F.col("m") + F.col("n"))).alias("dice"), (s / F.least("m", "n")).alias("overlap"))


def link_prediction(g: Graph) -> DataFrame:
    """u < v, common, jaccard, adamic_adar, resource_allocation, preferential of pairs that have neighbours in common and aren't neighbours."""
    k = checkpoint(g.neighbor_degree)
    via = g.adj.select("u", F.col("v").alias("w"))
    deg = k.select(F.col("id").alias("w"), F.col("k").alias("kw"))
    rows = via.join(deg, "w").alias("p").join(via.select(F.col("u").alias("v"), "w"), "w").where("u < v")
    log_k = F.log(F.col("kw").cast("double"))
    found = rows.groupBy("u", "v").agg(F.count("*").alias("common"), F.sum(F.when(F.col("kw") > 1, 1 / log_k)).alias("adamic_adar"), F.sum(1 / F.col("kw")).alias("resource_allocation"))
    found = found.join(g.links.select("u", "v"), ["u", "v"], "left_anti").join(k.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    return found.select("u", "v", "common", (F.col("common") / (F.col("ku") + F.col("kv") - F.col("common"))).alias("jaccard"), "adamic_adar", "resource_allocation", (F.col("ku") * F.col("kv")).alias("preferential"))


def unsigned_incidence(g: Graph, order: int | None = None) -> DataFrame:
    """edge_id, id, value: 1 for each member of each edge, or of the edges of order + 1 members."""
    rows = g.members if order is None else g.members.where(F.col("size") == order + 1)
    return rows.select("edge_id", F.col("node_id").alias("id"), F.lit(1).cast("bigint").alias("value"))


def normalized_laplacian(g: Graph) -> DataFrame:
    """i, j, value: the Laplacian's entries over the root of the product of both diagonals."""
    own = g.members.groupBy("node_id").agg(F.sum("weight").alias("d")).where("d > 0")
    side = lambda c: own.select(F.col("node_id").alias(c), F.col("d").alias(f"d{c}"))
    return laplacian(g).join(side("i"), "i").join(side("j"), "j").select("i", "j", (F.col("value") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))


def multiorder_laplacian(g: Graph, sigmas: dict[int, float]) -> DataFrame:
    """i, j, value: the sum over the orders of sigma times (D - H H'), H the unsigned incidence of the edges of that order and D its row sums on the diagonal.

    The diagonals cancel, so what is left is minus sigma for each edge that two nodes share.
    """
    sigma = F.create_map(*[F.lit(x) for k, v in sigmas.items() for x in (k + 1, float(v))])
    rows = g.members.where(F.col("size").isin([k + 1 for k in sigmas])).select("edge_id", "node_id", sigma[F.col("size")].alias("s"))
    side = lambda c: rows.select("edge_id", F.col("node_id").alias(c))
    pairs = side("i").join(rows.select("edge_id", F.col("node_id").alias("j"), "s"), "edge_id").where("i <> j")
    return pairs.groupBy("i", "j").agg((-F.sum("s")).alias("value"))


def stationary(g: Graph) -> DataFrame:
    """id, p: where the random walk of the transition matrix stays: as its flow is symmetric, each node's row sum over that of all. 0 for nodes without edges."""
    sizes = g.edges.select("edge_id", (F.col("weight") * F.size(F.array_union("source_ids", "target_ids")) / (F.size("source_ids") + F.size("target_ids"))).alias("w"))
    own = g.members.select("edge_id", F.col("node_id").alias("id")).join(sizes, "edge_id").groupBy("id").agg(F.sum("w").alias("w"))
    rows = g.nodes.select("id").join(own, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("w"))
    return rows.withColumn("all", rows.agg(F.sum("w")).scalar()).select("id", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0).alias("p"))


def bipartite(g: Graph) -> DataFrame:
    """u, v, kind: the graph of nodes and edges, a pair for each member; kind is the role."""
    return g.incidence.select(F.col("node_id").alias("u"), F.col("edge_id").alias("v"), F.col("role").alias("kind"))


def as_line_graph(g: Graph, s: int = 1) -> Graph:
    """The graph whose nodes are the edges, with an edge each way between those that share s members or more."""
    from weft.operators.paths import overlaps

    pairs = overlaps(g, s)
    both = pairs.select(F.col("e1").alias("a"), F.col("e2").alias("b"), "shared").unionByName(pairs.select(F.col("e2").alias("a"), F.col("e1").alias("b"), "shared"))
    edges = both.select(F.concat_ws(">", "a", "b").alias("edge_id"), F.array("a").alias("source_ids"), F.array("b").alias("target_ids"), F.lit("overlap").alias("label"), F.col("shared").cast("double").alias("weight"))
    nodes = g.edges.select(F.col("edge_id").alias("id"), "label", F.create_map().cast("map<string,string>").alias("data"), "weight")
    return Graph(nodes, checkpoint(edges))


def boundaries_of(simplices: DataFrame) -> DataFrame:
    """simplex, face, sign, dimension: the faces of all simplices(ids, dimension) of dimension 1 or more, as sorted ids; the k-th left out has sign (-1)^k."""
    rows = simplices.where(F.size("ids") > 1).select("ids", "dimension", F.posexplode("ids").alias("k", "x"))
    return rows.select(F.array_join("ids", ",").alias("simplex"), F.array_join(F.array_remove("ids", F.col("x")), ",").alias("face"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).cast("bigint").alias("sign"), "dimension")


def hodge_laplacian(simplices: DataFrame, k: int) -> DataFrame:
    """i, j, value: the entries that aren't 0 of B(k)' B(k) + B(k + 1) B(k + 1)', B(k) the boundaries of the simplices of dimension k."""
    b = checkpoint(boundaries_of(simplices))
    down, up = b.where(F.col("dimension") == k), b.where(F.col("dimension") == k + 1)

    def product(rows: DataFrame, over: str, of: str) -> DataFrame:
        side = lambda c: rows.select(over, F.col(of).alias(c), F.col("sign").alias(f"s{c}"))
        return side("i").join(side("j"), over).select("i", "j", (F.col("si") * F.col("sj")).alias("value"))

    rows = product(down, "face", "simplex").unionByName(product(up, "simplex", "face"))
    return rows.groupBy("i", "j").agg(F.sum("value").alias("value")).where("value <> 0")


def faces_of(simplices: DataFrame, ids: list[str]) -> DataFrame:
    """ids (comma-joined), relation: the simplices that are faces (proper parts) or cofaces (with all of it and more) of the one of these ids."""
    own = F.array(*[F.lit(i) for i in sorted(ids)])
    inside, n = F.size(F.array_intersect("ids", own)), len(ids)
    face, coface = (inside == F.size("ids")) & (F.size("ids") < n), (inside == n) & (F.size("ids") > n)
    return simplices.select(F.array_join("ids", ",").alias("ids"), F.when(face, "face").when(coface, "coface").alias("relation")).where("relation is not null")


def simpliciality(g: Graph, least: int = 3) -> DataFrame:
    """One row, value: the share of edges of ``least`` members or more all of whose parts of one member less are edges themselves; 1 without such edges."""
    ids = g.edges.select(F.array_sort(F.array_union("source_ids", "target_ids")).alias("ids")).distinct()
    parts = ids.where(F.size("ids") >= least).select("ids", F.explode("ids").alias("x")).select("ids", F.array_remove("ids", F.col("x")).alias("part"))
    found = parts.join(ids.select(F.col("ids").alias("part"), F.lit(1).alias("there")), "part", "left").groupBy("ids").agg(F.bool_and(F.col("there").isNotNull()).alias("whole"))
    return found.agg(F.coalesce(F.avg(F.col("whole").cast("double")), F.lit(1.0)).alias("value"))


def walk_counts(g: Graph, terms: int = 16) -> DataFrame:
    """id, score: the sum over k up to ``terms`` of the closed walks of k steps over shared edges, each over k factorial: the diagonal of exp(A).

    All pairs that a walk connects are kept: a measure for graphs whose square fits.
    """
    a = checkpoint(adjacency(g))
    now = g.nodes.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("x"))
    total = now.select("id", F.col("x").alias("score"))
    for k in range(1, terms + 1):
        now = checkpoint(now.join(a, F.col("id") == F.col("i")).groupBy("s", F.col("j").alias("id")).agg((F.sum(F.col("x") * F.col("value")) / k).alias("x")))
        total = total.unionByName(now.where("s = id").select("id", F.col("x").alias("score")))
    return total.groupBy("id").agg(F.sum("score").alias("score"))
