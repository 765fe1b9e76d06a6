"""Matchings, covers, independent sets, colourings, cliques, cycles and tests of structure.

What a sequential fold over an order would give, rounds of local decisions give as well: in each, all nodes (or pairs) that
come first among those around them are decided at once, which changes nothing for the others. The rounds are as many as the
longest chain of neighbours in ascending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import chance
from weft.operators.paths import components, connected_components, levels
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, fixpoint


def matching(g: Graph, sides: str | None = None) -> DataFrame:
    """u < v, w: the greedy matching by descending sum of the weights of common edges; ties go by u, then v.

    sides: only pairs whose nodes differ in this attribute (a bipartite matching).
    """
    pairs = g.cliq.groupBy("u", "v").agg(F.round(F.sum("weight"), 9).alias("w"))
    if sides:
        value = g.nodes.select("id", F.col("data")[sides].alias("x"))
        pairs = pairs.join(value.select(F.col("id").alias("u"), F.col("x").alias("xu")), "u").join(value.select(F.col("id").alias("v"), F.col("x").alias("xv")), "v").where("xu <> xv").select("u", "v", "w")
    left, out = checkpoint(pairs), None
    while not left.isEmpty():
        ends = left.select("u", "v", "w", F.explode(F.array("u", "v")).alias("end"))
        first = ends.groupBy("end").agg(F.min(F.struct((-F.col("w")).alias("w"), "u", "v")).alias("m"))
        now = checkpoint(first.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m.u", "m.v", (-F.col("m.w")).alias("w")))
        out = now if out is None else checkpoint(out.unionByName(now))
        taken = now.select(F.explode(F.array("u", "v")).alias("end"))
        left = checkpoint(left.join(taken.withColumnRenamed("end", "u"), "u", "left_anti").join(taken.withColumnRenamed("end", "v"), "v", "left_anti").select("u", "v", "w"))
    return left if out is None else out


def edge_cover(g: Graph) -> DataFrame:
    """u < v: the greedy matching, and for each node outside it the pair with its smallest neighbour; nodes without neighbours stay uncovered."""
    match = checkpoint(matching(g).select("u", "v"))
    rest = g.adj.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("other")).join(match.select(F.explode(F.array("u", "v")).alias("id")), "id", "left_anti")
    return match.unionByName(rest.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct())


def vertex_cover(g: Graph) -> DataFrame:
    """id: both ends of the greedy matching, at most twice as many nodes as the smallest cover has."""
    return matching(g).select(F.explode(F.array("u", "v")).alias("id"))


def independent_set(g: Graph, seed: int = 0) -> DataFrame:
    """id of a maximal independent set: greedy in the order of a seeded hash. In random order the rounds grow with log n."""
    adj = checkpoint(g.adj.select(F.col("u").alias("id"), F.col("v").alias("other")))
    left, out = checkpoint(g.nodes.select("id", chance(seed, "id").alias("p"))), None
    while not left.isEmpty():
        key = lambda i: left.select(F.col("id").alias(i), F.struct("p", "id").alias(f"k{i}"))
        beaten = adj.join(key("id"), "id").join(key("other"), "other").where("kother < kid").select("id").distinct()
        now = checkpoint(left.join(beaten, "id", "left_anti").select("id"))
        out = now if out is None else checkpoint(out.unionByName(now))
        near = adj.join(now.withColumnRenamed("id", "other"), "other", "left_semi").select("id").unionByName(now).distinct()
        left = checkpoint(left.join(near, "id", "left_anti"))
    return g.nodes.select("id") if out is None else out


def undominated(g: Graph, chosen: DataFrame) -> DataFrame:
    """id of the nodes that are neither in chosen.id nor next to one of it: none if chosen dominates the graph."""
    near = g.adj.join(chosen.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"))
    return g.nodes.select("id").join(near.unionByName(chosen.select("id")).distinct(), "id", "left_anti")


def coloring(g: Graph) -> DataFrame:
    """id, color: greedy, from the node with the most neighbours down, ties by id; each takes the least colour that none before it has.

    A node waits for its neighbours before it. The colours that it sees are a set of at most as many as there are colours.
    """
    k = g.neighbor_degree
    key = lambda i: k.select(F.col("id").alias(i), F.struct((-F.col("k")).alias("k"), F.col("id").alias("i")).alias(f"k{i}"))
    before = checkpoint(g.adj.select(F.col("u").alias("id"), F.col("v").alias("other")).join(key("id"), "id").join(key("other"), "other").where("kother < kid").select("id", "other"))
    left, done = checkpoint(g.nodes.select("id")), None
    while not left.isEmpty():
        wait = before.join(left.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        now = left.join(wait, "id", "left_anti")
        if done is None:
            new = now.select("id", F.lit(0).cast("bigint").alias("color"))
        else:
            seen = before.join(now, "id", "left_semi").join(done.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.collect_set("color").alias("seen"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size("seen").cast("bigint")), "seen"))
            new = now.join(seen, "id", "left").select("id", F.coalesce(free, F.lit(0).cast("bigint")).alias("color"))
        new = checkpoint(new)
        done = new if done is None else checkpoint(done.unionByName(new))
        left = checkpoint(left.join(new.select("id"), "id", "left_anti"))
    return g.nodes.select("id", F.lit(0).cast("bigint").alias("color")) if done is None else done


def maximal_cliques(g: Graph) -> DataFrame:
    """clique: sorted ids of each maximal clique; a node without neighbours is one of its own.

    A clique grows by larger ids only, so each set is met once; it carries its common neighbours, and is maximal when none is
    left. A row holds at most the neighbours of one node.
    """
    near = g.adj.groupBy(F.col("u").alias("x")).agg(F.array_sort(F.collect_set("v")).alias("near"))
    near = checkpoint(g.nodes.select(F.col("id").alias("x")).join(near, "x", "left").select("x", F.coalesce("near", F.array().cast("array<string>")).alias("near")))
    state, out = near.select(F.array("x").alias("clique"), F.col("near").alias("common")), None
    while not state.isEmpty():
        full = state.where(F.size("common") == 0).select("clique")
        out = full if out is None else checkpoint(out.unionByName(full))
        grown = state.select("clique", "common", F.explode(F.filter("common", lambda x: x > F.element_at("clique", -1))).alias("x")).join(near, "x")
        state = checkpoint(grown.select(F.concat("clique", F.array("x")).alias("clique"), F.array_intersect("common", "near").alias("common")))
    return near.select(F.array("x").alias("clique")) if out is None else out


def unchordal(g: Graph) -> DataFrame:
    """id of what is left when nodes whose neighbours are all linked go, again and again: none if the graph is chordal."""
    left, links = checkpoint(g.nodes.select("id")), checkpoint(g.links.select("u", "v"))
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        k = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
        wedge = both.select(F.col("u").alias("id"), F.col("v").alias("a")).join(both.select(F.col("u").alias("id"), F.col("v").alias("b")), "id").where("a < b")
        closed = wedge.join(links.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_semi").groupBy("id").agg(F.count("*").alias("n"))
        go = checkpoint(left.join(k, "id", "left").join(closed, "id", "left").where("coalesce(n, 0) * 2 = coalesce(k, 0) * (coalesce(k, 0) - 1)").select("id"))
        if go.isEmpty():
            return left
        left = checkpoint(left.join(go, "id", "left_anti"))
        links = checkpoint(links.join(go.withColumnRenamed("id", "u"), "u", "left_anti").join(go.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"))


def tests(g: Graph) -> DataFrame:
    """One row: components, connected, tree, forest (of neighbouring pairs), eulerian and eulerian_path (by even numbers of neighbours), loops, dag.

    A graph without nodes is connected and a forest by no test: all are false but dag.
    """
    comp = checkpoint(connected_components(g))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    links = g.links.join(comp.withColumnRenamed("id", "u"), "u").groupBy("component").agg(F.count("*").alias("m"))
    per = sizes.join(links, "component", "left").agg(F.count("*").alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.bool_and(F.coalesce("m", F.lit(0)) == F.col("n") - 1), F.lit(False)).alias("forest"))
    odd = g.neighbor_degree.agg(F.coalesce(F.sum((F.col("k") % 2).cast("bigint")), F.lit(0)).alias("odd"))
    loops = g.edges.agg(F.coalesce(F.bool_or(F.arrays_overlap("source_ids", "target_ids")), F.lit(False)).alias("loops"))
    level = levels(g).agg(F.count("*").alias("levelled"))
    one = F.col("components") == 1
    # three tables of one row each
    rows = per.join(F.broadcast(odd)).join(F.broadcast(loops)).join(F.broadcast(level))
    return rows.select("components", one.alias("connected"), (one & F.col("forest")).alias("tree"), "forest", (one & (F.col("odd") == 0)).alias("eulerian"), (one & F.col("odd").isin(0, 2)).alias("eulerian_path"), "loops", (F.col("levelled") == F.col("n")).alias("dag"))


def longest_paths(g: Graph) -> DataFrame:
    """id, level, previous: for nodes of a graph without cycles the longest path that ends there, in arcs, and the smallest id before it on such a path."""
    at = checkpoint(levels(g))
    back = g.arcs.join(at.select(F.col("id").alias("src"), F.col("level").alias("l")), "src").join(at.withColumnRenamed("id", "tgt"), "tgt").where("l = level - 1").groupBy(F.col("tgt").alias("id")).agg(F.min("src").alias("previous"))
    return at.join(back, "id", "left")


def tree_center(g: Graph) -> DataFrame:
    """id of the one or two nodes that are left of a tree when its leaves go, again and again; none if cycles are left."""
    left, links = checkpoint(g.nodes.select("id")), checkpoint(g.links.select("u", "v"))
    while left.limit(3).count() > 2:
        both = links.select(F.explode(F.array("u", "v")).alias("id"))
        leaves = checkpoint(left.join(both.groupBy("id").agg(F.count("*").alias("k")), "id", "left").where("coalesce(k, 0) <= 1").select("id"))
        if leaves.isEmpty():
            return left.limit(0)
        left = checkpoint(left.join(leaves, "id", "left_anti"))
        links = checkpoint(links.join(leaves.withColumnRenamed("id", "u"), "u", "left_anti").join(leaves.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"))
    return left


def motifs(g: Graph) -> DataFrame:
    """motif, n: how many sets of three nodes have no, one, two or three linked pairs; motifs that don't occur are missing."""
    deg = g.neighbor_degree.agg(F.count("*").cast("decimal(38,0)").alias("n"), F.sum("k").cast("decimal(38,0)").alias("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("decimal(38,0)").alias("w"))
    from weft.operators.degrees import triangles

    tri = triangles(g).agg((F.sum("triangles") / 3).cast("decimal(38,0)").alias("t"))
    row = deg.join(F.broadcast(tri)).select(F.col("t").alias("three"), (F.col("w") - 3 * F.col("t")).alias("two"), (F.col("k") / 2 * (F.col("n") - 2) - 2 * (F.col("w") - 3 * F.col("t")) - 3 * F.col("t")).alias("one"), (F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6).alias("all"))
    row = row.withColumn("none", F.col("all") - F.col("one") - F.col("two") - F.col("three"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), F.col(m).cast("bigint").alias("n")) for m in ("none", "one", "two", "three")])).alias("x")).select("x.motif", "x.n").where("n > 0")


def modularity(g: Graph, of: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, q: links inside communities of.community (by of.id) over all, less what their degrees would give by chance. Links weigh the edges shared; null without links."""
    side = lambda c: of.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    rows = g.adj.join(side("u"), "u").join(side("v"), "v")
    per = rows.groupBy(F.col("cu").alias("c")).agg(F.sum("shared").alias("d"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("shared")).otherwise(0)).alias("inside"))
    sums = per.agg(F.sum("d").cast("double").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("d").cast("double") * F.col("d")).alias("sq"))
    return sums.select((F.col("inside") / F.col("m2") - resolution * F.col("sq") / (F.col("m2") * F.col("m2"))).alias("q"))


def simrank(g: Graph, rounds: int = 3, factor: float = 0.9) -> DataFrame:
    """u < v, score above 0: SimRank over neighbours after as many rounds. A round joins twice with the links, once for each side."""
    adj = checkpoint(g.adj.select("u", "v"))
    k = g.neighbor_degree
    deg = checkpoint(k.where("k > 0"))
    own = checkpoint(g.nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("s")))
    now = own
    for _ in range(rounds):
        half = now.join(adj.select(F.col("v").alias("a"), F.col("u").alias("x")), F.col("u") == F.col("a")).groupBy("x", "v").agg(F.sum("s").alias("s"))
        full = half.join(adj.select(F.col("v").alias("b"), F.col("u").alias("y")), F.col("v") == F.col("b")).where("x <> y").groupBy(F.col("x").alias("u"), F.col("y").alias("v")).agg(F.sum("s").alias("s"))
        full = full.join(deg.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(deg.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
        now = checkpoint(own.unionByName(full.select("u", "v", (factor * F.col("s") / (F.col("ku") * F.col("kv"))).alias("s"))))
    return now.where("u < v").select("u", "v", F.col("s").alias("score"))


def community_links(g: Graph, attribute: str, alpha: float = 0.8, delta: float = 0.001) -> DataFrame:
    """u < v, common, cn_community, ra_community, within_inter, centrality of unlinked pairs with common neighbours.

    cn_community adds the common neighbours of the pair's own community (the attribute; both of one) to common; ra_community
    sums 1 / degree over those; within_inter divides them by the other ones plus delta; centrality is alpha * common +
    (1 - alpha) * n / 2, since such a pair lies two hops apart.
    """
    value = checkpoint(g.neighbor_degree.join(g.nodes.select("id", F.col("data")[attribute].alias("c")), "id"))
    via = g.adj.select("u", F.col("v").alias("w"))
    mid = value.select(F.col("id").alias("w"), F.col("k").alias("kw"), F.col("c").alias("cw"))
    rows = via.join(mid, "w").join(via.select(F.col("u").alias("v"), "w"), "w").where("u < v").join(g.links.select("u", "v"), ["u", "v"], "left_anti")
    rows = rows.join(value.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(value.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    same = F.col("cu") == F.col("cv")
    inside = same & (F.col("cw") == F.col("cu"))
    own = F.sum(F.when(inside, 1).otherwise(0))
    found = rows.groupBy("u", "v").agg(F.count("*").alias("common"), own.alias("own"), F.sum(F.when(inside, 1 / F.col("kw")).otherwise(0.0)).alias("ra_community"), F.max(same).alias("same"))
    total = g.nodes.agg(F.count("*").alias("n"))
    wic = F.when(F.col("same"), F.col("own") / (F.col("common") - F.col("own") + delta)).otherwise(0.0)
    return found.join(F.broadcast(total)).select("u", "v", "common", (F.col("common") + F.col("own")).alias("cn_community"), "ra_community", wic.alias("within_inter"), (alpha * F.col("common") + (1 - alpha) * F.col("n") / 2).alias("centrality"))


def s_distances(g: Graph, edge: str, s: int = 1) -> DataFrame:
    """edge_id, d: steps from one edge over pairs of edges that share s members or more; itself 0, what isn't reached is missing."""
    from weft.operators.paths import overlaps

    pairs = overlaps(g, s).select("e1", "e2")
    both = checkpoint(pairs.unionByName(pairs.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"))))
    start = g.edges.where(F.col("edge_id") == edge).select("edge_id", F.lit(0).cast("bigint").alias("d"))
    return fixpoint(start, lambda new: new.join(both, F.col("edge_id") == F.col("e1")).select(F.col("e2").alias("edge_id"), (F.col("d") + 1).alias("d")), ["edge_id"])


def simplices(g: Graph) -> DataFrame:
    """ids, dimension: every set of one member or more of an edge, sorted, and the nodes without edges. Exponential in the size of an edge; the levels go by one member less."""
    now = checkpoint(g.edges.select(F.array_sort(F.array_union("source_ids", "target_ids")).alias("ids")).unionByName(g.nodes.select(F.array("id").alias("ids"))).distinct())
    faces = lambda new: new.where(F.size("ids") > 1).select("ids", F.explode("ids").alias("x")).select(F.array_remove("ids", F.col("x")).alias("ids"))
    return fixpoint(now, faces, ["ids"]).select("ids", (F.size("ids") - 1).cast("bigint").alias("dimension"))


def bridges(g: Graph) -> DataFrame:
    """u < v: links without which their ends aren't connected.

    A spanning forest holds all bridges. Each link outside it covers the tree path between its ends, so a tree link is a bridge
    if no path covers it: each link outside gets a number, both its ends carry it, and a tree link whose subtree's
    numbers cancel out (xor of 62 hashed bits, twice, so 124 bits have to agree by chance for a wrong answer) is not covered.
    """
    comp = checkpoint(connected_components(g))
    adj = checkpoint(g.adj.select("u", "v"))
    roots = comp.where("id = component").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("d"))
    grow = lambda new: new.join(adj, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent"), (F.min("d") + 1).alias("d"))
    tree = checkpoint(fixpoint(roots, grow, ["id"]))
    parent = tree.where("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    rest = g.links.select("u", "v").join(parent, ["u", "v"], "left_anti")
    mark = rest.select(F.explode(F.array("u", "v")).alias("id"), F.xxhash64("u", "v").alias("a"), F.xxhash64("v", "u", F.lit(1)).alias("b"))
    own = mark.groupBy("id").agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"))
    state = checkpoint(tree.join(own, "id", "left").select("id", "parent", "d", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    depth = state.agg(F.max("d")).first()[0] or 0
    out, level = None, state.where(F.col("d") == depth)
    for d in range(depth, 0, -1):
        found = level.where("a = 0 and b = 0").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
        out = found if out is None else out.unionByName(found)
        up = level.groupBy(F.col("parent").alias("id")).agg(F.expr("bit_xor(a)").alias("xa"), F.expr("bit_xor(b)").alias("xb"))
        above = state.where(F.col("d") == d - 1).join(up, "id", "left")
        level = checkpoint(above.select("id", "parent", "d", F.col("a").bitwiseXOR(F.coalesce("xa", F.lit(0))).alias("a"), F.col("b").bitwiseXOR(F.coalesce("xb", F.lit(0))).alias("b")))
    return parent.limit(0) if out is None else out


def two_edge_components(g: Graph) -> DataFrame:
    """id, component: the smallest id that is still connected when all bridges are gone."""
    return components(g.links.select("u", "v").join(bridges(g), ["u", "v"], "left_anti"), g.nodes)


def voterank(g: Graph, n: int) -> DataFrame:
    """rank, id: in each of n rounds the node to which its neighbours' votes add up most, ties by id, is elected and votes no more; its neighbours' votes fall by 1 / mean number of neighbours, to 0 at least. Ends early when no votes are left."""
    adj = checkpoint(g.adj.select("u", "v"))
    mean = g.neighbor_degree.agg(F.avg("k")).first()[0] or 1.0
    now, out = checkpoint(g.nodes.select("id", F.lit(1.0).alias("vote"), F.lit(None).cast("bigint").alias("rank"))), None
    for k in range(1, n + 1):
        got = adj.join(now.where("vote > 0").withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.round(F.sum("vote"), 9).alias("score"))
        top = got.join(now.where("rank is null").select("id"), "id", "left_semi").where("score > 0").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).first()[0]
        if top is None:
            break
        near = adj.where(F.col("u") == top.id).select(F.col("v").alias("id"), F.lit(True).alias("near"))
        less = F.when(F.col("near"), F.greatest(F.col("vote") - 1 / mean, F.lit(0.0))).otherwise(F.col("vote"))
        mine = F.col("id") == top.id
        now = checkpoint(now.join(near, "id", "left").select("id", F.when(mine, 0.0).otherwise(less).alias("vote"), F.when(mine, F.lit(k).cast("bigint")).otherwise(F.col("rank")).alias("rank")))
    return now.where("rank is not null").select("rank", "id")


def square_clustering(g: Graph) -> DataFrame:
    """id, value: the share of possible squares around each node that there are; 0 with fewer than two neighbours.

    For each two neighbours: their common neighbours but the node are squares; possible are those and the neighbours that each has for itself,
    without the node and each other.
    """
    adj = checkpoint(g.adj.select("u", "v"))
    k = checkpoint(g.neighbor_degree)
    side = lambda c: adj.select(F.col("u").alias("id"), F.col("v").alias(c))
    pairs = side("a").join(side("b"), "id").where("a < b")
    common = pairs.groupBy("a", "b").agg((F.count("*") - 1).alias("squares"))
    linked = adj.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("theta")).where("a < b")
    degree = lambda c: k.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"))
    both = common.join(linked, ["a", "b"], "left").join(degree("a"), "a").join(degree("b"), "b").withColumn("theta", F.coalesce("theta", F.lit(0)))
    own = 1 + F.col("squares") + F.col("theta")
    both = both.withColumn("possible", F.col("ka") - own + F.col("kb") - own + F.col("squares"))
    sums = pairs.join(both, ["a", "b"]).groupBy("id").agg(F.sum("squares").alias("s"), F.sum("possible").alias("p"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0).alias("value"))


def chordless_cycles(g: Graph, most: int = 5) -> DataFrame:
    """path, hops: the directed cycles of up to ``most`` nodes with no arc, in either direction, between two that don't follow each other. Those of three or fewer always count."""
    from weft.operators.inference import cycles

    found = checkpoint(cycles(g, most).withColumn("key", F.array_join("path", ",")))
    at = found.where("hops > 3").select("key", "hops", F.posexplode("path").alias("i", "x"))
    two = at.alias("p").join(at.alias("q"), "key").where("p.i + 1 < q.i and not (p.i = 0 and q.i = p.hops - 1)").select("key", F.col("p.x").alias("x"), F.col("q.x").alias("y"))
    arcs = g.arcs.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    chords = two.join(arcs, (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")), "left_semi").select("key").distinct()
    return found.join(chords, "key", "left_anti").select("path", "hops")


def chromatic_number(g: Graph) -> DataFrame:
    """One row, colors: how many the greedy colouring takes, an upper bound."""
    return coloring(g).agg(F.countDistinct("color").alias("colors"))


def dominating_set(g: Graph, seed: int = 0) -> DataFrame:
    """id of a set such that each node is in it or next to one in it: a maximal independent set, as any such set dominates."""
    return independent_set(g, seed)


def largest_clique(g: Graph) -> DataFrame:
    """clique: the members (sorted) of the clique with the most, ties by the first in order."""
    return maximal_cliques(g).select(F.array_join(F.array_sort("clique"), ",").alias("clique"), F.size("clique").alias("n")).orderBy(F.desc("n"), "clique").limit(1).select("clique")


def signature(g: Graph) -> DataFrame:
    """k, triangles, n: how many nodes have so many neighbours and triangles. Graphs with different ones are not isomorphic."""
    from weft.operators.degrees import triangles

    return triangles(g).groupBy("k", "triangles").agg(F.count("*").alias("n"))


def could_be_isomorphic(g: Graph, other: Graph) -> DataFrame:
    """One row, possible: whether the signatures of both graphs are the same."""
    both = signature(g).select("k", "triangles", F.col("n").alias("a")).join(signature(other).select("k", "triangles", F.col("n").alias("b")), ["k", "triangles"], "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))), F.lit(True)).alias("possible"))


def directed_motifs(g: Graph) -> DataFrame:
    """motif, n: how many connected sets of three nodes have which arcs among them. A motif is named by the sorted (out, in) arcs of its three nodes.

    The sets are found over pairs of neighbours; their arcs by three lookups.
    """
    arcs = checkpoint(g.arcs)
    near = arcs.unionByName(arcs.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    side = lambda c: near.select(F.col("src").alias("m"), F.col("tgt").alias(c))
    sets = side("a").join(side("b"), "m").where("a < b").select(F.array_sort(F.array("m", "a", "b")).alias("ids")).distinct()
    pairs = sets.select("ids", F.explode(F.expr("array(struct(0 as i, 1 as j), struct(1 as i, 0 as j), struct(0 as i, 2 as j), struct(2 as i, 0 as j), struct(1 as i, 2 as j), struct(2 as i, 1 as j))")).alias("x"))
    hit = pairs.select("ids", "x.i", "x.j", F.get("ids", F.col("x.i")).alias("src"), F.get("ids", F.col("x.j")).alias("tgt")).join(arcs, ["src", "tgt"], "left_semi")
    degree = lambda k: F.concat_ws("/", F.count_if(F.col("i") == k).cast("string"), F.count_if(F.col("j") == k).cast("string"))
    named = hit.groupBy("ids").agg(F.array_join(F.array_sort(F.array(*[degree(k) for k in range(3)])), " ").alias("motif"))
    return named.groupBy("motif").agg(F.count("*").alias("n"))
