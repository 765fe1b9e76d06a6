"""The registered queries on inference, patterns, states, flows and communities; they add to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import centrality, flows, inference
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import HOPS, add, add_table, forward, r
from weft.sources.graphs import read

OWN = "ow AS (SELECT src, tgt, least(max(weight), 1) AS w FROM pairs WHERE src <> tgt{} GROUP BY ALL)"
CHAIN = OWN.format(" AND label = 'inter'") + ", f0 AS (SELECT src, tgt, 0 AS depth, w AS score FROM ow)" + "".join(f", f{k} AS (SELECT * FROM f{k - 1} UNION ALL SELECT p.src, q.tgt, {k}, max(score * q.w * 0.9::DOUBLE) FROM f{k - 1} p JOIN ow q ON p.tgt = q.src WHERE p.src <> q.tgt AND p.depth = {k - 1} AND NOT EXISTS (SELECT 1 FROM f{k - 1} z WHERE z.src = p.src AND z.tgt = q.tgt) GROUP BY p.src, q.tgt)" for k in (1, 2, 3))
add("forward_chain", "lanes", lambda g: rounded(inference.forward_chain(g, "inter"), "score"), f"SELECT src, tgt, depth::BIGINT AS depth, {r('score')} AS score FROM f3 WHERE depth > 0", CHAIN)
add("derivations", "lanes", lambda g: inference.derivations(g, "N3"), "SELECT DISTINCT p.label, p.src AS a, p.tgt AS b FROM pairs p JOIN pairs q ON p.tgt = q.src AND p.label = q.label WHERE q.tgt = 'N3' AND q.src <> 'N3' AND p.src <> p.tgt AND p.src <> 'N3'")
add("abductions", "trade", lambda g: inference.abductions(g, "inter", "intra"), "SELECT DISTINCT tgt AS id FROM pairs WHERE label = 'inter' AND tgt NOT IN (SELECT tgt FROM pairs WHERE label = 'intra')")
BEST = OWN.format("") + ", c0 AS (SELECT min(src) AS id, 1::DOUBLE AS c FROM arcs)" + "".join(f", c{k} AS (SELECT id, max(c) AS c FROM (SELECT * FROM c{k - 1} UNION ALL SELECT tgt, c * w FROM c{k - 1} JOIN ow ON id = src) GROUP BY id)" for k in range(1, 6))
add("confidence_paths", "lanes", lambda g: rounded(inference.confidence_paths(Graph(g.nodes, g.edges.withColumn("weight", F.col("weight") / 2)), ends(g)[0], 5), "confidence").select("id", "confidence"), f"SELECT id, {r('c')} AS confidence FROM c5", BEST.replace("max(weight)", "max(weight / 2)"))
add("open_chains", "lanes", lambda g: inference.open_chains(forward(g), None, 2, 4).select(F.array_join("path", ",").alias("path"), "nodes"), "SELECT array_to_string(p, ',') AS path, len(p)::BIGINT AS nodes FROM oc WHERE len(p) BETWEEN 2 AND 4", "fw AS (SELECT * FROM arcs WHERE src < tgt), oc AS (SELECT DISTINCT [src] AS p, src AS e FROM fw WHERE src NOT IN (SELECT tgt FROM fw) UNION ALL SELECT list_append(p, tgt), tgt FROM oc JOIN fw ON e = src WHERE len(p) < 4)")
add("short_cycles", "lanes", lambda g: inference.cycles(g, 4).select(F.array_join("path", ",").alias("path"), "hops"), "SELECT array_to_string(p, ',') AS path, len(p)::BIGINT AS hops FROM cy JOIN arcs ON e = src AND tgt = p[1]", "cy AS (SELECT [src, tgt] AS p, tgt AS e FROM arcs WHERE src < tgt UNION ALL SELECT list_append(p, tgt), tgt FROM cy JOIN arcs ON e = src WHERE len(p) < 4 AND tgt > p[1] AND NOT list_contains(p, tgt))")
add("girth", "lanes", inference.girth, "SELECT coalesce(min(d + 1), 0) AS girth FROM h JOIN arcs ON source = tgt AND h.id = src", HOPS)
add("fan_out", "orders", inference.fan_out, "SELECT src AS id, label, count(DISTINCT tgt) AS targets FROM pairs GROUP BY ALL HAVING count(DISTINCT tgt) >= 3")
add("collapse_region", "trade", lambda g: inference.collapse(g, g.nodes.where(F.col("data")["region"] == "1").select("id"), "R1").edges.select("edge_id", F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets")), "SELECT edge_id, CASE WHEN a.region = '1' THEN 'R1' ELSE src END AS sources, CASE WHEN b.region = '1' THEN 'R1' ELSE tgt END AS targets FROM pairs JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE NOT (a.region = '1' AND b.region = '1')")
ENERGY = "hot AS (SELECT id, substr(id, 2)::INT / 25 AS e FROM nodes WHERE substr(id, 2)::INT / 25 >= 0.1)"
add("hebbian", "trade", lambda g: rounded(inference.hebbian(g, g.nodes.select("id", (F.substring("id", 2, 9).cast("int") / 25).alias("energy"))), "weight"), f"SELECT edge_id, {r('CASE WHEN s <> c AND p.e IS NOT NULL AND q.e IS NOT NULL THEN least(weight * 1.2 + 0.1 * least(p.e, q.e), 100) ELSE greatest(weight - 0.01, least(weight, 0.01)) END')} AS weight FROM edges LEFT JOIN hot p ON p.id = 'N' || s LEFT JOIN hot q ON q.id = 'N' || c", ENERGY)
add_table("successors", lambda s, d: inference.successors(read(s, d, "events").select(F.col("user_id").alias("who"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("key"))), "WITH s AS (SELECT event_type AS key, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), c AS (SELECT key, next, count(*) AS n FROM s WHERE next IS NOT NULL GROUP BY ALL) SELECT key, next, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, next) <= 3")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as states: the parent of the k-th is the k / 2-th, rounded down; its nodes are the parts' brands."""
    from pyspark.sql import Window

    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    name = lambda k: F.concat_ws("-", F.col("o_custkey").cast("string"), k.cast("string"))
    brands = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("p_brand").alias("nodes"))
    return order.join(brands, "o_orderkey").select(name(F.col("k")).alias("state"), F.when(F.col("k") > 1, name(F.floor(F.col("k") / 2))).alias("parent"), "nodes")


STATES = "od AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), st AS (SELECT o_custkey || '-' || k AS state, CASE WHEN k > 1 THEN o_custkey || '-' || (k // 2) END AS parent, list(DISTINCT p_brand) AS nodes FROM od JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, k)"
UP = "up AS (SELECT state, state AS ancestor, 0 AS d FROM st UNION ALL SELECT up.state, parent, d + 1 FROM up JOIN st ON ancestor = st.state WHERE parent IS NOT NULL)"
add_table("state_ancestors", lambda s, d: inference.ancestors(states(s, d)), f"WITH RECURSIVE {STATES}, {UP} SELECT state, ancestor, d::BIGINT AS d FROM up")
add_table("state_siblings", lambda s, d: inference.siblings(states(s, d)), f"WITH {STATES} SELECT parent, count(*) AS n FROM st WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2")
LEAF = "lf AS (SELECT * FROM st WHERE state NOT IN (SELECT parent FROM st WHERE parent IS NOT NULL)), ex AS (SELECT state, len(nodes) AS n, unnest(nodes) AS x FROM lf), cv AS (SELECT a.state AS a, b.state AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM ex a JOIN ex b ON a.x = b.x AND a.state < b.state GROUP BY a.state, b.state)"
add_table("state_convergence", lambda s, d: inference.convergent(states(s, d), 0.5, 6), f"WITH {STATES}, {LEAF} SELECT a, b, {r('j')} AS similarity FROM cv WHERE j >= 0.5")


def near_states(s: SparkSession, d: str) -> DataFrame:
    table = states(s, d)
    own = table.select(F.col("state").alias("a"), F.substring_index("state", "-", 1).alias("c"))
    return inference.common_ancestors(table, own.join(own.withColumnRenamed("a", "b"), "c").where("a < b"))


add_table("state_common_ancestors", near_states, f"WITH RECURSIVE {STATES}, {UP} SELECT a, b, arg_min(anc, (dist, anc)) AS ancestor, min(dist)::BIGINT AS distance FROM (SELECT p.state AS a, q.state AS b, p.ancestor AS anc, p.d + q.d AS dist FROM up p JOIN up q ON p.ancestor = q.ancestor AND p.state < q.state) GROUP BY a, b")

# flows and communities
add("max_flow", "lanes", lambda g: flow_row(g))
add("min_cut_side", "lanes", lambda g: flows.max_flow(g, *ends(g))[2])
add("fiedler_sides", "trade", lambda g: flows.fiedler(g, 12).select("id", (F.col("x") < 0).alias("other_side")))
add("local_move_communities", "trade", lambda g: flows.local_moves(g, 4))


def ends(g: Graph) -> tuple[str, str]:
    """The smallest id that is a source, and the largest that it reaches by one arc."""
    source = g.arcs.agg(F.min("src")).first()[0]
    return source, g.arcs.where(F.col("src") == source).agg(F.max("tgt")).first()[0]


def flow_row(g: Graph) -> DataFrame:
    value, flow, side = flows.max_flow(g, *ends(g))
    return flow.agg(F.lit(round(value, 6)).alias("value"), F.count("*").alias("pairs"))


# tensor eigenvectors
def _tensor(power: str) -> str:
    out = f"big AS (SELECT edge_id, node_id FROM members WHERE edge_id IN (SELECT edge_id FROM members GROUP BY edge_id HAVING count(*) > 1)), pw AS (SELECT {power} AS p FROM (SELECT count(*) AS n FROM big GROUP BY edge_id)), e0 AS (SELECT id, 1 / (SELECT count(*) FROM nodes) AS s FROM nodes)"
    for k in range(3):
        out += f", a{k} AS (SELECT edge_id, sum(ln(s)) AS l FROM big JOIN e{k} ON id = node_id GROUP BY edge_id), b{k} AS (SELECT node_id, pow(sum(exp(l - ln(s))), (SELECT p FROM pw)) AS s FROM big JOIN e{k} ON id = node_id JOIN a{k} USING (edge_id) GROUP BY node_id), e{k + 1} AS (SELECT id, coalesce(s, 0) / (SELECT sum(s) FROM b{k}) AS s FROM nodes LEFT JOIN b{k} ON id = node_id)"
    return out


for variant, power in (("h", "1 / (max(n) - 1)"), ("z", "max(1.0::DOUBLE)")):
    add(f"{variant}_eigenvector", "orders", lambda g, variant=variant: rounded(centrality.tensor_eigenvector(g, variant == "h", 3), "score", digits=8), f"SELECT id, {r('s', 8)} AS score FROM e3", _tensor(power))
