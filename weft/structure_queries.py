"""The registered queries on structure, dynamics, generators, files, streams and monitors; they add to weft.queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import dynamics, monitor, structure
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.plans.iterate import shared_folder
from weft.queries import OVER, add, add_table, forward, names, r
from weft.sources import files, generators
from weft.sources.graphs import read
from weft.streaming import events


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def members_of(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(column, ","))


# folds over an order: the same decisions one by one
MATCH = """ms AS (SELECT u, v, round(sum(weight), 9) AS w FROM cliq GROUP BY u, v), mo AS (SELECT *, row_number() OVER (ORDER BY w DESC, u, v) AS k FROM ms{}),
mf AS (SELECT 0 AS k, []::VARCHAR[] AS used UNION ALL SELECT mf.k + 1, CASE WHEN list_contains(used, u) OR list_contains(used, v) THEN used ELSE list_concat(used, [u, v]) END FROM mf JOIN mo ON mo.k = mf.k + 1),
mt AS (SELECT u, v, w FROM mo JOIN mf a ON a.k = mo.k - 1 JOIN mf b ON b.k = mo.k WHERE len(b.used) > len(a.used))"""
add("greedy_matching", "trade", structure.matching, "SELECT u, v, w FROM mt", MATCH.format(""))
add("bipartite_matching", "trade", lambda g: structure.matching(g, "region"), "SELECT u, v, w FROM mt", MATCH.format(" JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.region <> b.region"))
add("edge_cover", "trade", structure.edge_cover, "SELECT u, v FROM mt UNION ALL (SELECT DISTINCT least(x, o), greatest(x, o) FROM (SELECT u AS x, min(v) AS o FROM adj GROUP BY u) WHERE x NOT IN (SELECT u FROM mt UNION ALL SELECT v FROM mt))", MATCH.format(""))
add("vertex_cover", "trade", structure.vertex_cover, "SELECT u AS id FROM mt UNION ALL SELECT v FROM mt", MATCH.format(""))
FOLD = "fo AS (SELECT id, row_number() OVER (ORDER BY {}) AS k FROM nbr), fe AS (SELECT a.k, list(b.k) FILTER (b.k < a.k) AS e FROM fo a LEFT JOIN adj ON a.id = u LEFT JOIN fo b ON v = b.id GROUP BY a.k)"
SEEDED = FOLD.format("('0x' || substr(md5('0:' || id), 1, 12))::BIGINT, id") + ", ff AS (SELECT 0 AS k, []::BIGINT[] AS s UNION ALL SELECT ff.k + 1, CASE WHEN list_has_any(s, coalesce(e, [])) THEN s ELSE list_append(s, fe.k) END FROM ff JOIN fe ON fe.k = ff.k + 1), mis AS (SELECT id FROM fo WHERE k IN (SELECT unnest(s) FROM ff WHERE k = (SELECT max(k) FROM ff)))"
add("independent_set", "lanes", structure.independent_set, "SELECT id FROM mis", SEEDED)
add("undominated", "lanes", lambda g: structure.undominated(g, names(g, "N0", "N5")), "SELECT id FROM nodes WHERE id NOT IN ('N0', 'N5') AND id NOT IN (SELECT v FROM adj WHERE u IN ('N0', 'N5'))")
add("greedy_coloring", "lanes", structure.coloring, "SELECT id, c.s[fo.k] AS color FROM fo, (SELECT s FROM ff ORDER BY k DESC LIMIT 1) c", FOLD.format("k DESC, id") + ", ff AS (SELECT 0 AS k, []::BIGINT[] AS s UNION ALL SELECT ff.k + 1, list_append(s, list_min(list_filter(range(0, 1000), lambda x: NOT list_contains(list_transform(coalesce(e, []), lambda i: s[i]), x)))) FROM ff JOIN fe ON fe.k = ff.k + 1)")
CLIQUE = "nb AS (SELECT id, coalesce(list(v) FILTER (v IS NOT NULL), []) AS n FROM nodes LEFT JOIN adj ON id = u GROUP BY id), cq AS (SELECT [id] AS c, n FROM nb UNION ALL SELECT list_append(c, nb.id), list_intersect(cq.n, nb.n) FROM cq JOIN nb ON list_contains(cq.n, nb.id) AND nb.id > c[-1])"
add("maximal_cliques", "lanes", lambda g: members_of(structure.maximal_cliques(g), "clique"), "SELECT array_to_string(c, ',') AS clique FROM cq WHERE len(n) = 0", CLIQUE)
add("max_clique_size", "lanes", lambda g: structure.maximal_cliques(g).agg(F.max(F.size("clique")).cast("bigint").alias("size")), "SELECT max(len(c))::BIGINT AS size FROM cq", CLIQUE)
add("unchordal", "lanes", structure.unchordal)
add("structure_tests", "lanes", structure.tests)
LEVEL = "fw AS (SELECT * FROM arcs WHERE src < tgt), lv AS (SELECT id, 0 AS d FROM nodes UNION SELECT tgt, d + 1 FROM lv JOIN fw ON id = src), tl AS (SELECT id, max(d)::BIGINT AS level FROM lv GROUP BY id)"
add("dag_longest_paths", "lanes", lambda g: structure.longest_paths(forward(g)), "SELECT a.id, a.level, (SELECT min(src) FROM fw JOIN tl b ON src = b.id WHERE tgt = a.id AND b.level = a.level - 1) AS previous FROM tl a", LEVEL)
add("motifs_of_three", "lanes", structure.motifs, "SELECT ['none', 'one', 'two', 'three'][k::INT + 1] AS motif, count(*) AS n FROM (SELECT a.id, b.id, c.id, count(l.u) AS k FROM nodes a JOIN nodes b ON a.id < b.id JOIN nodes c ON b.id < c.id LEFT JOIN links l ON (l.u = a.id AND l.v IN (b.id, c.id)) OR (l.u = b.id AND l.v = c.id) GROUP BY a.id, b.id, c.id) GROUP BY k")
add("modularity", "trade", lambda g: rounded(structure.modularity(g, g.nodes.select("id", F.col("data")["region"].alias("community"))), "q"), f"SELECT {r('sum(i) / any_value(m) - sum(d * d) / (any_value(m) * any_value(m))')} AS q FROM (SELECT sum(shared)::DOUBLE AS d, sum(CASE WHEN a.region = b.region THEN shared ELSE 0 END) AS i, (SELECT sum(shared)::DOUBLE FROM adj) AS m FROM adj JOIN nodes a ON u = a.id JOIN nodes b ON v = b.id GROUP BY a.region)")
RANK = "sr0 AS (SELECT id AS u, id AS v, 1::DOUBLE AS s FROM nodes)" + "".join(f", sr{k + 1} AS (SELECT id AS u, id AS v, 1::DOUBLE AS s FROM nodes UNION ALL SELECT x, y, 0.9 * sum(s) / (any_value(p.k) * any_value(q.k)) FROM (SELECT a.u AS x, b.u AS y, s FROM sr{k} z JOIN adj a ON a.v = z.u JOIN adj b ON b.v = z.v WHERE a.u <> b.u) JOIN nbr p ON x = p.id JOIN nbr q ON y = q.id GROUP BY x, y)" for k in range(3))
add("simrank", "lanes", lambda g: rounded(structure.simrank(g), "score", digits=9), f"SELECT u, v, {r('s', 9)} AS score FROM sr3 WHERE u < v", RANK)
WEDGE = "wd AS (SELECT a.u, b.u AS v, k, p.region AS ru, q.region AS rv, z.region AS rw FROM adj a JOIN adj b ON a.v = b.v AND a.u < b.u JOIN nbr ON a.v = nbr.id JOIN nodes p ON a.u = p.id JOIN nodes q ON b.u = q.id JOIN nodes z ON a.v = z.id WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.u = a.u AND l.v = b.u))"
add("community_links", "lanes", lambda g: rounded(structure.community_links(g, "region"), "ra_community", "within_inter", "centrality"), f"SELECT u, v, count(*) AS common, (count(*) + count(*) FILTER (ru = rv AND rv = rw)) AS cn_community, {r('coalesce(sum(1 / k) FILTER (ru = rv AND rv = rw), 0)')} AS ra_community, {r('CASE WHEN any_value(ru = rv) THEN count(*) FILTER (rv = rw) / (count(*) FILTER (rv <> rw) + 0.001) ELSE 0 END')} AS within_inter, {r('0.8 * count(*) + 0.2 * (SELECT count(*) FROM nodes) / 2')} AS centrality FROM wd GROUP BY u, v", WEDGE)
add("s_distances", "lanes", lambda g: structure.s_distances(g, g.edges.agg(F.min("edge_id")).first()[0], 1), "SELECT id AS edge_id, min(d)::BIGINT AS d FROM sd GROUP BY id", f"{OVER}, oo AS (SELECT e1, e2 FROM ov UNION ALL SELECT e2, e1 FROM ov), sd AS (SELECT edge_id AS id, 0 AS d FROM edges WHERE edge_id = (SELECT min(edge_id) FROM edges) UNION SELECT e2, d + 1 FROM sd JOIN oo ON id = e1 WHERE d < 8)")
add("simplices", "lanes", lambda g: members_of(structure.simplices(g), "ids"), "SELECT id AS ids, 0::BIGINT AS dimension FROM nodes UNION ALL SELECT u || ',' || v, 1 FROM links")
add("bridges", "trade", structure.bridges)
add("two_edge_components", "trade", structure.two_edge_components)
add("voterank", "lanes", lambda g: structure.voterank(g, 5))
add("graph_fingerprint", "orders", files.fingerprint, "SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, (SELECT sum(('0x' || substr(md5(id || '|' || label), 1, 12))::HUGEINT) FROM nodes)::VARCHAR || '-' || sum(('0x' || substr(md5(edge_id || '|C' || o_custkey || '|' || t || '|' || label), 1, 12))::HUGEINT)::VARCHAR AS digest FROM edges JOIN (SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS t FROM inc WHERE role = 'target' GROUP BY edge_id) USING (edge_id)")

# dynamics
CHANCE = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656"
SICK = "x0 AS (SELECT 'N0' AS id UNION ALL SELECT 'N1')" + "".join(
    f", y{t} AS (SELECT id FROM x{t - 1} WHERE {CHANCE.format(f'''concat('0:r{t}:', id)''')} >= 0.1), k{t} AS (SELECT edge_id, count(*) AS k FROM members JOIN y{t} ON node_id = id GROUP BY edge_id), x{t} AS (SELECT id FROM y{t} UNION SELECT node_id FROM members JOIN k{t} USING (edge_id) WHERE node_id NOT IN (SELECT id FROM y{t}) AND {CHANCE.format(f'''concat('0:i{t}:', edge_id, ':', node_id)''')} < 1 - pow(0.9, k) * CASE WHEN k >= 2 THEN 0.95 ELSE 1 END)"
    for t in range(1, 5)
)
add("contagion", "lanes", lambda g: dynamics.contagion(g, names(g, "N0", "N1"), 4), " UNION ALL ".join(f"SELECT {t}::BIGINT AS step, count(*) AS infected FROM x{t}" for t in range(5)), SICK)
add("kuramoto_order", "trade", lambda g: rounded(dynamics.order_parameter(dynamics.kuramoto(g, g.nodes.select("id", F.substring("id", 2, 9).cast("double").alias("theta")), steps=3)), "r"), f"SELECT {r('sqrt(pow(avg(cos(t)), 2) + pow(avg(sin(t)), 2))')} AS r FROM t3", "mb AS (SELECT a.node_id AS id, b.node_id AS o FROM members a JOIN members b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id), t0 AS (SELECT id, substr(id, 2)::DOUBLE AS t FROM nodes)" + "".join(f", t{k + 1} AS (SELECT a.id, any_value(a.t) + 0.01::DOUBLE * (1 + coalesce(sum(sin(b.t - a.t)), 0)) AS t FROM t{k} a LEFT JOIN mb ON mb.id = a.id LEFT JOIN t{k} b ON o = b.id GROUP BY a.id)" for k in range(3)))
add("random_walks", "lanes", lambda g: dynamics.random_walks(g, names(g, "N0", "N1", "N2"), 5))

# generators
add_table("complete_graph", lambda s, d: generators.complete(s, 7, 2).edges.select("edge_id"), "SELECT 'n' || a || '-n' || b || '-n' || c AS edge_id FROM range(7) x(a) JOIN range(7) y(b) ON a < b JOIN range(7) z(c) ON b < c")
add_table("star_graph", lambda s, d: generators.star(s, 9).edges.select("edge_id"), "SELECT 'n0-n' || i AS edge_id FROM range(1, 9) t(i)")
add_table("ring_lattice", lambda s, d: generators.ring_lattice(s, 12, 2, 3).edges.select("edge_id"), "SELECT 'n' || l[1] || '-n' || l[2] || '-n' || l[3] AS edge_id FROM (SELECT list_sort([(i + 11) % 12, i, (i + 1) % 12]) AS l FROM range(12) t(i))")
add_table("block_model", lambda s, d: generators.block_model(s, [10, 20], 0.5, 0.1, 7).edges.select("edge_id"), f"SELECT 'n' || a || '-n' || b AS edge_id FROM range(30) x(a) JOIN range(30) y(b) ON a < b WHERE {CHANCE.format('''concat('7:', a, ':', b)''')} < CASE WHEN (a < 10) = (b < 10) THEN 0.5 ELSE 0.1 END")
add_table("uniform_graph", lambda s, d: generators.uniform(s, 30, 50, 3, 1).edges.select("edge_id", F.array_join(F.concat("source_ids", "target_ids"), ",").alias("ids")))
add_table("small_world", lambda s, d: generators.small_world(s, 40, 4, 0.2, 1).edges.select("edge_id", F.get("target_ids", F.lit(0)).alias("to")))


# files
def edgelist(g: Graph) -> DataFrame:
    """The graph's edges after they were written as an edge list and read back."""
    spark = g.edges.sparkSession
    path = folder(spark, "edgelist")
    files.write_edgelist(g, path)
    return files.read_edgelist(spark, path).edges.select(F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets"), "label", "weight")


def stored(fmt: str):
    def run(g: Graph) -> DataFrame:
        spark = g.edges.sparkSession
        path = folder(spark, fmt)
        files.save(g, path, fmt)
        back = files.load(spark, path, fmt)
        return back.nodes.select("id", "label", F.col("data")["brand"].alias("brand"))

    return run


def records(s: SparkSession, d: str) -> DataFrame:
    nodes = read(s, d, "nation").select(F.col("n_name").alias("name"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("data"))
    region = read(s, d, "region").select(F.col("r_name").alias("name"), F.create_map(F.lit("key"), F.col("r_regionkey").cast("string")).alias("data"))
    links = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey <> 3").select(F.col("n_name").alias("from"), F.col("r_name").alias("to"), F.lit("in").alias("relation"))
    g = files.from_records(nodes.unionByName(region), links.unionByName(links.select(F.col("from"), F.lit("nowhere").alias("to"), "relation")))
    return g.edges.select(F.get("source_ids", F.lit(0)).alias("src"), F.get("target_ids", F.lit(0)).alias("tgt"), "label", "weight")


add("edgelist_round_trip", "orders", edgelist, "SELECT 'C' || o_custkey AS sources, string_agg(node_id, ',' ORDER BY node_id) AS targets, e.label, e.weight FROM edges e JOIN inc ON e.edge_id = inc.edge_id AND role = 'target' GROUP BY e.edge_id, o_custkey, e.label, e.weight")
for fmt in ("parquet", "orc", "json"):
    add(f"{fmt}_round_trip", "orders", stored(fmt), "SELECT id, label, p_brand AS brand FROM nodes LEFT JOIN part ON id = 'P' || p_partkey")
add_table("load_records", records, "SELECT n_name AS src, r_name AS tgt, 'in' AS label, 1.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3")

# streams
SECONDS = "(floor(epoch(ts) / 3600) * 3600)::BIGINT"
add_table("stream_windows", lambda s, d: rounded(events.settle(events.windowed(events.stream(s, f"{d}/events.parquet"), "event_type", "value", late="3650 days"), ["start", "event_type"], folder(s, "windows")), "total", digits=4), f"SELECT {SECONDS} AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY ALL")
add_table("stream_activity", lambda s, d: rounded(events.settle(events.activity(events.stream(s, f"{d}/events.parquet"), "user_id", "value"), ["user_id"], folder(s, "activity")), "total", digits=4), f"SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last, {r('sum(value)', 4)} AS total FROM events GROUP BY user_id")

# monitors
add_table("event_log", lambda s, d: monitor.log_query(read(s, d, "events"), "click", F.lit("2024-01-10").cast("timestamp")).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10'")
add_table("feedback_signals", lambda s, d: monitor.signals(read(s, d, "events").select(F.col("user_id").alias("id"), (F.col("value") > 50).alias("relevant"))), "SELECT user_id AS id, count(*) FILTER (value > 50) AS good, count(*) FILTER (NOT value > 50) AS bad, CASE WHEN good > bad THEN 'reinforced' WHEN bad >= 2 THEN 'suppressed' ELSE 'neutral' END AS verdict FROM events GROUP BY user_id HAVING good + bad >= 2")
add_table("degradation", lambda s, d: rounded(monitor.degradation(read(s, d, "events").select(F.col("event_type").alias("operation"), "ts", F.col("event_id").alias("id"), "value")), "recent", "before"), f"SELECT event_type AS operation, {r('avg(value) FILTER (k <= 10)')} AS recent, {r('avg(value) FILTER (k > 10)')} AS before, coalesce(avg(value) FILTER (k <= 10) > 1.5 * avg(value) FILTER (k > 10), FALSE) AS degraded FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY event_type")


def views(g: Graph) -> DataFrame:
    """What lies ahead of N0, behind it, and around it by shared edges, as three views."""
    arcs = g.arcs
    rows = [arcs.where("src = 'N0'").select(F.lit("out").alias("view"), F.col("tgt").alias("id")), arcs.where("tgt = 'N0'").select(F.lit("in").alias("view"), F.col("src").alias("id")), g.adj.where("u = 'N0'").select(F.lit("any").alias("view"), F.col("v").alias("id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SEEN = "vw AS (SELECT 'out' AS w, tgt AS id FROM arcs WHERE src = 'N0' UNION SELECT 'in', src FROM arcs WHERE tgt = 'N0' UNION SELECT 'any', v FROM adj WHERE u = 'N0')"
for how, test in (("intersection", "= 3"), ("majority", "> 1.5"), ("union", "> 0")):
    add(f"consensus_{how}", "lanes", lambda g, how=how: rounded(monitor.consensus(views(g), 3, how), "share"), f"SELECT id, {r('count(*) / 3')} AS share FROM vw GROUP BY id HAVING count(*) {test}", SEEN)
add("compare_reach", "lanes", lambda g: rounded(monitor.compare_sets(g.arcs.where("src = 'N0'").select(F.col("tgt").alias("id")), g.arcs.where("tgt = 'N0'").select(F.col("src").alias("id"))), "jaccard", "precision", "recall", "f1"), f"SELECT c AS common, {r('coalesce(c / nullif(a + b - c, 0), 0)')} AS jaccard, {r('coalesce(c / nullif(a, 0), 0)')} AS precision, {r('coalesce(c / nullif(b, 0), 0)')} AS recall, {r('coalesce(2 * c / nullif(a + b, 0), 0)')} AS f1 FROM (SELECT count(*) FILTER (src = 'N0') AS a, count(*) FILTER (tgt = 'N0') AS b, count(*) FILTER (src = 'N0' AND EXISTS (SELECT 1 FROM arcs q WHERE q.src = arcs.tgt AND q.tgt = 'N0')) AS c FROM arcs)")
add_table("density_map", lambda s, d: monitor.density_map(read(s, d, "part").select(F.col("p_size").cast("double").alias("px"), F.col("p_retailprice").cast("double").alias("py"))), "SELECT least(floor((p_size::DOUBLE - x0) / (x1 - x0) * 10), 9)::BIGINT AS x, least(floor((p_retailprice::DOUBLE - y0) / (y1 - y0) * 10), 9)::BIGINT AS y, count(*) AS n FROM part, (SELECT min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, min(p_retailprice)::DOUBLE AS y0, max(p_retailprice)::DOUBLE AS y1 FROM part) GROUP BY ALL")
