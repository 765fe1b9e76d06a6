"""The registered queries on lookups, concept sets, recall and updates; they add to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import centrality, concepts, maintenance
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import PARTS, add, names, r
from weft.sources.graphs import read

# lookups
add("get_node", "orders", lambda g: g.nodes.where(F.col("id") == "P7").select("id", "label", "weight"), "SELECT id, label, 1.0::DOUBLE AS weight FROM nodes WHERE id = 'P7'")
add("get_node_by_label", "trade", lambda g: concepts.find(g, g.nodes.agg(F.min("label")).first()[0]).rows, "SELECT id, label, 1.0::DOUBLE AS score FROM nodes WHERE label = (SELECT min(label) FROM nodes)")
add("get_edge", "orders", lambda g: g.edges.where(F.col("edge_id") == "O7").select("edge_id", F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets"), "label", "weight"), "SELECT e.edge_id, 'C' || o_custkey AS sources, string_agg(node_id, ',' ORDER BY node_id) AS targets, e.label, e.weight FROM edges e JOIN inc ON e.edge_id = inc.edge_id AND role = 'target' WHERE e.edge_id = 'O7' GROUP BY ALL")
add("all_nodes", "orders", lambda g: g.nodes.select("id", "label"), "SELECT id, label FROM nodes")
add("all_edges", "orders", lambda g: g.edges.select("edge_id", "label", "weight", (F.size("source_ids") + F.size("target_ids")).cast("bigint").alias("size")), "SELECT edge_id, label, weight, count(*) AS size FROM inc GROUP BY ALL")
add("query_dimension", "orders", lambda g: concepts.tagged(g, "ECONOMY", "type").select("id"), f"SELECT id FROM ({PARTS}) WHERE list_contains(string_split_regex(type, '[\\s,]+'), 'ECONOMY')")
add("neighbor_edges", "orders", lambda g: concepts.neighbor_edges(g, "C7").withColumn("edges", F.array_join("edges", ",")), "SELECT b.node_id AS id, string_agg(a.edge_id, ',' ORDER BY a.edge_id) AS edges FROM members a JOIN members b ON a.edge_id = b.edge_id AND b.node_id <> 'C7' WHERE a.node_id = 'C7' GROUP BY b.node_id")
NEAR = "b0 AS (SELECT 'P7' AS id, 0 AS d), b1 AS (SELECT id, min(d) AS d FROM (SELECT * FROM b0 UNION ALL SELECT v, d + 1 FROM b0 JOIN adj ON id = u) GROUP BY id), b2 AS (SELECT id, min(d)::BIGINT AS depth FROM (SELECT * FROM b1 UNION ALL SELECT v, d + 1 FROM b1 JOIN adj ON id = u) GROUP BY id)"
add("recall", "orders", lambda g: concepts.recall(g, names(g, "P7"), 2, 50), "SELECT * FROM b2 ORDER BY depth, id LIMIT 50", NEAR)
add("recall_narrow", "orders", lambda g: concepts.recall(g, names(g, "P7"), 1, 10), "SELECT id, d::BIGINT AS depth FROM b1 ORDER BY d, id LIMIT 10", NEAR)
add("recall_broad", "lanes", lambda g: concepts.recall(g, names(g, "N0"), 6, 200), "SELECT id, min(d)::BIGINT AS depth FROM hp GROUP BY id", "hp AS (SELECT 'N0' AS id, 0 AS d UNION SELECT v, d + 1 FROM hp JOIN adj ON id = u WHERE d < 6)")
add("recall_of_modality", "orders", lambda g: concepts.recall(g, names(g, "P7"), 2, 50, "ECONOMY", "type"), f"SELECT b2.id, depth FROM b2 JOIN ({PARTS}) p ON b2.id = p.id WHERE list_contains(string_split_regex(type, '[\\s,]+'), 'ECONOMY') ORDER BY depth, b2.id LIMIT 50", NEAR)
STRONG = "st AS (SELECT u AS a, v AS id, max(weight) AS s FROM cliq GROUP BY ALL UNION ALL SELECT v, u, max(weight) FROM cliq GROUP BY ALL), ok AS (SELECT id FROM nodes WHERE id <> 'P9'), a1 AS (SELECT st.id, max(s) AS s FROM st JOIN ok ON st.id = ok.id WHERE a = 'P7' GROUP BY st.id ORDER BY 2 DESC, 1 LIMIT 39), a2 AS (SELECT st.id, max(s) AS s FROM st JOIN ok ON st.id = ok.id WHERE a IN (SELECT id FROM a1) AND st.id <> 'P7' AND st.id NOT IN (SELECT id FROM a1) GROUP BY st.id ORDER BY 2 DESC, 1 LIMIT (SELECT 39 - count(*) FROM a1))"
add("slice_around", "orders", lambda g: concepts.slice_around(g, "P7", 2, 40, F.col("id") != "P9"), "SELECT 'P7' AS id, 0::BIGINT AS depth, NULL::DOUBLE AS strength UNION ALL SELECT id, 1, s FROM a1 UNION ALL SELECT id, 2, s FROM a2", STRONG)
add("strongest_associations", "orders", lambda g: concepts.strongest(g, "C7", 10), "SELECT id, w AS weight, row_number() OVER (ORDER BY w DESC, id) AS rank FROM (SELECT b.node_id AS id, max(b.weight) AS w FROM members a JOIN members b ON a.edge_id = b.edge_id AND b.node_id <> 'C7' WHERE a.node_id = 'C7' GROUP BY b.node_id ORDER BY 2 DESC, 1 LIMIT 10)")


# concept sets
def brand(g: Graph, value: str = "Brand#1") -> concepts.ConceptSet:
    return concepts.find(g, data={"brand": value})


def degrees(g: Graph) -> concepts.ConceptSet:
    return brand(g).centrality(g.degree.select("id", F.col("degree").alias("score")))


SET = f"bs AS (SELECT n.id, n.label, 1.0::DOUBLE AS score FROM nodes n JOIN ({PARTS}) p ON n.id = p.id WHERE brand = 'Brand#1'), ds AS (SELECT bs.id, label, degree::DOUBLE AS score FROM bs JOIN degree d ON bs.id = d.id)"
add("concepts_find", "orders", lambda g: brand(g).rows, "SELECT * FROM bs", SET)
add("concepts_query_nodes", "orders", lambda g: concepts.find(g, data={"brand": "Brand#1"}, limit=10).rows.select("id"), "SELECT id FROM bs ORDER BY id LIMIT 10", SET)
add("concepts_centrality", "orders", lambda g: degrees(g).rows, "SELECT * FROM ds", SET)
add("concepts_top", "orders", lambda g: degrees(g).top(7).rows, "SELECT * FROM ds ORDER BY score DESC, id LIMIT 7", SET)
add("concepts_filter", "orders", lambda g: degrees(g).filter(F.col("score") % 2 == 0).rows, "SELECT * FROM ds WHERE score % 2 = 0", SET)
add("concepts_threshold", "orders", lambda g: degrees(g).threshold(30.0).rows, "SELECT * FROM ds WHERE score >= 30", SET)
add("concepts_exclude", "trade", lambda g: concepts.find(g).exclude(*[x[0] for x in g.nodes.where("id in ('N1', 'N2')").select("label").collect()]).rows, "SELECT id, label, 1.0::DOUBLE AS score FROM nodes WHERE label NOT IN (SELECT label FROM nodes WHERE id IN ('N1', 'N2'))")
add("concepts_unique", "orders", lambda g: concepts.ConceptSet(g, degrees(g).rows.withColumn("label", F.substring("label", 1, 3))).unique().rows, "SELECT first(id ORDER BY score DESC, id) AS id, substr(label, 1, 3) AS label, max(score) AS score FROM ds GROUP BY substr(label, 1, 3)", SET)
add("concepts_neighbors", "orders", lambda g: degrees(g).neighbors().rows, "SELECT n.id, n.label, max(score) AS score FROM ds JOIN adj ON ds.id = u JOIN nodes n ON v = n.id GROUP BY n.id, n.label", SET)
add("concepts_sources", "orders", lambda g: degrees(g).neighbors("1-URGENT", "in").rows, "SELECT n.id, n.label, max(score) AS score FROM ds JOIN pairs p ON ds.id = p.tgt AND p.label = '1-URGENT' JOIN nodes n ON src = n.id GROUP BY n.id, n.label", SET)
RATE = "rt AS (SELECT src AS f, tgt AS id, sum(weight * 0.85) AS w FROM pairs GROUP BY ALL UNION ALL SELECT tgt, src, sum(weight * 0.3 * 0.85) FROM pairs WHERE src <> tgt GROUP BY ALL), s0 AS (SELECT id, 1::DOUBLE AS e FROM nodes WHERE id IN ('N0', 'N1'))" + "".join(f", t{k} AS (SELECT id, sum(e) AS e FROM (SELECT id, e FROM s{k} UNION ALL SELECT rt.id, s.e * w FROM s{k} s JOIN rt ON s.id = f) GROUP BY id), s{k + 1} AS (SELECT id, e * (SELECT max(e) FROM s{k}) / (SELECT max(e) FROM t{k}) AS e FROM t{k} WHERE e * (SELECT max(e) FROM s{k}) / (SELECT max(e) FROM t{k}) >= 0.01)" for k in range(3))
add("concepts_activate", "lanes", lambda g: rounded(concepts.ConceptSet(g, names(g, "N0", "N1").select("id", F.col("id").alias("label"), F.lit(1.0).alias("score"))).activate(1.0, 8, 3).rows, "score"), f"SELECT n.id, label, {r('e')} AS score FROM s3 JOIN nodes n ON s3.id = n.id ORDER BY e DESC, n.id LIMIT 8", RATE)
add("retrieve", "lanes", lambda g: rounded(concepts.ConceptSet(g, names(g, "N0", "N1").select("id", F.col("id").alias("label"), F.lit(1.0).alias("score"))).query(top_k=8).rows, "score"), f"SELECT n.id, label, {r('1 / (60 + row_number() OVER (ORDER BY e DESC, n.id))')} AS score FROM s3 JOIN nodes n ON s3.id = n.id WHERE n.id NOT IN ('N0', 'N1') ORDER BY e DESC, n.id LIMIT 8", RATE)
add("associative_recall", "lanes", lambda g: rounded(concepts.retrieval.spread(g, names(g, "N0", "N1").withColumn("energy", F.lit(1.0)), 3).where("id not in ('N0', 'N1') and energy >= 0.1"), "energy").orderBy(F.desc("energy"), "id").limit(10), f"SELECT id, {r('e')} AS energy FROM s3 WHERE id NOT IN ('N0', 'N1') AND e >= 0.1 ORDER BY e DESC, id LIMIT 10", RATE)
GATE = "z0 AS (SELECT 'C' || k AS id, 1::DOUBLE AS e FROM range(7, 9) t(k)), tn AS (SELECT edge_id, count(*) AS n FROM inc WHERE role = 'target' GROUP BY edge_id), z1 AS (SELECT * FROM (SELECT id, sum(e) AS e FROM (SELECT * FROM z0 UNION ALL SELECT t.node_id, e * t.weight * 0.85 / n FROM z0 z JOIN inc s ON z.id = s.node_id AND s.role = 'source' JOIN inc t ON s.edge_id = t.edge_id AND t.role = 'target' JOIN tn ON tn.edge_id = s.edge_id) GROUP BY id) WHERE e >= 0.01)"
add("concepts_diffuse", "orders", lambda g: rounded(concepts.ConceptSet(g, names(g, "C7", "C8").select("id", F.col("id").alias("label"), F.lit(1.0).alias("score"))).diffuse(1.0, "linear", 1).rows, "score"), f"SELECT n.id, label, {r('e')} AS score FROM z1 JOIN nodes n ON z1.id = n.id", GATE)
add("concepts_paths_to", "lanes", lambda g: concepts.find(g, data={"region": "1"}).paths_to("N3", max_depth=4).select(F.array_join("path", ",").alias("path"), "hops"), "SELECT array_to_string(p, ',') AS path, (len(p) - 1)::BIGINT AS hops FROM walk WHERE e = 'N3'", "walk AS (SELECT [src, tgt] AS p, tgt AS e FROM arcs JOIN nodes ON src = id WHERE region = '1' AND src <> 'N3' UNION ALL SELECT list_append(p, tgt), tgt FROM walk JOIN arcs ON e = src WHERE len(p) < 5 AND e <> 'N3' AND NOT list_contains(p, tgt))")


def ends_of(g: Graph, label: str) -> DataFrame:
    return g.edges.where(F.col("label") == label).select("edge_id", F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets"), "weight")


add("concepts_link_to", "trade", lambda g: ends_of(concepts.find(g, data={"region": "1"}).link_to("N0", "near", 0.5), "near"), "SELECT 'near:' || id || ':N0' AS edge_id, id AS sources, 'N0' AS targets, 0.5::DOUBLE AS weight FROM nodes WHERE region = '1' AND id <> 'N0'")
add("concepts_link_all", "trade", lambda g: ends_of(concepts.find(g, data={"region": "1"}).link_all("near"), "near"), "SELECT 'near:' || a.id || ':' || b.id AS edge_id, a.id AS sources, b.id AS targets, 1.0::DOUBLE AS weight FROM nodes a JOIN nodes b ON a.region = '1' AND b.region = '1' AND a.id < b.id")
add("concepts_add_data", "trade", lambda g: concepts.find(g, data={"region": "1"}).add_data(region="one", seen="yes").nodes.select("id", F.col("data")["region"].alias("region"), F.col("data")["seen"].alias("seen")), "SELECT id, CASE WHEN region = '1' THEN 'one' ELSE region END AS region, CASE WHEN region = '1' THEN 'yes' END AS seen FROM nodes")


# updates
def extra(g: Graph) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([("N0", "changed", {"region": "9"}, 7.0), ("X1", "new", {"region": "9"}, 1.0)], "id string, label string, data map<string,string>, weight double")


def more_edges(g: Graph) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([("e1", ["N0"], ["N1", "N2"], "x", 1.0), ("e2", ["N0"], ["nowhere"], "x", 1.0), ("N0-N1", ["N5"], ["N6"], "x", 3.0)], "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double")


add("add_nodes", "trade", lambda g: maintenance.add_nodes(g, extra(g)).nodes.select("id", "label", "weight"), "SELECT id, label, 1.0::DOUBLE AS weight FROM nodes UNION ALL SELECT 'X1', 'new', 1.0")
add("upsert_nodes", "trade", lambda g: maintenance.upsert_nodes(g, extra(g), 1.1).nodes.select("id", "label", "weight"), "SELECT id, CASE WHEN id = 'N0' THEN 'changed' ELSE label END AS label, CASE WHEN id = 'N0' THEN 1.1 ELSE 1.0 END::DOUBLE AS weight FROM nodes UNION ALL SELECT 'X1', 'new', 1.0")
add("add_edges", "trade", lambda g: maintenance.add_edges(g, more_edges(g)).edges.select("edge_id", "label", "weight"), "SELECT edge_id, label, weight FROM edges UNION ALL SELECT 'e1', 'x', 1.0 UNION ALL SELECT 'N0-N1', 'x', 3.0 WHERE NOT EXISTS (SELECT 1 FROM edges WHERE edge_id = 'N0-N1')")
add("add_all", "trade", lambda g: maintenance.add_all(g, extra(g), more_edges(g).withColumn("target_ids", F.when(F.col("edge_id") == "e2", F.array(F.lit("X1"))).otherwise(F.col("target_ids")))).edges.select("edge_id", "label", "weight"), "SELECT edge_id, label, weight FROM edges UNION ALL SELECT 'e1', 'x', 1.0 UNION ALL SELECT 'e2', 'x', 1.0 UNION ALL SELECT 'N0-N1', 'x', 3.0 WHERE NOT EXISTS (SELECT 1 FROM edges WHERE edge_id = 'N0-N1')")
add("upsert_edges", "trade", lambda g: maintenance.upsert_edges(g, more_edges(g)).edges.select("edge_id", "label", "weight"), "SELECT edge_id, label, weight FROM edges WHERE edge_id <> 'N0-N1' UNION ALL SELECT 'e1', 'x', 1.0 UNION ALL SELECT 'N0-N1', 'x', 3.0")
add("remove_edges", "trade", lambda g: maintenance.remove_edges(g, g.edges.where("label = 'intra'")).edges.select("edge_id"), "SELECT edge_id FROM edges WHERE label <> 'intra'")
add("link", "trade", lambda g: ends_of(maintenance.link(g, ["N1"], ["N2"], "tie", 2.0, both_ways=True), "tie"), "SELECT * FROM (VALUES ('tie:N1:N2', 'N1', 'N2', 2.0::DOUBLE), ('tie:N2:N1', 'N2', 'N1', 2.0)) t(edge_id, sources, targets, weight)")
add("link_hyper", "trade", lambda g: ends_of(maintenance.link(g, ["N4", "N1"], ["N2", "N3"], "many"), "many"), "SELECT 'many:N1+N4:N2+N3' AS edge_id, 'N1,N4' AS sources, 'N2,N3' AS targets, 1.0::DOUBLE AS weight")
add("prune_dead_nodes", "orders", lambda g: maintenance.prune(maintenance.decay(g, 0.5), 0.5).nodes.select("id"), "SELECT id FROM degree WHERE degree > 0")
add("reinforce_nodes", "trade", lambda g: rounded(maintenance.reinforce(g, names(g, "N0", "N3"), 1.1).nodes, "weight").select("id", "weight"), "SELECT id, CASE WHEN id IN ('N0', 'N3') THEN 1.1 ELSE 1.0 END::DOUBLE AS weight FROM nodes")
add("maintenance_cycle", "orders", lambda g: rounded(maintenance.evolve(g, names(g, "P1"), names(g, "P2"), 0.95, 1.1, 0.95).nodes, "weight").select("id", "weight"), f"SELECT d.id, {r('''0.95::DOUBLE * CASE WHEN d.id = 'P1' THEN 1.1 WHEN d.id = 'P2' THEN 0.95 ELSE 1 END''')} AS weight FROM degree d WHERE degree > 0 OR d.id = 'P1'")
