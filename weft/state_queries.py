"""The registered queries on states, search, versions, patterns, learning and generators beyond those of weft.queries, to which they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.concept_queries import RATE
from weft.inference_queries import BEST, LEAF, OWN, STATES, UP, ends, states
from weft.operators import concepts, inference, maintenance, retrieval, rewriting, search
from weft.operators import states as st
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import EAV, HOPS, PARTS, add, add_table, names, r
from weft.sources import generators
from weft.sources.graphs import read
from weft.structure_queries import CHANCE, folder

# states
NEW = "nw AS (SELECT a.state, a.parent, list_filter(list_sort(a.nodes), lambda x: NOT list_contains(coalesce(p.nodes, []), x)) AS new FROM st a LEFT JOIN st p ON a.parent = p.state)"
joined = lambda df, *cs: df.withColumns({c: F.array_join(F.array_sort(c), ",") for c in cs})
add_table("states_produced", lambda s, d: joined(st.produced(states(s, d)), "new"), f"WITH {STATES}, {NEW} SELECT state, parent, array_to_string(new, ',') AS new FROM nw")
add_table("simultaneity_groups", lambda s, d: joined(st.groups(states(s, d)), "states"), f"WITH {STATES} SELECT parent, string_agg(state, ',' ORDER BY state) AS states FROM st WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2")
FIRST = "(SELECT min(state) FROM st WHERE parent IN (SELECT parent FROM st WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2))"


def first_sibling(table: DataFrame) -> str:
    return st.groups(table).agg(F.min(F.get("states", F.lit(0)))).first()[0]


add_table("lateral_insights", lambda s, d: (lambda t: joined(st.lateral_insights(t, first_sibling(t)), "own", "other"))(states(s, d)), f"WITH {STATES}, {NEW}, ft AS (SELECT * FROM nw WHERE state = {FIRST}), x AS (SELECT nw.state AS sibling, list_filter(ft.new, lambda x: NOT list_contains(nw.new, x)) AS own, list_filter(nw.new, lambda x: NOT list_contains(ft.new, x)) AS other FROM nw JOIN ft ON nw.parent = ft.parent AND nw.state <> ft.state) SELECT sibling, array_to_string(own, ',') AS own, array_to_string(other, ',') AS other FROM x WHERE len(own) > 0 OR len(other) > 0")
JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 1 END"
add_table("state_similarity", lambda s, d: rounded(st.state_similarity(states(s, d), st.siblings_of(states(s, d))), "similarity"), f"WITH {STATES}, {NEW} SELECT a.state AS a, b.state AS b, {r('0.7 * (' + JAC.format('a.nodes', 'b.nodes') + ') + 0.3 * (' + JAC.format('p.new', 'q.new') + ')')} AS similarity FROM st a JOIN st b ON a.parent = b.parent AND a.state <> b.state JOIN nw p ON p.state = a.state JOIN nw q ON q.state = b.state")
add_table("state_invariants", lambda s, d: inference.convergent(states(s, d), 0.7, 6), f"WITH {STATES}, {LEAF} SELECT a, b, {r('j')} AS similarity FROM cv WHERE j >= 0.7")
DICE = "dx AS (SELECT a.state AS a, b.state AS b, count(*) AS k, 2 * count(*) / (any_value(a.n) + any_value(b.n)) AS v FROM ex a JOIN ex b ON a.x = b.x AND a.state < b.state GROUP BY a.state, b.state)"
add_table("state_correlations", lambda s, d: st.correlations(states(s, d), 0.6, 6), f"WITH {STATES}, {LEAF}, {DICE} SELECT a, b, {r('v')} AS dice, k AS shared FROM dx WHERE v >= 0.6")
add_table("states_merged", lambda s, d: st.merged(states(s, d), 0.7), f"WITH RECURSIVE {STATES}, {LEAF}, ln AS (SELECT a, b FROM cv WHERE j >= 0.7 UNION ALL SELECT b, a FROM cv WHERE j >= 0.7), cn AS (SELECT a, b FROM ln UNION SELECT cn.a, ln.b FROM cn JOIN ln ON cn.b = ln.a) SELECT a AS state, least(a, min(b)) AS into FROM cn GROUP BY a")
DIST = f"ds AS (SELECT st.state, 1 - len(list_intersect(st.nodes, f.nodes)) / greatest(len(list_distinct(list_concat(st.nodes, f.nodes))), 1) AS x FROM st, (SELECT * FROM st WHERE state = {FIRST}) f WHERE st.state <> f.state)"
for name, low, high in (("state_neighbors", 0.0, 0.8), ("state_analogies", 0.3, 0.7)):
    add_table(name, lambda s, d, low=low, high=high: (lambda t: rounded(st.near(t, first_sibling(t), high, low), "distance"))(states(s, d)), f"WITH {STATES}, {DIST} SELECT state, {r('x')} AS distance FROM ds WHERE x BETWEEN {low} AND {high}")
add_table("state_transfer", lambda s, d: (lambda t: st.transfer(t, first_sibling(t), t.agg(F.max("state")).first()[0]))(states(s, d)), f"WITH {STATES} SELECT DISTINCT node FROM (SELECT unnest(nodes) AS node FROM st WHERE state = {FIRST}) WHERE node NOT IN (SELECT unnest(nodes) FROM st WHERE state = (SELECT max(state) FROM st))")


def two_leaves(table: DataFrame) -> tuple[str, str]:
    """The first and the last state of the customer with the first sibling."""
    own = first_sibling(table).split("-")[0]
    row = table.where(F.substring_index("state", "-", 1) == own).agg(F.min("state"), F.max("state")).first()
    return row[0], row[1]


ENDS = f"own AS (SELECT state FROM st WHERE string_split(state, '-')[1] = string_split({FIRST}, '-')[1]), ab AS (SELECT min(state) AS a, max(state) AS b FROM own)"
add_table("state_path", lambda s, d: (lambda t: st.plan_path(t, *two_leaves(t)))(states(s, d)), f"WITH RECURSIVE {STATES}, {ENDS}, {UP}, tp AS (SELECT p.ancestor AS anc, p.d AS da, q.d AS db FROM up p JOIN up q ON p.ancestor = q.ancestor, ab WHERE p.state = a AND q.state = b ORDER BY p.d + q.d, p.ancestor LIMIT 1) SELECT d::BIGINT AS place, ancestor AS state FROM up, ab, tp WHERE state = a AND d <= da UNION ALL SELECT (da + db - d)::BIGINT, ancestor FROM up, ab, tp WHERE state = b AND d < db")

# search
ASK = "brand:Brand#1,Brand#2 size:10..40 ^type:2.0"
FOUND = f"f AS (SELECT id, brand, type, size FROM ({PARTS}) WHERE brand IN ('Brand#1', 'Brand#2') AND size BETWEEN 10 AND 40)"
add("search", "orders", lambda g: search.search(g, search.parse(ASK), 10, 5), "SELECT rank, f.id, label, 2.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM f) f JOIN nodes n ON f.id = n.id WHERE rank BETWEEN 6 AND 15", FOUND)
add("search_words", "orders", lambda g: search.search(g, search.parse("economy size:10..40"), 20), f"SELECT rank, x.id, label, 1.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM ({PARTS}) WHERE size BETWEEN 10 AND 40 AND list_contains(string_split_regex(lower(trim(type)), '\\s+'), 'economy')) x JOIN nodes n ON x.id = n.id WHERE rank <= 20")
add("browse", "orders", lambda g: search.search(g, search.build(filters={"brand": "Brand#1", "size": (5, None)}), 20), f"SELECT rank, x.id, label, 1.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM ({PARTS}) WHERE size >= 5 AND brand = 'Brand#1') x JOIN nodes n ON x.id = n.id WHERE rank <= 20")
add("search_activated", "lanes", lambda g: rounded(search.search(g, search.build(filters={"region": ("0", "1", "2")}, boosts={"region": 1.5}), 8, 0, retrieval.spread(g, names(g, "N0", "N1").withColumn("energy", F.lit(1.0)), 3).select("id", F.col("energy").alias("score"))), "score"), f"SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, id, label, {r('s')} AS score FROM (SELECT n.id, n.label, (1 + 0.4::DOUBLE * coalesce(e, 0)) / 1.4::DOUBLE * 1.5 AS s FROM nodes n LEFT JOIN s3 ON s3.id = n.id WHERE region IN ('0', '1', '2')) ORDER BY s DESC, id LIMIT 8", RATE)
add("index_stats", "orders", lambda g: search.index_stats(search.attribute_index(g)), "SELECT field, count(*) AS entries, count(DISTINCT sval) AS values FROM eav GROUP BY field", EAV)
add("field_values", "orders", lambda g: search.field_values(search.attribute_index(g), "type"), "SELECT DISTINCT sval AS value FROM eav WHERE field = 'type'", EAV)


def plans(g: Graph) -> DataFrame:
    asked = ["brand:Brand#1", "brand:Brand#1 size:10..10 word", "brand:Brand#1 word", "word", "size:0..1000 word"]
    rows = [(q, *search.plan(g, search.parse(q))) for q in asked]
    return rounded(g.nodes.sparkSession.createDataFrame(rows, "query string, strategy string, share double"), "share")


SHARE = f"(SELECT count(*) FROM ({PARTS}) WHERE {{}}) / (SELECT count(*) FROM nodes)"
PLAN = "SELECT query, CASE WHEN kind = 'browse' OR kind = 'activate_only' THEN kind WHEN share < 0.01 THEN 'index_only' WHEN share < 0.1 THEN 'index_then_activate' ELSE 'hybrid' END AS strategy, " + r("share") + " AS share FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS query, '{kind}' AS kind, {SHARE.format(test) if test else '1'} AS share" for q, kind, test in (("brand:Brand#1", "browse", "brand = 'Brand#1'"), ("brand:Brand#1 size:10..10 word", "", "brand = 'Brand#1' AND size = 10"), ("brand:Brand#1 word", "", "brand = 'Brand#1'"), ("word", "activate_only", ""), ("size:0..1000 word", "", "size BETWEEN 0 AND 1000"))) + ")"
add("search_plan", "orders", plans, PLAN)

# vectors and learned ranking
VECS = "u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"
add_table("vector_pairs", lambda s, d: rounded(retrieval.vector_pairs(read(s, d, "embeddings"), read(s, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))), "cosine", "distance"), f"WITH {VECS} SELECT a.vec_id AS a, b.vec_id AS b, {r('list_inner_product(a.e, b.e)')} AS cosine, {r('list_distance(a.e, b.e)')} AS distance FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")


def records(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select((F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 2000).alias("price"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("relevant"))


def trained(s: SparkSession, d: str) -> DataFrame:
    weights = retrieval.train_weights(records(s, d), ["size", "price"], 0.1, 20)
    return rounded(s.createDataFrame(list(weights.items()), "feature string, weight double"), "weight")


GD = "rc AS (SELECT p_size / 50 AS s, p_retailprice / 2000 AS p, (p_size > 25)::INT AS y FROM part), mo AS (SELECT avg(s * s) AS ss, avg(s * p) AS sp, avg(p * p) AS pp, avg(s * y) AS sy, avg(p * y) AS py FROM rc), gd AS (SELECT 0 AS k, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b UNION ALL SELECT k + 1, a - 0.1::DOUBLE * (a * ss + b * sp - sy), b - 0.1::DOUBLE * (a * sp + b * pp - py) FROM gd, mo WHERE k < 20)"
add_table("train_weights", trained, f"WITH RECURSIVE {GD} SELECT 'size' AS feature, {r('a / (abs(a) + abs(b))')} AS weight FROM gd WHERE k = 20 UNION ALL SELECT 'price', {r('b / (abs(a) + abs(b))')} FROM gd WHERE k = 20")
add_table("feature_score", lambda s, d: rounded(retrieval.feature_score(read(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 2000).alias("price")), {"size": 0.7, "price": 0.3}), "score").select("p_partkey", "score"), f"SELECT p_partkey, {r('0.7 * p_size / 50 + 0.3 * p_retailprice / 2000')} AS score FROM part")
add_table("stale_nodes", lambda s, d: retrieval.recency(read(s, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"))).where("score < 5").select("id"), "SELECT user_id AS id FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY user_id HAVING least(sum(pow(0.9::DOUBLE, k - 1)), 100) < 5")
add_table("top_recent", lambda s, d: rounded(retrieval.recency(read(s, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"))), "score").orderBy(F.desc("score"), "id").limit(10), f"SELECT user_id AS id, {r('least(sum(pow(0.9::DOUBLE, k - 1)), 100)')} AS score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 10")

# patterns and proofs
add("match_diamond", "orders", lambda g: rounded(inference.diamonds(g, "1-URGENT", 2), "score"), f"SELECT a.src AS a, b.src AS b, count(*) AS shared, {r('count(*) / (any_value(p.n) + any_value(q.n) - count(*))')} AS score FROM pp a JOIN pp b ON a.tgt = b.tgt AND a.src < b.src JOIN dn p ON a.src = p.src JOIN dn q ON b.src = q.src GROUP BY a.src, b.src HAVING count(*) >= 2", "pp AS (SELECT DISTINCT src, tgt FROM pairs WHERE label = '1-URGENT'), dn AS (SELECT src, count(*) AS n FROM pp GROUP BY src)")
add("match_template", "lanes", lambda g: inference.template(g, [("x", "y", "inter", 0.5), ("y", "z", None, 0.0), ("w", "y", "inter", 0.5)]), "SELECT DISTINCT p.src AS x, p.tgt AS y, q.tgt AS z, o.src AS w FROM pairs p JOIN pairs q ON p.tgt = q.src JOIN pairs o ON o.tgt = p.tgt WHERE p.label = 'inter' AND p.weight >= 0.5 AND o.label = 'inter' AND o.weight >= 0.5")
add("prove_batch", "lanes", lambda g: inference.provable(g, "inter", g.nodes, names(g, "N0", "N3"), 5), "SELECT n.id, d IS NOT NULL AS proven, d AS depth FROM nodes n LEFT JOIN (SELECT id, min(d)::BIGINT AS d FROM pv GROUP BY id) p ON n.id = p.id", "ia AS (SELECT DISTINCT src, tgt FROM pairs WHERE label = 'inter' AND src <> tgt), pv AS (SELECT id, 0 AS d FROM nodes WHERE id IN ('N0', 'N3') UNION SELECT tgt, d + 1 FROM pv JOIN ia ON id = src WHERE d < 5)")
add("flag_low_confidence", "lanes", lambda g: rounded(inference.flagged_confidence(inference.confidence_paths(Graph(g.nodes, g.edges.withColumn("weight", F.col("weight") / 2)), ends(g)[0], 5), 0.3), "confidence").select("id", "confidence"), f"SELECT id, {r('c')} AS confidence FROM c5 WHERE c < 0.3", BEST.replace("max(weight)", "max(weight / 2)"))
FOLLOW = "fs AS (SELECT key, next, count(*) AS n FROM (SELECT user_id % 20 AS key, lead(user_id % 20) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL AND key <> next GROUP BY ALL), hy AS (SELECT a.key AS cause, a.next AS effect, a.n, a.n / (a.n + coalesce(b.n, 0)) AS pr, (a.n + 1) / (a.n + coalesce(b.n, 0) + 2) AS cf FROM fs a LEFT JOIN fs b ON a.key = b.next AND a.next = b.key)"


def visits(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("event_type").alias("who"), F.struct("ts", "event_id").alias("ts"), (F.col("user_id") % 20).alias("key"))


add_table("causal_hypotheses", lambda s, d: rounded(inference.hypotheses(visits(s, d), 2, 0.5), "precedence", "confidence"), f"WITH {FOLLOW} SELECT cause, effect, n, {r('pr')} AS precedence, {r('cf')} AS confidence FROM hy WHERE n >= 2 AND pr >= 0.5")
add_table("materialized_hypotheses", lambda s, d: rewriting.edges_of(inference.hypotheses(visits(s, d), 2, 0.5).where("confidence >= 0.55").select(F.col("cause").cast("string").alias("src"), F.col("effect").cast("string").alias("tgt"), F.col("confidence").alias("weight")), "causal", "causes").select("edge_id", "label"), f"WITH {FOLLOW} SELECT 'causal:' || cause || ':' || effect AS edge_id, 'causes' AS label FROM hy WHERE n >= 2 AND pr >= 0.5 AND cf >= 0.55")

# versions, layers, provenance
def rolled_back(g: Graph) -> DataFrame:
    spark = g.edges.sparkSession
    path = maintenance.capture(g, folder(spark, "version"))
    changed = maintenance.remove_nodes(g, names(g, "N0"))
    return maintenance.edge_diff(changed, maintenance.version(spark, path))


add("rollback_to_version", "trade", rolled_back, "SELECT edge_id, 'added' AS change FROM edges WHERE s = 0 OR c = 0")


def snapshot(g: Graph) -> DataFrame:
    spark = g.edges.sparkSession
    path = maintenance.save_tables({"nodes": g.nodes, "degrees": g.degree}, folder(spark, "snapshot"))
    tables = maintenance.load_tables(spark, path, ["nodes", "degrees"])
    return tables["nodes"].join(tables["degrees"], "id").select("id", "label", "degree")


add("snapshot_round_trip", "orders", snapshot, "SELECT n.id, label, degree FROM nodes n JOIN degree d ON n.id = d.id")
add("layers", "trade", lambda g: rounded(maintenance.layered({"home": (g.edges.where("label = 'intra'"), 2.0), "all": (g.edges, 0.5)}), "weight").select("edge_id", "layer", "weight"), f"SELECT 'home/' || edge_id AS edge_id, 'home' AS layer, {r('weight * 2')} AS weight FROM edges WHERE label = 'intra' UNION ALL SELECT 'all/' || edge_id, 'all', {r('weight * 0.5')} FROM edges")
add("nodes_at_layer", "trade", lambda g: concepts.find(g, data={"region": "2"}).rows.select("id"), "SELECT id FROM nodes WHERE region = '2'")


def inferred(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph after reasoning, and a row for each input of an inferred edge: the first arc of the chain."""
    grown, provenance = rewriting.reason(g, "inter", 2)
    made = provenance.select("edge_id", F.split_part("edge_id", F.lit(":"), F.lit(2)).alias("src"))
    first = g.edges.where("label = 'inter'").select(F.col("edge_id").alias("input"), F.get("source_ids", F.lit(0)).alias("src"))
    return grown, made.join(first, "src").select("edge_id", "input")


INF = OWN.format(" AND label = 'inter'") + ", i1 AS (SELECT DISTINCT p.src, q.tgt FROM ow p JOIN ow q ON p.tgt = q.src WHERE p.src <> q.tgt AND NOT EXISTS (SELECT 1 FROM ow o WHERE o.src = p.src AND o.tgt = q.tgt)), i2 AS (SELECT * FROM i1 UNION SELECT p.src, q.tgt FROM i1 p JOIN ow q ON p.tgt = q.src WHERE p.src <> q.tgt AND NOT EXISTS (SELECT 1 FROM ow o WHERE o.src = p.src AND o.tgt = q.tgt))"
add("rollback_inferences", "lanes", lambda g: (lambda x: maintenance.rollback(x[0], x[1]).edges.select("edge_id"))(inferred(g)), "SELECT edge_id FROM edges")
add("retract_inference", "lanes", lambda g: (lambda x: maintenance.retract(x[0], x[1], g.edges.where("label = 'inter'").agg(F.min("edge_id").alias("edge_id"))).edges.select("edge_id"))(inferred(g)), "SELECT edge_id FROM edges WHERE edge_id <> (SELECT min(edge_id) FROM edges WHERE label = 'inter') UNION ALL SELECT 'transitive:' || src || ':' || tgt FROM i2 WHERE src <> (SELECT 'N' || s FROM edges WHERE label = 'inter' ORDER BY edge_id LIMIT 1)", INF)
add("assess_link", "lanes", lambda g: maintenance.link_impact(g, "N0", "N1"), "SELECT NOT EXISTS (SELECT 1 FROM ua WHERE id = 'N1') AS merges, EXISTS (SELECT 1 FROM h WHERE source = 'N1' AND id = 'N0') AS closes, CASE WHEN EXISTS (SELECT 1 FROM ua WHERE id = 'N1') THEN 0 ELSE least((SELECT count(*) FROM ua), (SELECT count(*) FROM ub)) END AS gained", f"{HOPS}, ua AS (SELECT 'N0' AS id UNION SELECT v FROM ua JOIN adj ON id = u), ub AS (SELECT 'N1' AS id UNION SELECT v FROM ub JOIN adj ON id = u)")
GREEDY = f"ps AS ({PARTS}), eq AS (SELECT a.id AS a, b.id AS b, row_number() OVER (ORDER BY a.id, b.id) AS k FROM ps a JOIN ps b ON a.id < b.id AND a.brand = b.brand AND a.type = b.type AND a.size = b.size), mf AS (SELECT 0 AS k, []::VARCHAR[] AS used UNION ALL SELECT mf.k + 1, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END FROM mf JOIN eq ON eq.k = mf.k + 1), mg AS (SELECT a, b FROM eq JOIN mf x ON x.k = eq.k - 1 JOIN mf y ON y.k = eq.k WHERE len(y.used) > len(x.used))"
add("merge_equivalences", "orders", lambda g: maintenance.merge_equivalences(g, 1.0, ("brand", "type", "size")).members.select("edge_id", "node_id"), "SELECT DISTINCT edge_id, coalesce(a, node_id) AS node_id FROM members LEFT JOIN mg ON node_id = b", GREEDY)

# generators
add_table("random_sets", lambda s, d: generators.random_sets(s, 14, [0.3, 0.05], 5).edges.select("edge_id"), f"SELECT e AS edge_id FROM (SELECT 'n' || a || '-n' || b AS e, 0.3 AS p FROM range(14) x(a) JOIN range(14) y(b) ON a < b UNION ALL SELECT 'n' || a || '-n' || b || '-n' || c, 0.05 FROM range(14) x(a) JOIN range(14) y(b) ON a < b JOIN range(14) z(c) ON b < c) WHERE {CHANCE.format('''concat('5:', e)''')} < p")
add_table("chung_lu", lambda s, d: generators.chung_lu(s, [float(1 + k % 7) for k in range(40)], 3).edges.select("edge_id"), f"SELECT 'n' || a || '-n' || b AS edge_id FROM range(40) x(a) JOIN range(40) y(b) ON a < b WHERE {CHANCE.format('''concat('3:', a, ':', b)''')} < least((1 + a % 7) * (1 + b % 7) / (SELECT sum(1 + k % 7) FROM range(40) t(k)), 1)")
DRAWN = f"dr AS (SELECT i, i // 2 + 1 AS own, CASE WHEN i = 0 THEN -1 ELSE floor({CHANCE.format('''concat('4:', i)''')} * 2 * i)::BIGINT END AS pos FROM range(118) t(i)), fo AS (SELECT i, own, pos FROM dr UNION ALL SELECT fo.i, fo.own, dr.pos FROM fo JOIN dr ON fo.pos > 0 AND fo.pos % 2 = 1 AND dr.i = fo.pos // 2)"
add_table("preferential_attachment_graph", lambda s, d: generators.preferential(s, 60, 2, 4).edges.select("edge_id"), f"WITH RECURSIVE {DRAWN} SELECT DISTINCT 'n' || b || '-n' || a AS edge_id FROM (SELECT own AS a, CASE WHEN pos < 0 THEN 0 ELSE pos // 4 + 1 END AS b FROM fo WHERE pos <= 0 OR pos % 2 = 0) WHERE a <> b")
add("random_shuffle", "orders", lambda g: generators.shuffled(g, 0.5, 2).members.groupBy("node_id").agg(F.count("*").alias("edges")), "SELECT node_id, count(*) AS edges FROM members GROUP BY node_id")
add_table("block_sets", lambda s, d: generators.block_sets(s, [8, 8], 3, 0.4, 0.02, 6).edges.select("edge_id"), f"SELECT e AS edge_id FROM (SELECT 'n' || a || '-n' || b || '-n' || c AS e, CASE WHEN (a < 8) = (b < 8) AND (b < 8) = (c < 8) THEN 0.4 ELSE 0.02 END AS p FROM range(16) x(a) JOIN range(16) y(b) ON a < b JOIN range(16) z(c) ON b < c) WHERE {CHANCE.format('''concat('6:', e)''')} < p")
