"""The registered queries on rules that add to a graph, and on reasoning; they add to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.inference_queries import CHAIN, STATES, states
from weft.operators import inference, rewriting, rules
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import IV, NEAR, PARTS, add, add_table, forward, intervals, names, r
from weft.sources.graphs import read


def added(g: Graph, label: str, round_: bool = True) -> DataFrame:
    """The edges of a label, sides joined; their weights are rounded unless they are already."""
    rows = g.edges.where(F.col("label") == label).select("edge_id", F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets"), "weight")
    return rounded(rows, "weight") if round_ else rows


def one(rule: str, src: str = "src", tgt: str = "tgt") -> str:
    return f"'{rule}:' || {src} || ':' || {tgt} AS edge_id, {src} AS sources, {tgt} AS targets"


OWN = "own AS (SELECT src, tgt, max(weight) AS w FROM pairs WHERE label = 'inter' AND src <> tgt GROUP BY ALL)"
add("apply_transitive", "lanes", lambda g: added(rewriting.apply_transitive(g, "inter"), "inferred"), f"SELECT {one('transitive', 'p.src', 'q.tgt')}, {r('max(least(p.w * q.w * 0.9::DOUBLE * 0.9::DOUBLE, 1))')} AS weight FROM own p JOIN own q ON p.tgt = q.src WHERE p.src <> q.tgt AND NOT EXISTS (SELECT 1 FROM arcs WHERE src = p.src AND tgt = q.tgt) GROUP BY p.src, q.tgt", OWN)
add("apply_inverse", "lanes", lambda g: added(rewriting.apply_inverse(g, "inter", "back"), "back"), f"SELECT DISTINCT {one('inverse', 'tgt', 'src')}, 1.0::DOUBLE AS weight FROM pairs WHERE label = 'inter'")
add("apply_hub", "orders", lambda g: added(rewriting.apply_hub(g, 2, 0.2), "causes"), f"SELECT {one('hub', 'p.src')}, {r('count(*) / any_value(t)')} AS weight FROM pairs p JOIN (SELECT node_id, count(*) AS t FROM inc WHERE role = 'source' GROUP BY node_id) ON p.src = node_id GROUP BY p.src, tgt HAVING count(*) >= 2 AND count(*) / any_value(t) >= 0.2")
add("apply_property", "orders", lambda g: rewriting.apply_property(g, "segment").nodes.select("id", F.col("data")["segment"].alias("segment"), F.col("data")["brand"].alias("brand")), f"SELECT n.id, coalesce(c_mktsegment, v) AS segment, p.brand FROM nodes n LEFT JOIN customer ON n.id = 'C' || c_custkey LEFT JOIN ({PARTS}) p ON n.id = p.id LEFT JOIN (SELECT tgt, min(c_mktsegment) AS v FROM pairs JOIN customer ON src = 'C' || c_custkey GROUP BY tgt) ON tgt = n.id")
add("apply_abduction", "lanes", lambda g: added(rewriting.apply_abduction(g, "inter", "intra"), "possible_cause"), "SELECT DISTINCT 'abduction:hypothesis:' || tgt || ':' || tgt AS edge_id, 'hypothesis:' || tgt AS sources, tgt AS targets, 0.5::DOUBLE AS weight FROM pairs WHERE label = 'inter' AND tgt NOT IN (SELECT tgt FROM pairs WHERE label = 'intra')")
add("apply_induction", "orders", lambda g: added(rewriting.apply_induction(g, 8), "generalizes"), "SELECT 'generalizes:category:' || label || ':' || tgt AS edge_id, 'category:' || label || ':' || tgt AS sources, string_agg(DISTINCT src, ',' ORDER BY src) AS targets, 0.7::DOUBLE AS weight FROM pairs GROUP BY label, tgt HAVING count(DISTINCT src) >= 8")
ALIKE = f"ps AS ({PARTS}), sd AS (SELECT a.id AS a, b.id AS b, 1.0::DOUBLE AS s FROM ps a JOIN ps b ON a.id < b.id AND a.brand = b.brand AND a.type = b.type AND a.size = b.size UNION ALL SELECT 'C' || x.c_custkey, 'C' || y.c_custkey, 1.0 FROM customer x JOIN customer y ON x.c_mktsegment = y.c_mktsegment AND x.c_nationkey = y.c_nationkey AND 'C' || x.c_custkey < 'C' || y.c_custkey)"
add("similar_data", "orders", lambda g: rewriting.similar_data(g, 0.8, 6), "SELECT a, b, s AS similarity FROM sd", ALIKE)
HALF = f"ps AS ({PARTS}), sh AS (SELECT a.id AS a, b.id AS b, ((a.brand = b.brand)::INT + (a.type = b.type)::INT + (a.size = b.size)::INT) / 3 AS s FROM ps a JOIN ps b ON a.id < b.id)"
add("similar_parts", "orders", lambda g: rounded(rewriting.similar_data(Graph(g.nodes.where(F.col("id").startswith("P")), g.edges), 0.6), "similarity"), f"SELECT a, b, {r('s')} AS similarity FROM sh WHERE s >= 0.6", HALF)
add("rule_generalization", "orders", lambda g: rewriting.generalizations(g, 0.8, digits=6), "SELECT a, b, s AS similarity FROM sd", ALIKE)
add("apply_generalization", "orders", lambda g: added(rewriting.apply_generalization(g, 0.8, 6), "generalizes", False), "SELECT 'generalizes:abstract:' || a || ':' || b AS edge_id, 'abstract:' || a || ':' || b AS sources, a || ',' || b AS targets, s AS weight FROM sd", ALIKE)
add("rule_substitution", "orders", lambda g: rewriting.substitutions(rewriting.apply_substitution(Graph(g.nodes.where("id < 'P'"), g.edges)), 0.8).select("a", "b"), "SELECT a, b FROM sd WHERE false", ALIKE)
add("apply_substitution", "orders", lambda g: added(rewriting.apply_substitution(g, 0.8, digits=6), "substitutes", False), f"SELECT {one('substitution', 'a', 'b')}, s AS weight FROM sd UNION ALL SELECT {one('substitution', 'b', 'a')}, s FROM sd", ALIKE)
SETS = "ls AS (SELECT node_id, list_sort(list(DISTINCT label)) AS s FROM inc WHERE role = 'source' GROUP BY node_id), an AS (SELECT a.node_id AS a, b.node_id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM ls a JOIN ls b ON a.node_id < b.node_id WHERE len(a.s) >= 2 AND len(b.s) >= 2)"
add("analogies", "orders", lambda g: rounded(rules.analogies(g), "similarity"), f"SELECT p, q, any_value(np) AS np, any_value(nq) AS nq, {r('any_value(j)')} AS similarity FROM (SELECT array_to_string(a.s, '|') AS p, array_to_string(b.s, '|') AS q, a.n AS np, b.n AS nq, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM kd a JOIN kd b ON array_to_string(a.s, '|') <= array_to_string(b.s, '|')) WHERE j >= 0.6 GROUP BY p, q", SETS + ", kd AS (SELECT s, count(*) AS n FROM ls WHERE len(s) >= 2 GROUP BY s)")
add("rule_analogy", "lanes", lambda g: rounded(rewriting.analogous_nodes(g), "similarity"), f"SELECT a, b, {r('j')} AS similarity FROM an WHERE j >= 0.6", SETS)
add("apply_analogy", "lanes", lambda g: added(rewriting.apply_analogy(g), "analogous_to"), f"SELECT {one('analogy', 'a', 'b')}, {r('j')} AS weight FROM an WHERE j >= 0.6", SETS)
SEQ = f"WITH {IV}, {NEAR.format(900)}, sq AS (SELECT a AS cause, b AS effect, gap FROM near WHERE relation IN ('before', 'meets') UNION ALL SELECT b, a, gap FROM near WHERE relation IN ('after', 'met_by'))"
add_table("rule_causal_sequence", lambda s, d: rounded(rewriting.causal_sequences(intervals(s, d), "user_id", 900.0), "gap", "confidence", digits=4), f"{SEQ} SELECT cause, effect, {r('gap', 4)} AS gap, {r('1 / (1 + gap)', 4)} AS confidence FROM sq")
add_table("apply_causal_sequence", lambda s, d: rewriting.causal_edges(rewriting.causal_sequences(intervals(s, d), "user_id", 900.0, 0.01)).select("edge_id", "label"), f"{SEQ} SELECT 'sequence:event:' || cause || ':event:' || effect AS edge_id, 'temporal_cause' AS label FROM sq WHERE 1 / (1 + gap) >= 0.01")
DEC = "nb AS (SELECT src AS hub, label, tgt AS id FROM pairs UNION SELECT tgt, label, src FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM inc WHERE edge_id = p.edge_id AND role = 'source' AND node_id = p.tgt)), gr AS (SELECT hub, nb.label, string_agg(nb.id, ',' ORDER BY nb.id) AS members FROM nb JOIN degree d ON hub = d.id AND d.degree >= 12 WHERE hub <> nb.id GROUP BY ALL HAVING count(*) >= 2), dc AS (SELECT * FROM gr WHERE hub IN (SELECT hub FROM gr GROUP BY hub HAVING count(*) >= 2))"
add("rule_decomposition", "orders", lambda g: rewriting.decompositions(g, 12).withColumn("members", F.array_join("members", ",")), "SELECT hub, label, members FROM dc", DEC)
add("apply_decomposition", "orders", lambda g: added(rewriting.apply_decomposition(g, 12), "contains"), "SELECT 'contains:part:' || hub || ':' || label AS edge_id, 'part:' || hub || ':' || label AS sources, members AS targets, 1.0::DOUBLE AS weight FROM dc", DEC)
SIM = "lv AS (SELECT * FROM st WHERE state NOT IN (SELECT parent FROM st WHERE parent IS NOT NULL) AND parent IS NOT NULL), sb AS (SELECT parent FROM lv GROUP BY parent HAVING count(*) >= 2), nn AS (SELECT DISTINCT lv.parent, unnest(nodes) AS x FROM lv JOIN sb ON lv.parent = sb.parent), sm AS (SELECT DISTINCT a.x AS a, b.x AS b FROM nn a JOIN nn b ON a.parent = b.parent AND a.x < b.x)"
add_table("rule_simultaneity", lambda s, d: rewriting.simultaneities(states(s, d)), f"WITH {STATES}, {SIM} SELECT a, b FROM sm")
add_table("apply_simultaneity", lambda s, d: rewriting.simultaneous_edges(rewriting.simultaneities(states(s, d))).select("edge_id", "label", "weight"), f"WITH {STATES}, {SIM} SELECT 'simultaneity:' || a || ':' || b AS edge_id, 'simultaneous' AS label, 1.0::DOUBLE AS weight FROM sm")
FRAMES = {"narrow": 3, "wide": 100}
CPX = "sz AS (SELECT edge_id, count(*) AS n FROM members GROUP BY edge_id), cn AS (SELECT node_id, count(*) FILTER (n <= 3) AS narrow, count(*) FILTER (n <= 100) AS wide FROM members JOIN sz USING (edge_id) GROUP BY node_id), ar AS (SELECT u AS id, v AS o FROM adj UNION ALL SELECT id, id FROM nodes), cx AS (SELECT id, avg(coalesce(narrow, 0)) AS narrow, avg(coalesce(wide, 0)) AS wide FROM ar LEFT JOIN cn ON o = node_id GROUP BY id)"
add("rule_complexity", "orders", lambda g: rounded(rewriting.frame_complexities(g, FRAMES), "complexity"), f"SELECT id, 'narrow' AS frame, {r('narrow')} AS complexity FROM cx UNION ALL SELECT id, 'wide', {r('wide')} FROM cx", CPX)
add("apply_complexity", "orders", lambda g: rewriting.apply_complexity(g, FRAMES).nodes.select("id", F.col("data")["optimal_frame"].alias("frame")), "SELECT id, CASE WHEN narrow <= wide THEN 'narrow' ELSE 'wide' END AS frame FROM cx", CPX)


def vectors(s, d) -> DataFrame:
    return read(s, d, "embeddings").select(F.concat(F.lit("N"), F.col("vec_id").cast("string")).alias("id"), "embedding")


def projected(s, d) -> DataFrame:
    from weft.sources.graphs import lanes

    g = lanes(s, d)
    return rounded(rewriting.projections(g, vectors(s, d), names(g, "N30", "N31", "N32"), "intra", 0.2), "score")


LANE = __import__("weft.sources.graphs", fromlist=["sql"]).sql
PROJ = "u AS (SELECT 'N' || vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings), ab AS (SELECT DISTINCT src AS a, tgt AS b FROM pairs WHERE label = 'intra' AND src <> tgt), q AS (SELECT a, b, c.id AS c, list_transform(list_zip(c.e, y.e, x.e), lambda z: z[1] + z[2] - z[3]) AS e FROM ab JOIN u x ON a = x.id JOIN u y ON b = y.id JOIN u c ON c.id IN ('N30', 'N31', 'N32') AND c.id <> a AND c.id <> b), sc AS (SELECT a, b, c, u.id AS d, list_cosine_similarity(q.e, u.e) AS s, row_number() OVER (PARTITION BY a, b, c ORDER BY list_cosine_similarity(q.e, u.e) DESC, u.id) AS k FROM q JOIN u ON u.id NOT IN (a, b, c))"
add_table("rule_projection", projected, LANE("lanes", f"SELECT a, b, c, d, {r('s')} AS score FROM sc WHERE k = 1 AND s >= 0.2", PROJ))
add("discover_all", "orders", lambda g: rules.discover_all(g), "SELECT 'inverse' AS kind, p.label, q.label AS other, count(*) AS n FROM own p JOIN own q ON p.src = q.tgt AND p.tgt = q.src GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT 'transitive', p.label, '', count(*) FROM own p JOIN own q ON p.label = q.label AND p.tgt = q.src WHERE p.src <> q.tgt GROUP BY p.label HAVING count(*) >= 2 UNION ALL SELECT 'hub', label, '', count(*) FROM (SELECT node_id, label FROM inc WHERE role = 'source' GROUP BY ALL HAVING count(*) >= 3) GROUP BY label", "own AS (SELECT DISTINCT label, src, tgt FROM pairs WHERE src <> tgt)")

# reasoning
add("reason", "lanes", lambda g: rounded(rewriting.reason(g, "inter")[1], "score"), f"SELECT 'transitive:' || src || ':' || tgt AS edge_id, 'transitive' AS rule, depth::BIGINT AS depth, {r('score')} AS score FROM f3 WHERE depth > 0", CHAIN)
add("reason_committed", "lanes", lambda g: rewriting.reason(g, "inter")[0].edges.select("edge_id", "label"), "SELECT 'transitive:' || src || ':' || tgt AS edge_id, 'inferred' AS label FROM f3 WHERE depth > 0 UNION ALL SELECT edge_id, label FROM edges", CHAIN)
add("reason_iterative", "lanes", lambda g: rewriting.reason(g, "inter", least=0.3)[0].edges.where("label = 'inferred'").select("edge_id"), "SELECT 'transitive:' || src || ':' || tgt AS edge_id FROM f3 WHERE depth > 0 AND score >= 0.3", CHAIN)
add("reason_incremental", "lanes", lambda g: rounded(rewriting.reason_from(g, "inter", g.nodes.where(F.col("data")["region"] == "1"), 3).where("depth > 0"), "score"), f"SELECT src, tgt, depth::BIGINT AS depth, {r('score')} AS score FROM f3 JOIN nodes ON src = id WHERE depth > 0 AND region = '1'", CHAIN)
add("reason_fused", "lanes", lambda g: rounded(rewriting.fused({"shallow": inference.forward_chain(g, "inter", 1), "deep": inference.forward_chain(g, "inter", 3), "sure": inference.forward_chain(g, "inter", 3).where("score >= 0.5")}, 0.5), "score"), f"SELECT src, tgt, count(*) AS votes, {r('avg(score)')} AS score FROM (SELECT * FROM f1 WHERE depth > 0 UNION ALL SELECT * FROM f3 WHERE depth > 0 UNION ALL SELECT * FROM f3 WHERE depth > 0 AND score >= 0.5) GROUP BY src, tgt HAVING count(*) >= 2", CHAIN)
NEG = [("inter", "no_inter"), ("no_inter", "inter")]


def denied(g: Graph) -> Graph:
    """g with a denial of each edge of label inter from N0 to N4, twice as strong where its number is even."""
    more = g.edges.where("label = 'inter' and source_ids[0] < 'N2'").select(F.concat(F.lit("no:"), "edge_id").alias("edge_id"), "source_ids", "target_ids", F.lit("no_inter").alias("label"), F.when(F.length("edge_id") % 2 == 0, F.col("weight") * 2).otherwise(F.col("weight") / 2).alias("weight"))
    return Graph(g.nodes, g.edges.unionByName(more))


DENY = "no AS (SELECT edge_id, s, c, CASE WHEN length(edge_id) % 2 = 0 THEN weight * 2 ELSE weight / 2 END AS w, weight FROM edges WHERE label = 'inter' AND 'N' || s < 'N2')"
add("contradictions", "trade", lambda g: rules.contradictions(denied(g), NEG), "SELECT edge_id AS first, 'no:' || edge_id AS second FROM no UNION ALL SELECT 'no:' || edge_id, edge_id FROM no", DENY)
add("resolve_contradictions", "trade", lambda g: rewriting.resolve(denied(g), NEG).edges.select("edge_id"), "SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM no WHERE w > weight) UNION ALL SELECT 'no:' || edge_id FROM no WHERE w > weight", DENY)
