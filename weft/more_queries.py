"""The registered queries on biconnected components, percolation, motifs, extraction, vectors, modalities, rule sets and SQLite; they add to weft.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import blocks, centrality, concepts, extraction, flows, matrices, monitor, paths, retrieval, rewriting, structure, temporal
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.algebra_queries import PART, PULL, REACH, SQ, SQUARES
from weft.queries import HOPS, IV, LINKS, NEAR, PARTS, VOTE, add, add_table, intervals, names, r
from weft.sources import files
from weft.sources.graphs import read
from weft.state_queries import VECS
from weft.structure_queries import CHANCE, folder

# cut nodes and blocks
CUT = "ap AS (SELECT x.id AS x, n.id AS s, n.id AS id FROM nodes x JOIN nodes n ON n.id <> x.id UNION SELECT x, s, a.v FROM ap JOIN adj a ON ap.id = a.u AND a.v <> x)"
add("articulation_points", "lanes", blocks.articulation_points, "SELECT DISTINCT p.u AS id FROM adj p JOIN adj q ON p.u = q.u AND p.v < q.v WHERE NOT EXISTS (SELECT 1 FROM ap WHERE x = p.u AND s = p.v AND id = q.v)", CUT)
SAME = CUT + ", ll AS (SELECT u || '~' || v AS l, u, v FROM links), en AS (SELECT l, u AS a, v AS b FROM ll UNION ALL SELECT l, v, u FROM ll), eq AS MATERIALIZED (SELECT p.l AS x, q.l AS y FROM en p JOIN en q ON p.a = q.a AND (p.b = q.b OR EXISTS (SELECT 1 FROM ap WHERE ap.x = p.a AND s = p.b AND id = q.b))), cl AS (SELECT x, y FROM eq UNION SELECT cl.x, eq.y FROM cl JOIN eq ON cl.y = eq.x), bk AS (SELECT x AS l, min(y) AS b FROM cl GROUP BY x)"
add("biconnected_components", "lanes", lambda g: blocks.biconnected(g).groupBy("block").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("members")).select("members"), "SELECT string_agg(DISTINCT n, ',' ORDER BY n) AS members FROM (SELECT b, unnest([u, v]) AS n FROM bk JOIN ll ON bk.l = ll.l) GROUP BY b", SAME)

# centrality, motifs, spectra
PATHS = f"{HOPS}, mult AS (SELECT src, tgt, count(*) AS m FROM pairs WHERE src <> tgt GROUP BY ALL), sp0 AS (SELECT source, id, d, 1::DOUBLE AS p FROM h WHERE d = 0)" + "".join(f", sp{k} AS MATERIALIZED (SELECT h.source, h.id, h.d, sum(p * m) AS p FROM h JOIN mult ON tgt = h.id JOIN sp{k - 1} q ON q.source = h.source AND q.id = src WHERE h.d = {k} GROUP BY ALL)" for k in range(1, 25)) + ", sp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM sp{k}" for k in range(25)) + "), xs AS (SELECT id, substr(id, 2)::DOUBLE / 25 AS x FROM nodes)"
add("percolation_centrality", "lanes", lambda g: rounded(centrality.percolation(g, g.nodes.select("id", (F.substring("id", 2, 9).cast("double") / 25).alias("x"))), "score"), f"SELECT n.id, {r('coalesce(any_value(y.w), 0) / ((SELECT sum(x) FROM xs) - any_value(n.x)) / ((SELECT count(*) FROM nodes) - 2)')} AS score FROM xs n LEFT JOIN (SELECT a.id, sum(a.p * b.p / t.p * z.x) AS w FROM sp a JOIN sp b ON b.source = a.id AND a.source <> a.id AND b.id <> a.id AND b.id <> a.source JOIN sp t ON t.source = a.source AND t.id = b.id AND t.d = a.d + b.d JOIN xs z ON z.id = a.source GROUP BY a.id) y ON n.id = y.id GROUP BY n.id", PATHS)
TRIAD = "tr AS (SELECT a.id AS a, b.id AS b, c.id AS c FROM nodes a JOIN nodes b ON a.id < b.id JOIN nodes c ON b.id < c.id), tn AS (SELECT a, b, c, (SELECT list(src) FROM arcs WHERE src IN (a, b, c) AND tgt IN (a, b, c)) AS o, (SELECT list(tgt) FROM arcs WHERE src IN (a, b, c) AND tgt IN (a, b, c)) AS i, (SELECT count(DISTINCT least(src, tgt) || greatest(src, tgt)) FROM arcs WHERE src IN (a, b, c) AND tgt IN (a, b, c)) AS k FROM tr)"
add("directed_motifs", "lanes", structure.directed_motifs, "SELECT motif, count(*) AS n FROM (SELECT array_to_string(list_sort(list_transform([a, b, c], lambda x: len(list_filter(o, lambda y: y = x)) || '/' || len(list_filter(i, lambda y: y = x)))), ' ') AS motif FROM tn WHERE k >= 2) GROUP BY motif", TRIAD)
add("algebraic_connectivity", "trade", lambda g: rounded(flows.algebraic_connectivity(g, 12), "value"), f"SELECT {r('sum(shared * (a.x - b.x) * (a.x - b.x)) / (SELECT sum(x * x) FROM fv12)')} AS value FROM links JOIN fv12 a ON u = a.id JOIN fv12 b ON v = b.id", PULL)

# text
WORDS = ["of", "in", "der", "de", "la", "el"]
PATTERN = rf"(\w+) ({'|'.join(WORDS)}) (\w+)"
REL = f"rl AS (SELECT doc_id, unnest(regexp_extract_all(t, '{PATTERN}', 1)) AS source, unnest(regexp_extract_all(t, '{PATTERN}', 2)) AS relation, unnest(regexp_extract_all(t, '{PATTERN}', 3)) AS target FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL AND lang = 'en'))"


def english(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("lang = 'en'")


add_table("extract_relations", lambda s, d: extraction.relations(english(s, d), WORDS), f"WITH {REL} SELECT doc_id, source, relation, target FROM rl")
add_table("extraction_confidence", lambda s, d: rounded(extraction.confidence(extraction.relations(english(s, d), WORDS)), "confidence"), f"WITH {REL} SELECT source, relation, target, count(*) AS n, {r('1 - 1 / (count(*) + 1)')} AS confidence FROM rl GROUP BY ALL")


def ingested(s: SparkSession, d: str) -> DataFrame:
    from weft.sources.graphs import lanes

    g = extraction.ingest(lanes(s, d), extraction.relations(english(s, d), WORDS), 0.6)
    return rounded(g.edges.where(F.col("label").isin(*WORDS)), "weight").select("edge_id", "label", "weight")


add_table("ingest", ingested, f"WITH {REL} SELECT relation || ':' || source || ':' || target AS edge_id, relation AS label, {r('1 - 1 / (count(*) + 1)')} AS weight FROM rl GROUP BY source, relation, target HAVING 1 - 1 / (count(*) + 1) >= 0.6")

# vectors
add_table("similar_pairs", lambda s, d: rounded(retrieval.similar_pairs(read(s, d, "embeddings"), 0.3), "cosine"), f"WITH {VECS} SELECT a.vec_id AS a, b.vec_id AS b, {r('list_inner_product(a.e, b.e)')} AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.3")
add_table("semantic_edges", lambda s, d: rounded(retrieval.semantic_edges(read(s, d, "embeddings"), 3, 0.2), "weight"), f"WITH {VECS}, p AS (SELECT a.vec_id AS src, b.vec_id AS tgt, list_inner_product(a.e, b.e) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, tgt) AS k FROM p) SELECT src, tgt, {r('c')} AS weight FROM k WHERE k <= 3 AND c >= 0.2")
HASHED = ", ".join("2 * " + CHANCE.format(f"concat('7:{k}:', text)") + " - 1" for k in range(4))
add("hash_embedding", "trade", lambda g: rounded(retrieval.hash_vectors(g.nodes.select("id", F.col("label").alias("text")), 4, 7).select("id", F.posexplode("embedding").alias("place", "x")).withColumn("place", F.col("place").cast("bigint")), "x"), f"SELECT id, place::BIGINT AS place, {r('e[place + 1] / sqrt(list_inner_product(e, e))')} AS x FROM (SELECT id, [{HASHED}] AS e FROM (SELECT id, label AS text FROM nodes)), range(4) t(place)")

# modalities: the words of a part's type
TAGS = f"tg AS (SELECT id AS tgt, unnest(list_distinct(string_split_regex(type, '[\\s,]+'))) AS tag FROM ({PARTS})), pf AS (SELECT src AS id, tag, count(*) AS n, sum(weight) AS w FROM pairs JOIN tg ON pairs.tgt = tg.tgt GROUP BY src, tag)"
add("modality_coverage", "orders", lambda g: rounded(retrieval.modality_profile(g, "type"), "weight"), f"SELECT id, tag, n, {r('w')} AS weight FROM pf", TAGS)
add("modality_gaps", "orders", lambda g: retrieval.modality_gaps(g, g.nodes.where("id < 'D'"), "type", ["ECONOMY", "STANDARD"]), "SELECT n.id, t.tag FROM nodes n, (SELECT unnest(['ECONOMY', 'STANDARD']) AS tag) t WHERE n.id < 'D' AND NOT EXISTS (SELECT 1 FROM pf WHERE pf.id = n.id AND pf.tag = t.tag)", TAGS)
add("cross_modality_edges", "trade", lambda g: retrieval.cross_modality_edges(g, "region"), "SELECT src AS id, count(DISTINCT edge_id) AS n FROM pairs JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE a.region <> b.region GROUP BY src")
FUSE = "SELECT id, {} AS score FROM (SELECT id, CASE tag WHEN 'ECONOMY' THEN 2 ELSE 1 END::DOUBLE / (60 + row_number() OVER (PARTITION BY tag ORDER BY round(w, 9) DESC, id)) AS x FROM pf WHERE tag IN ('ECONOMY', 'STANDARD') AND id < 'C5') GROUP BY id"
add("modality_fusion", "orders", lambda g: rounded(retrieval.fuse_modalities(g, g.nodes.where("id < 'C5'"), "type", {"ECONOMY": 2.0, "STANDARD": 1.0}), "score", digits=8), FUSE.format(r("sum(x)", 8)), TAGS)
add_table("decay_all", lambda s, d: rounded(retrieval.recency(read(s, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"))).withColumn("score", F.col("score") * 0.9), "score"), f"SELECT user_id AS id, {r('0.9 * least(sum(pow(0.9::DOUBLE, k - 1)), 100)')} AS score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY user_id")

# rule sets
SPECS = [{"kind": "inverse", "label": "inter", "inverse_label": "back"}, {"kind": "abduction", "effect": "inter", "explained": "intra"}]


def by_rules(g: Graph) -> DataFrame:
    specs = rewriting.deserialize_rules(rewriting.serialize_rules(SPECS))
    return rewriting.apply_rules(g, specs, 2).edges.select("edge_id", "label")


add("apply_rules", "lanes", by_rules, "SELECT edge_id, label FROM edges UNION ALL SELECT DISTINCT 'inverse:' || tgt || ':' || src, 'back' FROM pairs WHERE label = 'inter' UNION ALL SELECT DISTINCT 'abduction:hypothesis:' || tgt || ':' || tgt, 'possible_cause' FROM pairs WHERE label = 'inter' AND tgt NOT IN (SELECT tgt FROM pairs WHERE label = 'intra')")
add_table("rule_specifications", lambda s, d: s.createDataFrame([(rewriting.serialize_rules(rewriting.deserialize_rules(rewriting.serialize_rules(SPECS))),)], "rules string"), """SELECT '[{"inverse_label": "back", "kind": "inverse", "label": "inter"}, {"effect": "inter", "explained": "intra", "kind": "abduction"}]' AS rules""")

# views
FRAMES = {"near": (1, False), "ahead": (3, True), "wide": (3, False)}
FRAME = f"{HOPS}, uh AS (SELECT 'N3' AS id, 0 AS d UNION SELECT v, d + 1 FROM uh JOIN adj ON id = u WHERE d < 3), fr AS (SELECT 'ahead' AS frame, id, d FROM h WHERE source = 'N3' AND d <= 3 UNION ALL SELECT 'wide', id, min(d) FROM uh GROUP BY id UNION ALL SELECT 'near', id, min(d) FROM uh GROUP BY id HAVING min(d) <= 1)"
add("multi_frame_analysis", "lanes", lambda g: rounded(monitor.perspectives(g, names(g, "N3"), FRAMES), "density"), f"SELECT frame, count(*) AS reach, max(d)::BIGINT AS far, {r('CASE WHEN count(*) > 1 THEN 2 * (SELECT count(*) FROM links l WHERE EXISTS (SELECT 1 FROM fr a WHERE a.frame = f.frame AND a.id = l.u) AND EXISTS (SELECT 1 FROM fr b WHERE b.frame = f.frame AND b.id = l.v)) / (count(*) * (count(*) - 1)) ELSE 0 END')} AS density FROM fr f GROUP BY frame", FRAME)
add_table("temporal_query", lambda s, d: temporal.close_pairs(intervals(s, d), 1.0, "user_id").select("a", "b"), f"WITH {IV}, {NEAR.format(1)} SELECT a, b FROM near")


# SQLite
def stored(g: Graph) -> DataFrame:
    import os

    spark = g.edges.sparkSession
    path = folder(spark, "sqlite").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    files.write_sqlite(g, path)
    back = files.read_sqlite(spark, path)
    return back.members.join(back.nodes.select(F.col("id").alias("node_id"), F.col("label").alias("name")), "node_id").select("edge_id", "node_id", "name")


add("sqlite_round_trip", "lanes", stored, "SELECT edge_id, node_id, n.label AS name FROM members m JOIN nodes n ON node_id = id")


# a sparse graph that grows with the data
FROM = "hop AS (SELECT id AS source, id, 0 AS d FROM nodes WHERE id IN ('C1', 'C2', 'C4') UNION SELECT source, tgt, d + 1 FROM hop JOIN arcs ON id = src WHERE d < 40), h AS MATERIALIZED (SELECT source, id, min(d)::BIGINT AS d FROM hop GROUP BY source, id)"
THREE = ("C1", "C2", "C4")
add("handover_hops", "handover", lambda g: paths.hops(g, names(g, *THREE)), "SELECT * FROM h", FROM)
add("handover_recall", "handover", lambda g: concepts.recall(g, names(g, *THREE), 3, 200, directed=True), "SELECT id, min(d)::BIGINT AS depth FROM h WHERE d <= 3 GROUP BY id ORDER BY 2, 1 LIMIT 200", FROM)
COST = "co AS MATERIALIZED (SELECT src, tgt, min(1 / greatest(weight, 1e-9)) AS cost FROM pairs WHERE src <> tgt GROUP BY ALL), g0 AS (SELECT id, 0::DOUBLE AS d FROM nodes WHERE id = 'C1')" + "".join(f", g{k + 1} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM g{k} UNION ALL SELECT tgt, d + cost FROM g{k} JOIN co ON id = src) GROUP BY id)" for k in range(40))
add("handover_distances", "handover", lambda g: rounded(paths.distances(g, names(g, "C1")), "d").select("id", "d"), f"SELECT id, {r('d')} AS d FROM g40", COST)
add("handover_strong_components", "handover", paths.strong_components, "SELECT id, least(id, coalesce(min(a.tgt), id)) AS component FROM nodes LEFT JOIN (rc a JOIN rc b ON a.src = b.tgt AND a.tgt = b.src) ON a.src = id GROUP BY id", REACH)
add("handover_components", "handover", paths.connected_components, "SELECT id, c AS component FROM cp25", PART)
add("handover_communities", "handover", paths.label_propagation, "SELECT id, c AS community FROM lp5", VOTE)
add("handover_links", "handover", lambda g: rounded(matrices.link_prediction(g), "jaccard", "adamic_adar", "resource_allocation"), LINKS)
add("handover_squares", "handover", lambda g: rounded(structure.square_clustering(g), "value"), SQUARES, SQ)
add("handover_blocks", "handover", lambda g: blocks.biconnected(g).groupBy("block").agg(F.countDistinct("id").alias("n")).agg(F.sum(F.col("n") - 1).alias("links"), F.count("*").alias("blocks")).select("links"), "SELECT (SELECT count(*) FROM nodes) - count(DISTINCT c) AS links FROM cp25", PART)
add("handover_layers", "handover", lambda g: paths.levels(Graph(g.nodes, g.edges.where("source_ids[0] < target_ids[0]"))).groupBy("level").agg(F.count("*").alias("n")), "SELECT d AS level, count(*) AS n FROM (SELECT id, max(d)::BIGINT AS d FROM lv GROUP BY id) GROUP BY d", "fw AS MATERIALIZED (SELECT * FROM arcs WHERE src < tgt), lv AS (SELECT id, 0 AS d FROM nodes UNION SELECT tgt, d + 1 FROM lv JOIN fw ON id = src)")
add("handover_path", "handover", lambda g: rounded(paths.shortest_path(g, "C1", "C2").where("id = 'C2'"), "d").select("id", "d"), f"SELECT id, {r('d')} AS d FROM g40 WHERE id = 'C2'", COST)
