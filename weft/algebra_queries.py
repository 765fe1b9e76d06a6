"""The registered queries on matrices, line graphs, simplices, paths and components beyond those of weft.queries, to which they add."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import centrality, matrices, paths, structure
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import FLOW, HOPS, ORACLES, OVER, SHARED, TRI, _rounds, add, r
from weft.sources.graphs import sql
from weft.structure_queries import CHANCE, CLIQUE, FOLD, SEEDED

# matrices
add("incidence_unsigned", "orders", matrices.unsigned_incidence, "SELECT edge_id, node_id AS id, 1::BIGINT AS value FROM members")
add("incidence_by_order", "orders", lambda g: matrices.unsigned_incidence(g, 3), "SELECT edge_id, node_id AS id, 1::BIGINT AS value FROM members WHERE edge_id IN (SELECT edge_id FROM members GROUP BY edge_id HAVING count(*) = 4)")
add("normalized_laplacian", "orders", lambda g: rounded(matrices.normalized_laplacian(g), "value", digits=9), f"SELECT i, j, {r('(CASE WHEN i = j THEN a.d ELSE 0 END - w) / sqrt(a.d * b.d)', 9)} AS value FROM fl JOIN dd a ON i = a.node_id JOIN dd b ON j = b.node_id", FLOW + ", dd AS (SELECT node_id, sum(weight) AS d FROM members GROUP BY node_id HAVING sum(weight) > 0)")
add("multiorder_laplacian", "orders", lambda g: rounded(matrices.multiorder_laplacian(g, {1: 1.0, 3: 0.5}), "value"), f"SELECT a.node_id AS i, b.node_id AS j, {r('-sum(CASE n WHEN 2 THEN 1 ELSE 0.5::DOUBLE END)')} AS value FROM members a JOIN members b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id JOIN sz ON a.edge_id = sz.edge_id WHERE n IN (2, 4) GROUP BY a.node_id, b.node_id", "sz AS (SELECT edge_id, count(*) AS n FROM members GROUP BY edge_id)")
add("stationary_state", "orders", lambda g: rounded(matrices.stationary(g), "p", digits=9), f"SELECT id, {r('coalesce(w, 0) / (SELECT sum(weight) FROM members)', 9)} AS p FROM nodes LEFT JOIN (SELECT node_id, sum(weight) AS w FROM members GROUP BY node_id) ON id = node_id")
add("bipartite_graph", "orders", matrices.bipartite, "SELECT node_id AS u, edge_id AS v, role AS kind FROM inc")
SIMP = "sx AS (SELECT id AS ids, 0 AS dim FROM nodes UNION ALL SELECT u || ',' || v, 1 FROM links)"
add("hodge_matrix", "lanes", lambda g: matrices.boundaries_of(structure.simplices(g)), "SELECT u || ',' || v AS simplex, unnest([v, u]) AS face, unnest([1, -1])::BIGINT AS sign, 1::BIGINT AS dimension FROM links")
add("hodge_laplacian_0", "lanes", lambda g: matrices.hodge_laplacian(structure.simplices(g), 0), "SELECT id AS i, id AS j, k AS value FROM nbr WHERE k > 0 UNION ALL SELECT u, v, -1 FROM adj")
add("hodge_laplacian_1", "lanes", lambda g: matrices.hodge_laplacian(structure.simplices(g), 1), "SELECT a.s AS i, b.s AS j, sum(a.g * b.g)::BIGINT AS value FROM bd a JOIN bd b ON a.f = b.f GROUP BY a.s, b.s HAVING sum(a.g * b.g) <> 0", "bd AS (SELECT u || ',' || v AS s, unnest([v, u]) AS f, unnest([1, -1]) AS g FROM links)")
add("face_enumeration", "lanes", lambda g: matrices.faces_of(structure.simplices(g), ["N0"]), "SELECT least(u, v) || ',' || greatest(u, v) AS ids, 'coface' AS relation FROM adj WHERE u = 'N0'")
add("simpliciality", "orders", lambda g: rounded(matrices.simpliciality(g), "value"), f"SELECT {r('coalesce(avg(w::INT), 1)')} AS value FROM (SELECT m, bool_and(list_contains((SELECT list(m) FROM (SELECT DISTINCT m FROM ms)), array_to_string(list_filter(l, lambda y: y <> x), ','))) AS w FROM (SELECT DISTINCT m, l, unnest(l) AS x FROM ms WHERE len(l) >= 3) GROUP BY m)", "ms AS (SELECT string_agg(node_id, ',' ORDER BY node_id) AS m, list(node_id ORDER BY node_id) AS l FROM members GROUP BY edge_id)")
WALKS = "wa0 AS (SELECT id AS s, id, 1::DOUBLE AS x FROM nodes)" + "".join(f", wa{k} AS MATERIALIZED (SELECT s, v AS id, sum(x * shared) / {k} AS x FROM wa{k - 1} JOIN adj ON id = u GROUP BY s, v)" for k in range(1, 17))
add("subgraph_centrality", "lanes", lambda g: rounded(matrices.walk_counts(g), "score"), f"SELECT id, {r('sum(x)')} AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM wa{k} WHERE s = id" for k in range(17)) + ") GROUP BY id", WALKS)
add("katz_solved", "lanes", lambda g: rounded(centrality.katz_solved(g), "score"), f"SELECT id, {r('s / sqrt((SELECT sum(s * s) FROM kz40))')} AS score FROM kz40", "kz0 AS (SELECT id, 1::DOUBLE AS s FROM nodes)" + "".join(f", kz{k + 1} AS MATERIALIZED (SELECT n.id, 0.1::DOUBLE * coalesce(g, 0) + 1 AS s FROM nodes n LEFT JOIN (SELECT u, sum(shared * s) AS g FROM adj JOIN kz{k} z ON v = z.id GROUP BY u) ON n.id = u)" for k in range(40)))
add("c_eigenvector", "lanes", lambda g: rounded(centrality.eigenvector(g, 5), "score"), f"SELECT id, {r('s')} AS score FROM p5", _rounds(5, "g", "sqrt(sum(s * s))", SHARED))

# line graphs
LINE = OVER + ", oo AS MATERIALIZED (SELECT e1, e2 FROM ov UNION ALL SELECT e2, e1 FROM ov), hop AS (SELECT edge_id AS source, edge_id AS id, 0 AS d FROM edges UNION SELECT source, e2, d + 1 FROM hop JOIN oo ON id = e1 WHERE d < 30), h AS MATERIALIZED (SELECT source, id, min(d)::BIGINT AS d FROM hop GROUP BY source, id)"
add("s_distance_matrix", "lanes", paths.s_distance_matrix, "SELECT * FROM h", LINE)
add("s_walk_closeness", "lanes", lambda g: rounded(centrality.s_walk_closeness(g), "score"), f"SELECT source AS id, {r('CASE WHEN sum(d) > 0 THEN (count(*) - 1) / (((SELECT count(*) FROM edges) - 1) * sum(d)) ELSE 0 END')} AS score FROM h GROUP BY source", LINE)
COUNTS = LINE + ", sp0 AS (SELECT source, id, d, 1::DOUBLE AS p FROM h WHERE d = 0)" + "".join(f", sp{k} AS MATERIALIZED (SELECT h.source, h.id, h.d, sum(p) AS p FROM h JOIN oo ON e2 = h.id JOIN sp{k - 1} q ON q.source = h.source AND q.id = e1 WHERE h.d = {k} GROUP BY ALL)" for k in range(1, 30)) + ", sp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM sp{k}" for k in range(30)) + ")"
add("s_walk_betweenness", "lanes", lambda g: rounded(centrality.s_walk_betweenness(g), "score"), f"SELECT n.edge_id AS id, {r('coalesce(sum(x), 0) / (((SELECT count(*) FROM edges) - 1) * ((SELECT count(*) FROM edges) - 2))')} AS score FROM edges n LEFT JOIN (SELECT a.id, a.p * b.p / t.p AS x FROM sp a JOIN sp b ON b.source = a.id AND a.source <> a.id AND b.id <> a.id AND b.id <> a.source JOIN sp t ON t.source = a.source AND t.id = b.id AND t.d = a.d + b.d) y ON n.edge_id = y.id GROUP BY n.edge_id", COUNTS)
add("s_components_by_size", "orders", lambda g: paths.component_sizes(paths.s_components(g, 2).withColumnRenamed("edge_id", "id"), 2), "SELECT component, count(*) AS size FROM (SELECT e.edge_id, least(e.edge_id, coalesce(min(b), e.edge_id)) AS component FROM edges e LEFT JOIN con ON e.edge_id = a GROUP BY e.edge_id) GROUP BY component HAVING count(*) >= 2", f"{OVER}, big2 AS (SELECT e1 AS a, e2 AS b FROM ov WHERE shared >= 2 UNION ALL SELECT e2, e1 FROM ov WHERE shared >= 2), con AS (SELECT a, b FROM big2 UNION SELECT con.a, big2.b FROM con JOIN big2 ON con.b = big2.a)")

# paths and components
UHOP = "uh AS (SELECT id AS source, id, 0 AS d FROM nodes UNION SELECT source, v, d + 1 FROM uh JOIN adj ON id = u WHERE d < 25), um AS (SELECT source, id, min(d) AS d FROM uh GROUP BY source, id)"
add("wiener_index", "lanes", paths.wiener, "SELECT count(*) AS pairs, coalesce(sum(d), 0)::BIGINT AS value FROM um WHERE source < id", UHOP)
SIMPLE = "cs AS (SELECT src, tgt, min(1 / greatest(weight, 1e-9)) AS cost FROM pairs WHERE src <> tgt GROUP BY ALL), en AS (SELECT (SELECT min(src) FROM cs) AS a, (SELECT max(id) FROM h WHERE source = (SELECT min(src) FROM cs)) AS b), wk AS (SELECT [src, tgt] AS p, [0, cost] AS c, tgt AS e FROM cs, en WHERE src = a UNION ALL SELECT list_append(p, tgt), list_append(c, c[-1] + cost), tgt FROM wk JOIN cs ON e = src, en WHERE e <> b AND NOT list_contains(p, tgt)), bw AS (SELECT p, c FROM wk, en WHERE e = b ORDER BY c[-1], p LIMIT 1)"


def far(g: Graph) -> tuple[str, str]:
    """The smallest node that has arcs, and the largest that it reaches."""
    source = g.arcs.agg(F.min("src")).first()[0]
    return source, paths.hops(g, g.nodes.where(F.col("id") == source)).agg(F.max("id")).first()[0]


add("shortest_path", "lanes", lambda g: rounded(paths.shortest_path(g, *far(g)), "d"), f"SELECT unnest(range(len(p)))::BIGINT AS place, unnest(p) AS id, {r('unnest(c)')} AS d FROM bw", f"{HOPS}, {SIMPLE}")
PART = "cp0 AS (SELECT id, id AS c FROM nodes)" + "".join(f", cp{k + 1} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT * FROM cp{k} UNION ALL SELECT u, c FROM adj JOIN cp{k} ON v = id) GROUP BY id)" for k in range(25))
add("is_connected", "lanes", paths.is_connected, "SELECT count(DISTINCT c) AS components, count(DISTINCT c) = 1 AS connected FROM cp25", PART)
add("largest_component", "lanes", paths.largest_component, "SELECT id FROM cp25 WHERE c = (SELECT c FROM cp25 GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)", PART)
add("component_of", "lanes", lambda g: paths.component_of(g, "N3"), "SELECT id FROM cp25 WHERE c = (SELECT c FROM cp25 WHERE id = 'N3')", PART)
REACH = "rc AS (SELECT src, tgt FROM arcs UNION SELECT rc.src, arcs.tgt FROM rc JOIN arcs ON rc.tgt = arcs.src)"
add("acyclic", "lanes", paths.acyclic, "SELECT NOT EXISTS (SELECT 1 FROM rc WHERE src = tgt) AS dag, EXISTS (SELECT 1 FROM rc WHERE src = tgt) OR EXISTS (SELECT 1 FROM pairs WHERE src = tgt) AS has_cycle", REACH)
KRUSKAL = "ko AS MATERIALIZED (SELECT row_number() OVER (ORDER BY weight, edge_id) AS k, s::INT + 1 AS a, c::INT + 1 AS b, edge_id FROM edges WHERE s <> c), kf AS (SELECT 0 AS k, range(25) AS l UNION ALL SELECT kf.k + 1, list_transform(l, lambda x: CASE WHEN x = greatest(l[a], l[b]) THEN least(l[a], l[b]) ELSE x END) FROM kf JOIN ko ON ko.k = kf.k + 1), ks AS (SELECT edge_id, a - 1 AS a, b - 1 AS b FROM ko JOIN kf ON kf.k = ko.k - 1 WHERE l[a] <> l[b])"
add("minimum_spanning_edges", "lanes", paths.minimum_spanning_edges, "SELECT edge_id FROM ks", KRUSKAL)
add("minimum_spanning_tree", "trade", paths.spanning_pairs, "SELECT least('N' || a, 'N' || b) AS u, greatest('N' || a, 'N' || b) AS v FROM ks", KRUSKAL)
add("tree_center", "lanes", lambda g: paths.tree_center(Graph(g.nodes.where("id in ('N0', 'N1', 'N2', 'N3')"), g.edges.sparkSession.createDataFrame([("a", ["N0"], ["N1"], "x", 1.0), ("b", ["N1"], ["N2"], "x", 1.0), ("c", ["N2"], ["N3"], "x", 1.0)], "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"))), "SELECT unnest(['N1', 'N2']) AS id")

# structure
SQ = "cm AS (SELECT a.v AS a, b.v AS b, count(*) - 1 AS q FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v GROUP BY a.v, b.v), po AS (SELECT a, b, q, x.k - (1 + q + t) + y.k - (1 + q + t) + q AS p FROM (SELECT cm.*, (l.u IS NOT NULL)::INT AS t FROM cm LEFT JOIN links l ON l.u = a AND l.v = b) JOIN nbr x ON x.id = a JOIN nbr y ON y.id = b)"
SQUARES = f"SELECT n.id, {r('CASE WHEN sum(p) > 0 THEN sum(q) / sum(p) ELSE 0 END')} AS value FROM nodes n LEFT JOIN (SELECT a.u AS id, q, p FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v JOIN po ON po.a = a.v AND po.b = b.v) x ON n.id = x.id GROUP BY n.id"
add("square_clustering", "lanes", lambda g: rounded(structure.square_clustering(g), "value"), SQUARES, SQ)
CYC = "cy AS (SELECT [src, tgt] AS p, tgt AS e FROM arcs WHERE src < tgt UNION ALL SELECT list_append(p, tgt), tgt FROM cy JOIN arcs ON e = src WHERE len(p) < 5 AND tgt > p[1] AND NOT list_contains(p, tgt)), cl AS (SELECT p FROM cy JOIN arcs ON e = src AND tgt = p[1]), ch AS (SELECT DISTINCT p FROM (SELECT p, i, j FROM cl, range(1, 6) x(i), range(1, 6) y(j) WHERE len(p) > 3 AND i + 1 < j AND j <= len(p) AND NOT (i = 1 AND j = len(p))) JOIN arcs ON (src = p[i] AND tgt = p[j]) OR (src = p[j] AND tgt = p[i]))"
add("chordless_cycles", "lanes", lambda g: structure.chordless_cycles(g).select(F.array_join("path", ",").alias("path"), "hops"), "SELECT array_to_string(p, ',') AS path, len(p)::BIGINT AS hops FROM cl WHERE p NOT IN (SELECT p FROM ch)", CYC)
COLORS = FOLD.format("k DESC, id") + ", ff AS (SELECT 0 AS k, []::BIGINT[] AS s UNION ALL SELECT ff.k + 1, list_append(s, list_min(list_filter(range(0, 1000), lambda x: NOT list_contains(list_transform(coalesce(e, []), lambda i: s[i]), x)))) FROM ff JOIN fe ON fe.k = ff.k + 1)"
add("chromatic_number", "lanes", structure.chromatic_number, "SELECT count(DISTINCT x)::BIGINT AS colors FROM (SELECT unnest(s) AS x FROM (SELECT s FROM ff ORDER BY k DESC LIMIT 1))", COLORS)
add("dominating_set", "lanes", structure.dominating_set, "SELECT id FROM mis", SEEDED)
add("max_clique", "lanes", structure.largest_clique, "SELECT array_to_string(list_sort(c), ',') AS clique FROM cq ORDER BY len(c) DESC, 1 LIMIT 1", CLIQUE)
add("isomorphism_signature", "orders", structure.signature, "SELECT k, t AS triangles, count(*) AS n FROM cc GROUP BY k, t", TRI)


def renamed(g: Graph) -> Graph:
    """g with other ids."""
    name = lambda x: F.concat(F.lit("x"), F.reverse(x))
    sides = {c: F.transform(c, name) for c in ("source_ids", "target_ids")}
    return Graph(g.nodes.withColumn("id", name(F.col("id"))), g.edges.withColumns(sides))


add("could_be_isomorphic", "lanes", lambda g: structure.could_be_isomorphic(g, renamed(g)), "SELECT true AS possible")


# SQL of queries that other modules register
def also(name: str, kind: str, body: str, more: str = "") -> None:
    ORACLES[name] = sql(kind, body, more)


NBR = "mp AS MATERIALIZED (SELECT map(list(id), list(n)) AS m FROM (SELECT nodes.id, coalesce(list(v) FILTER (v IS NOT NULL), []) AS n FROM nodes LEFT JOIN adj ON nodes.id = u GROUP BY nodes.id))"
LEVELS = OVER + ", ks AS (SELECT unnest(range(1, (SELECT max(shared) + 1 FROM ov)))::BIGINT AS s), bg AS MATERIALIZED (SELECT s, e1 AS a, e2 AS b FROM ov, ks WHERE shared >= s UNION ALL SELECT s, e2, e1 FROM ov, ks WHERE shared >= s), cn AS (SELECT s, a, b FROM bg UNION SELECT cn.s, cn.a, bg.b FROM cn JOIN bg ON cn.s = bg.s AND cn.b = bg.a), co AS (SELECT ks.s, e.edge_id, least(e.edge_id, coalesce(min(b), e.edge_id)) AS c FROM ks CROSS JOIN edges e LEFT JOIN cn ON cn.s = ks.s AND cn.a = e.edge_id GROUP BY ks.s, e.edge_id)"
also("s_persistence", "lanes", "SELECT s, count(*) AS components, max(n) AS largest FROM (SELECT s, c, count(*) AS n FROM co GROUP BY s, c) GROUP BY s", LEVELS)
TESTS = f"{PART}, {REACH}, pc AS (SELECT c, count(*) AS n, (SELECT count(*) FROM links JOIN cp25 y ON u = y.id WHERE y.c = x.c) AS m FROM cp25 x GROUP BY c), ts AS (SELECT (SELECT count(*) FROM pc) AS components, (SELECT bool_and(m = n - 1) FROM pc) AS forest, (SELECT sum(k % 2) FROM nbr) AS odd, EXISTS (SELECT 1 FROM pairs WHERE src = tgt) AS loops, NOT EXISTS (SELECT 1 FROM rc WHERE src = tgt) AS dag)"
also("structure_tests", "lanes", "SELECT components, components = 1 AS connected, components = 1 AND forest AS tree, forest, components = 1 AND odd = 0 AS eulerian, components = 1 AND odd IN (0, 2) AS eulerian_path, loops, dag FROM ts", TESTS)
BRIDGE = "br AS (SELECT u, v, u AS id FROM links UNION SELECT br.u, br.v, a.v FROM br JOIN adj a ON br.id = a.u AND NOT (a.u = br.u AND a.v = br.v) AND NOT (a.u = br.v AND a.v = br.u)), bb AS MATERIALIZED (SELECT u, v FROM links l WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.u = l.u AND br.v = l.v AND br.id = l.v))"
also("bridges", "trade", "SELECT u, v FROM bb", BRIDGE)
STRONG = BRIDGE + ", sa AS MATERIALIZED (SELECT u, v FROM adj x WHERE NOT EXISTS (SELECT 1 FROM bb WHERE (bb.u = x.u AND bb.v = x.v) OR (bb.u = x.v AND bb.v = x.u))), sc AS (SELECT id, id AS o FROM nodes UNION SELECT sc.id, sa.v FROM sc JOIN sa ON o = u)"
also("two_edge_components", "trade", "SELECT id, min(o) AS component FROM sc GROUP BY id", STRONG)
VOTES = "vo0 AS (SELECT id, 1::DOUBLE AS vote, NULL::BIGINT AS rank FROM nodes)" + "".join(f", vt{k} AS MATERIALIZED (SELECT u AS id FROM adj JOIN vo{k - 1} v ON v = v.id AND v.vote > 0 JOIN vo{k - 1} w ON u = w.id AND w.rank IS NULL GROUP BY u ORDER BY round(sum(v.vote), 9) DESC, u LIMIT 1), vo{k} AS MATERIALIZED (SELECT id, CASE WHEN id IN (SELECT id FROM vt{k}) THEN 0 WHEN id IN (SELECT v FROM adj WHERE u IN (SELECT id FROM vt{k})) THEN greatest(vote - 1 / (SELECT avg(k) FROM nbr), 0) ELSE vote END::DOUBLE AS vote, CASE WHEN id IN (SELECT id FROM vt{k}) THEN {k} ELSE rank END AS rank FROM vo{k - 1})" for k in range(1, 6))
also("voterank", "lanes", "SELECT rank, id FROM vo5 WHERE rank IS NOT NULL", VOTES)
ONION = NBR + ", on_ AS (SELECT 0 AS layer, 0 AS core, []::VARCHAR[] AS gone, (SELECT list(id) FROM nodes) AS l UNION ALL SELECT layer + 1, greatest(core, low), list_filter(l, lambda x: len(list_intersect(m[x], l)) <= greatest(core, low)), list_filter(l, lambda x: len(list_intersect(m[x], l)) > greatest(core, low)) FROM (SELECT layer, core, l, m, list_min(list_transform(l, lambda x: len(list_intersect(m[x], l)))) AS low FROM on_, mp WHERE len(l) > 0))"
also("onion_layers", "lanes", "SELECT unnest(gone) AS id, layer::BIGINT AS layer, core::BIGINT AS core FROM on_", ONION)
CHORD = NBR + ", uc AS (SELECT 0 AS k, (SELECT list(id) FROM nodes) AS l UNION ALL SELECT k + 1, list_filter(l, lambda x: NOT coalesce(list_bool_and(list_transform(list_intersect(m[x], l), lambda a: len(list_intersect(m[a], list_intersect(m[x], l))) = len(list_intersect(m[x], l)) - 1)), true)) FROM uc, mp WHERE k < 25)"
also("unchordal", "lanes", "SELECT unnest(l) AS id FROM uc WHERE k = 25", CHORD)


def hashed(*values: str) -> str:
    return CHANCE.format("concat_ws(':', " + ", ".join(values) + ")")


WALK = "rw0 AS (SELECT id AS source, 0 AS step, id FROM nodes WHERE id IN ('N0', 'N1', 'N2'))" + "".join(f", rw{t} AS MATERIALIZED (SELECT source, {t} AS step, v AS id FROM (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY -ln(greatest({hashed(repr('0'), str(t), 'source', 'v')}, 1e-300)) / shared, v) AS k FROM rw{t - 1} JOIN adj ON id = u) WHERE k = 1)" for t in range(1, 6))
also("random_walks", "lanes", " UNION ALL ".join(f"SELECT source, step::BIGINT AS step, id FROM rw{t}" for t in range(6)), WALK)
PULL = "fd AS MATERIALIZED (SELECT id, coalesce(sum(shared), 0)::DOUBLE AS d FROM nodes LEFT JOIN adj ON id = u GROUP BY id), fv0 AS (SELECT id, d, 2 * " + hashed("'0'", "id") + " - 1 AS x FROM fd)" + "".join(f", fr{k} AS MATERIALIZED (SELECT a.id, a.d, (2 * (SELECT max(d) FROM fd) - a.d) * a.x + coalesce(s, 0) AS x FROM fv{k - 1} a LEFT JOIN (SELECT u, sum(shared * x) AS s FROM adj JOIN fv{k - 1} b ON v = b.id GROUP BY u) p ON a.id = p.u), fv{k} AS MATERIALIZED (SELECT id, d, (x - (SELECT avg(x) FROM fr{k})) / ((SELECT stddev_pop(x) FROM fr{k}) * sqrt((SELECT count(*) FROM fr{k}))) AS x FROM fr{k})" for k in range(1, 13))
also("fiedler_sides", "trade", "SELECT id, x * CASE WHEN (SELECT arg_min(x, id) FROM fv12) < 0 THEN -1 ELSE 1 END < 0 AS other_side FROM fv12", PULL)
ORACLES["uniform_graph"] = f"WITH d AS (SELECT i, floor({hashed(repr('1'), '0', 'i')} * 30)::BIGINT AS a, floor({hashed(repr('1'), '1', 'i')} * 29)::BIGINT AS b, floor({hashed(repr('1'), '2', 'i')} * 28)::BIGINT AS c FROM range(50) t(i)), e AS (SELECT i, a, b + (a <= b)::INT AS b, c FROM d), f AS (SELECT i, a, b, c + (least(a, b) <= c)::INT AS c FROM e), g AS (SELECT i, list_sort([a, b, c + (greatest(a, b) <= c)::INT]) AS l FROM f) SELECT 'e' || i AS edge_id, 'n' || l[1] || ',' || array_to_string(list_sort(['n' || l[2], 'n' || l[3]]), ',') AS ids FROM g"
ORACLES["small_world"] = f"WITH r AS (SELECT i, j, floor({hashed(repr('1'), repr('to'), 'i', 'j')} * 38)::BIGINT + 1 AS s, {hashed(repr('1'), repr('re'), 'i', 'j')} < 0.2 AS moved FROM range(40) x(i), range(1, 3) y(j)) SELECT 'n' || i || '-' || j AS edge_id, 'n' || CASE WHEN moved THEN (i + CASE WHEN s >= j THEN s + 1 ELSE s END) % 40 ELSE (i + j) % 40 END AS \"to\" FROM r"
