"""The registered queries of the graph engine, each with the same in DuckDB's SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import belief, centrality, degrees, lookup, maintenance, matrices, paths, retrieval, rules, search, temporal
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.sources import graphs
from weft.sources.graphs import read, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, kind: str, run: Callable[[Graph], DataFrame], body: str | None = None, more: str = "") -> None:
    """A query over a graph; body is its SQL over the graph's views."""
    QUERIES[name] = lambda spark, sf_dir: run(getattr(graphs, kind)(spark, sf_dir))
    if body:
        ORACLES[name] = sql(kind, body, more)


def add_table(name: str, run: Callable[[SparkSession, str], DataFrame], body: str | None = None) -> None:
    """A query over tables."""
    QUERIES[name] = run
    if body:
        ORACLES[name] = body


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def names(g: Graph, *ids: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def forward(g: Graph) -> Graph:
    """The edges whose source comes before their target by id: a graph without cycles."""
    return Graph(g.nodes, g.edges.where(F.get("source_ids", F.lit(0)) < F.get("target_ids", F.lit(0))))


# lookups
add("incident_edges", "orders", lambda g: lookup.incident_edges(g, "P7").select("edge_id", "weight"), "SELECT edge_id, weight FROM members WHERE node_id = 'P7'")
add("outgoing_edges", "orders", lambda g: lookup.incident_edges(g, "C7", "source").select("edge_id", "label"), "SELECT edge_id, label FROM inc WHERE node_id = 'C7' AND role = 'source'")
add("incoming_edges", "orders", lambda g: lookup.incident_edges(g, "P7", "target").select("edge_id", "label"), "SELECT edge_id, label FROM inc WHERE node_id = 'P7' AND role = 'target'")
add("edges_by_label", "orders", lambda g: lookup.edges_by_label(g, "1-URGENT").select("edge_id", "weight"), "SELECT edge_id, weight FROM edges WHERE label = '1-URGENT'")
add("neighbors_any", "orders", lambda g: lookup.neighbors(g), "SELECT u AS id, v AS neighbor FROM adj")
add("neighbors_out", "trade", lambda g: lookup.neighbors(g, "out"), "SELECT src AS id, tgt AS neighbor FROM arcs")
add("neighbors_in", "trade", lambda g: lookup.neighbors(g, "in", "inter"), "SELECT DISTINCT tgt AS id, src AS neighbor FROM pairs WHERE src <> tgt AND label = 'inter'")
add("cocoverage", "orders", lookup.cocoverage, "SELECT u, v, shared FROM adj")
add("labeled_edges", "orders", lookup.labeled_edges, "SELECT edge_id, i.label, weight, string_agg(n.label, ',' ORDER BY n.label) FILTER (role = 'source') AS sources, string_agg(n.label, ',' ORDER BY n.label) FILTER (role = 'target') AS targets FROM inc i JOIN nodes n ON node_id = id GROUP BY ALL")
add("edges_of_order", "orders", lambda g: lookup.by_order(g, [1, 3]).edges.select("edge_id"), "SELECT edge_id FROM members GROUP BY edge_id HAVING count(*) - 1 IN (1, 3)")
add("pattern_match", "trade", lambda g: lookup.pattern_match(g, "inter"), "SELECT edge_id, a.label AS src_label, b.label AS tgt_label FROM pairs p JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE p.label = 'inter'")
add("subgraph", "trade", lambda g: lookup.subgraph(g, g.nodes.where(F.col("data")["region"].isin("1", "2"))).edges.select("edge_id"), "SELECT edge_id FROM members m JOIN nodes n ON node_id = id GROUP BY edge_id HAVING bool_and(region IN ('1', '2'))")
add("query_hyperedges", "orders", lambda g: lookup.query_hyperedges(g, 1, 5, "2-HIGH").select("edge_id"), "SELECT edge_id FROM inc WHERE label = '2-HIGH' GROUP BY edge_id HAVING count(*) FILTER (role = 'target') >= 5")
HOPS = "hop AS (SELECT id AS source, id, 0 AS d FROM nodes UNION SELECT source, tgt, d + 1 FROM hop JOIN arcs ON id = src WHERE d < 25), h AS (SELECT source, id, min(d)::BIGINT AS d FROM hop GROUP BY source, id)"
add("breadth_first", "lanes", lambda g: lookup.breadth_first(g, names(g, "N0", "N3", "N7"), 3, True), "SELECT id, min(d) AS depth FROM h WHERE source IN ('N0', 'N3', 'N7') AND d <= 3 GROUP BY id", HOPS)

# degrees
add("degrees", "orders", lambda g: rounded(degrees.degrees(g), "strength"), f"SELECT n.id, degree, (SELECT count(*) FROM inc WHERE node_id = n.id AND role = 'target') AS in_degree, (SELECT count(*) FROM inc WHERE node_id = n.id AND role = 'source') AS out_degree, {r('coalesce((SELECT sum(weight) FROM members WHERE node_id = n.id), 0)')} AS strength FROM nodes n JOIN degree d ON n.id = d.id")
add("degree_distribution", "orders", degrees.degree_distribution, "SELECT degree, count(*) AS nodes FROM degree GROUP BY degree")
add("edge_sizes", "orders", degrees.edge_sizes, "SELECT size, count(*) AS edges FROM (SELECT count(*) AS size FROM members GROUP BY edge_id) GROUP BY size")
add("graph_summary", "orders", lambda g: rounded(degrees.summary(g), "density", digits=9), f"SELECT nodes, edges, {r('edges / (nodes * (nodes - 1))', 9)} AS density, (SELECT max(s) - 1 FROM (SELECT count(*) AS s FROM members GROUP BY edge_id)) AS max_order FROM (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges)")
CORR = "SELECT " + r("corr(a.degree, b.degree)") + " AS r FROM {} p JOIN degree a ON {} = a.id JOIN degree b ON {} = b.id"
add("degree_correlation", "orders", lambda g: rounded(degrees.degree_correlation(g), "r"), CORR.format("cliq", "u", "v"))
add("degree_assortativity", "orders", lambda g: rounded(degrees.degree_assortativity(g), "r"), CORR.format("pairs", "src", "tgt"))
add("attribute_assortativity", "trade", lambda g: rounded(degrees.attribute_assortativity(g, "region"), "r"), f"SELECT {r('(same - sq) / (1 - sq)')} AS r FROM (SELECT sum(n) FILTER (x = y) / sum(n) AS same, (SELECT sum(s * s) FROM (SELECT sum(n) AS s FROM mix GROUP BY x)) / (sum(n) * sum(n)) AS sq FROM mix)", "mix AS (SELECT a.region AS x, b.region AS y, count(*)::DOUBLE AS n FROM adj JOIN nodes a ON u = a.id JOIN nodes b ON v = b.id GROUP BY ALL)")
add("average_neighbor_degree", "orders", lambda g: rounded(degrees.average_neighbor_degree(g), "value"), f"SELECT n.id, {r('coalesce(avg(k), 0)')} AS value FROM nodes n LEFT JOIN (SELECT u, k FROM adj JOIN nbr ON v = id) a ON n.id = u GROUP BY n.id")
add("degree_connectivity", "orders", lambda g: rounded(degrees.degree_connectivity(g), "value"), f"SELECT a.k, {r('avg(b.k)')} AS value FROM adj JOIN nbr a ON u = a.id JOIN nbr b ON v = b.id GROUP BY a.k")
add("s_metric", "orders", degrees.s_metric, "SELECT sum(a.k * b.k)::DOUBLE AS s FROM links JOIN nbr a ON u = a.id JOIN nbr b ON v = b.id")
add("rich_club", "lanes", lambda g: rounded(degrees.rich_club(g), "phi"), f"SELECT k, {r('2 * m / (n * (n - 1))')} AS phi FROM (SELECT l.k, (SELECT count(*) FROM nbr WHERE nbr.k > l.k) AS n, (SELECT count(*) FROM links JOIN nbr a ON u = a.id JOIN nbr b ON v = b.id WHERE least(a.k, b.k) > l.k) AS m FROM (SELECT DISTINCT k FROM nbr WHERE k > 0) l) WHERE n > 1")
TRI = "tri AS (SELECT id, count(*) AS t FROM (SELECT a.u AS id FROM adj a JOIN adj b ON a.v = b.u JOIN adj c ON b.v = c.u AND c.v = a.u WHERE a.v < b.v) GROUP BY id), cc AS (SELECT nbr.id, k, coalesce(t, 0) AS t FROM nbr LEFT JOIN tri ON nbr.id = tri.id)"
for kind in ("lanes", "orders", "handover"):
    add(f"triangles_{kind}", kind, lambda g: rounded(degrees.triangles(g), "clustering"), f"SELECT id, k, t AS triangles, {r('CASE WHEN k > 1 THEN 2 * t / (k * (k - 1)) ELSE 0 END')} AS clustering FROM cc", TRI)
add("average_clustering", "lanes", lambda g: rounded(degrees.average_clustering(g), "value"), f"SELECT {r('avg(CASE WHEN k > 1 THEN 2 * t / (k * (k - 1)) ELSE 0 END)')} AS value FROM cc JOIN degree d ON cc.id = d.id WHERE degree >= 2", TRI)
add("transitivity", "lanes", lambda g: rounded(degrees.transitivity(g), "value"), f"SELECT {r('sum(t) / (sum(k * (k - 1)) / 2)')} AS value FROM cc", TRI)

# paths and components
add("hops", "lanes", paths.hops, "SELECT * FROM h", HOPS)
RELAX = "c AS (SELECT src, tgt, min(1 / greatest(weight, 1e-9)) AS cost FROM pairs WHERE src <> tgt GROUP BY ALL), w0 AS (SELECT id AS source, id, 0::DOUBLE AS d FROM nodes)" + "".join(f", w{k + 1} AS (SELECT source, id, min(d) AS d FROM (SELECT * FROM w{k} UNION ALL SELECT source, tgt, d + cost FROM w{k} JOIN c ON id = src) GROUP BY ALL)" for k in range(8))
add("weighted_distances", "lanes", lambda g: rounded(paths.distances(g), "d"), f"SELECT source, id, {r('d')} AS d FROM w8", RELAX)
EXT = "ecc AS (SELECT source AS id, max(d) AS ecc FROM h GROUP BY source)"
add("eccentricity_extent", "lanes", paths.extent, "SELECT id, ecc, ecc = (SELECT min(ecc) FROM ecc) AS center, ecc = (SELECT max(ecc) FROM ecc) AS periphery FROM ecc", f"{HOPS}, {EXT}")
REACH = "reach AS (SELECT src, tgt FROM arcs UNION SELECT reach.src, arcs.tgt FROM reach JOIN arcs ON reach.tgt = arcs.src)"
add("transitive_closure", "lanes", paths.closure, "SELECT * FROM reach", REACH)
FORWARD = "fw AS (SELECT * FROM arcs WHERE src < tgt), freach AS (SELECT src, tgt FROM fw UNION SELECT freach.src, fw.tgt FROM freach JOIN fw ON freach.tgt = fw.src)"
add("transitive_reduction", "lanes", lambda g: paths.transitive_reduction(forward(g)), "SELECT src, tgt FROM fw a WHERE NOT EXISTS (SELECT 1 FROM fw b JOIN freach c ON b.tgt = c.src WHERE b.src = a.src AND b.tgt <> a.tgt AND c.tgt = a.tgt)", FORWARD)
add("topological_levels", "lanes", lambda g: paths.levels(forward(g)), "SELECT id, max(d)::BIGINT AS level FROM lv GROUP BY id", "fw AS (SELECT * FROM arcs WHERE src < tgt), lv AS (SELECT id, 0 AS d FROM nodes UNION SELECT tgt, d + 1 FROM lv JOIN fw ON id = src)")
add("simple_paths", "lanes", lambda g: paths.simple_paths(g, "N0", "N1", 4).select(F.array_join("path", ",").alias("path"), "hops"), "SELECT array_to_string(p, ',') AS path, (len(p) - 1)::BIGINT AS hops FROM walk WHERE e = 'N1'", "walk AS (SELECT [src, tgt] AS p, tgt AS e FROM arcs WHERE src = 'N0' UNION ALL SELECT list_append(p, tgt), tgt FROM walk JOIN arcs ON e = src WHERE len(p) < 5 AND e <> 'N1' AND NOT list_contains(p, tgt))")
ALIKE = "cc0 AS (SELECT id, id AS c FROM nodes)" + "".join(f", cc{k + 1} AS (SELECT id, min(c) AS c FROM (SELECT * FROM cc{k} UNION ALL SELECT u, c FROM adj JOIN cc{k} ON v = id) GROUP BY id)" for k in range(8))
add("connected_components", "orders", paths.connected_components, "SELECT id, c AS component FROM cc8", ALIKE)
OVER = "ov AS (SELECT a.edge_id AS e1, b.edge_id AS e2, count(*) AS shared FROM members a JOIN members b ON a.node_id = b.node_id AND a.edge_id < b.edge_id GROUP BY ALL)"
add("edge_overlaps", "orders", lambda g: paths.overlaps(g, 2), "SELECT * FROM ov WHERE shared >= 2", OVER)
add("s_components", "orders", lambda g: paths.s_components(g, 2), "SELECT e.edge_id, least(e.edge_id, coalesce(min(b), e.edge_id)) AS component FROM edges e LEFT JOIN con ON e.edge_id = a GROUP BY e.edge_id", f"{OVER}, big2 AS (SELECT e1 AS a, e2 AS b FROM ov WHERE shared >= 2 UNION ALL SELECT e2, e1 FROM ov WHERE shared >= 2), con AS (SELECT a, b FROM big2 UNION SELECT con.a, big2.b FROM con JOIN big2 ON con.b = big2.a)")
add("s_persistence", "lanes", paths.s_persistence)
add("strong_components", "lanes", paths.strong_components, "SELECT id, least(id, coalesce(min(a.tgt), id)) AS component FROM nodes LEFT JOIN (reach a JOIN reach b ON a.src = b.tgt AND a.tgt = b.src) ON a.src = id GROUP BY id", REACH)
add("onion_layers", "lanes", paths.onion_layers)
add("minimum_spanning_edges", "trade", paths.minimum_spanning_edges)
VOTE = "lp0 AS (SELECT id, id AS c FROM nodes)" + "".join(f", lp{k + 1} AS (SELECT n.id, coalesce(b, n.c) AS c FROM lp{k} n LEFT JOIN (SELECT u, first(c ORDER BY s DESC, c) AS b FROM (SELECT u, c, sum(shared) AS s FROM adj JOIN lp{k} ON v = id GROUP BY u, c) GROUP BY u) ON n.id = u)" for k in range(5))
add("label_propagation", "orders", paths.label_propagation, "SELECT id, c AS community FROM lp5", VOTE)

# centralities
add("degree_centrality", "orders", lambda g: rounded(centrality.degree_centrality(g), "score"), f"SELECT id, {r('degree / ((SELECT count(*) FROM nodes) - 1)')} AS score FROM degree")
add("closeness", "lanes", lambda g: rounded(centrality.closeness(g), "score"), f"SELECT source AS id, {r('CASE WHEN sum(d) > 0 THEN (count(*) - 1) / (((SELECT count(*) FROM nodes) - 1) * sum(d)) ELSE 0 END')} AS score FROM h GROUP BY source", HOPS)
add("harmonic", "lanes", lambda g: rounded(centrality.harmonic(g), "score"), f"SELECT id, {r('sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END)')} AS score FROM h GROUP BY id", HOPS.replace("JOIN arcs ON id = src", "JOIN adj ON id = u").replace("tgt, d + 1", "v, d + 1"))


def _rounds(n: int, got: str, norm: str, links: str) -> str:
    """n rounds of: got over (id, g), with g the sum over links (u, v, w) of w times the score of v; divided by norm."""
    out = f"lk AS ({links}), p0 AS (SELECT id, 1 / (SELECT count(*) FROM nodes) AS s FROM nodes)"
    for k in range(n):
        out += f", q{k} AS (SELECT id, {got} AS s FROM (SELECT n.id, coalesce(sum(w * s), 0) AS g FROM nodes n LEFT JOIN (SELECT u, w, s FROM lk JOIN p{k} ON v = p{k}.id) x ON n.id = u GROUP BY n.id)), p{k + 1} AS (SELECT id, s / (SELECT {norm} FROM q{k}) AS s FROM q{k})"
    return out


SHARED = "SELECT u, v, shared::DOUBLE AS w FROM adj"
for kind in ("trade", "orders", "handover"):
    add(f"eigenvector_{kind}", kind, lambda g: rounded(centrality.eigenvector(g, 5), "score"), f"SELECT id, {r('s')} AS score FROM p5", _rounds(5, "g", "sqrt(sum(s * s))", SHARED))
    add(f"katz_{kind}", kind, lambda g: rounded(centrality.katz(g, n=5), "score"), f"SELECT id, {r('s')} AS score FROM p5", _rounds(5, "0.1 * g + 1", "sqrt(sum(s * s))", SHARED))
    add(f"pagerank_{kind}", kind, lambda g: rounded(centrality.pagerank(g, n=5), "score", digits=8), f"SELECT id, {r('s', 8)} AS score FROM p5", _rounds(5, "0.85 / (SELECT count(*) FROM nodes) + 0.15::DOUBLE * g", "sum(s)", "SELECT src AS v, tgt AS u, sum(weight / size / total) AS w FROM pairs JOIN (SELECT edge_id, count(*) AS size FROM inc GROUP BY edge_id) z ON pairs.edge_id = z.edge_id JOIN (SELECT node_id, sum(weight) AS total FROM inc WHERE role = 'source' GROUP BY node_id) o ON src = o.node_id GROUP BY src, tgt"))
CORE = "tot AS (SELECT id, coalesce(sum(shared), 0)::DOUBLE AS t FROM nodes LEFT JOIN adj ON id = u GROUP BY id), k0 AS (SELECT id, t, t / (SELECT max(t) FROM tot) AS s FROM tot)" + "".join(f", k{k + 1} AS (SELECT n.id, t, CASE WHEN t > 0 THEN g / t ELSE s END AS s FROM k{k} n LEFT JOIN (SELECT u, sum(shared * s) AS g FROM adj JOIN k{k} ON v = k{k}.id GROUP BY u) x ON n.id = u)" for k in range(5))
add("core_periphery", "trade", lambda g: rounded(centrality.core_periphery(g), "score"), f"SELECT id, {r('least(greatest(s, 0), 1)')} AS score FROM k5", CORE)
MUTUAL = "x0 AS (SELECT id, 1 / (SELECT count(*) FROM nodes) AS s FROM nodes), y0 AS (SELECT edge_id, 1 / (SELECT count(*) FROM edges) AS s FROM edges)"
for k in range(3):
    MUTUAL += f", a{k} AS (SELECT id, sqrt(any_value(x.s) * sqrt(coalesce(sum(y.s * y.s), 0))) AS s FROM x{k} x LEFT JOIN members m ON id = node_id LEFT JOIN y{k} y ON m.edge_id = y.edge_id GROUP BY id), b{k} AS (SELECT y.edge_id, sqrt(any_value(y.s) * sqrt(coalesce(sum(x.s * x.s), 0))) AS s FROM y{k} y LEFT JOIN members m ON y.edge_id = m.edge_id LEFT JOIN x{k} x ON id = node_id GROUP BY y.edge_id), x{k + 1} AS (SELECT id, s / (SELECT sum(s) FROM a{k}) AS s FROM a{k}), y{k + 1} AS (SELECT edge_id, s / (SELECT sum(s) FROM b{k}) AS s FROM b{k})"
add("node_edge_centrality", "trade", lambda g: (lambda x, y: rounded(x.select("id", "score").unionByName(y.select(F.col("edge_id").alias("id"), "score")), "score"))(*centrality.node_edge(g, 3)), f"SELECT id, {r('s')} AS score FROM x3 UNION ALL SELECT edge_id, {r('s')} FROM y3", MUTUAL)
add("betweenness", "lanes", lambda g: rounded(centrality.betweenness(g), "score"), f"SELECT n.id, {r('coalesce(sum(x), 0) / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2))')} AS score FROM nodes n LEFT JOIN (SELECT a.id, a.p * b.p / t.p AS x FROM sp a JOIN sp b ON b.source = a.id AND a.source <> a.id AND b.id <> a.id AND b.id <> a.source JOIN sp t ON t.source = a.source AND t.id = b.id AND t.d = a.d + b.d) y ON n.id = y.id GROUP BY n.id",
    f"{HOPS}, mult AS (SELECT src, tgt, count(*) AS m FROM pairs WHERE src <> tgt GROUP BY ALL), sp0 AS (SELECT source, id, d, 1::DOUBLE AS p FROM h WHERE d = 0)" + "".join(f", sp{k} AS (SELECT h.source, h.id, h.d, sum(p * m) AS p FROM h JOIN mult ON tgt = h.id JOIN sp{k - 1} q ON q.source = h.source AND q.id = src WHERE h.d = {k} GROUP BY ALL)" for k in range(1, 25)) + ", sp AS (" + " UNION ALL ".join(f"SELECT * FROM sp{k}" for k in range(25)) + ")")

# matrices and transforms
add("incidence_matrix", "orders", matrices.incidence, "SELECT edge_id, node_id AS id, min(CASE WHEN role = 'source' THEN 1 ELSE -1 END)::BIGINT AS value FROM inc GROUP BY ALL")
add("adjacency_matrix", "trade", matrices.adjacency, "SELECT u AS i, v AS j, shared AS value FROM adj")
FLOW = "fl AS (SELECT a.node_id AS i, b.node_id AS j, sum(a.weight / size) AS w FROM members a JOIN members b ON a.edge_id = b.edge_id JOIN (SELECT edge_id, count(*) AS size FROM inc GROUP BY edge_id) z ON a.edge_id = z.edge_id GROUP BY ALL)"
add("laplacian", "orders", lambda g: rounded(matrices.laplacian(g), "value", digits=9), f"SELECT i, j, {r('CASE WHEN i = j THEN d ELSE 0 END - w', 9)} AS value FROM fl JOIN (SELECT node_id, sum(weight) AS d FROM members GROUP BY node_id) ON i = node_id", FLOW)
add("transition_matrix", "orders", lambda g: rounded(matrices.transition(g), "value"), f"SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)')} AS value FROM fl", FLOW)
add("walk_density", "trade", lambda g: rounded(matrices.walk_density(g, names(g, "N0").withColumn("rho", F.lit(1.0)), 3), "rho"), f"SELECT id, {r('rho')} AS rho FROM d3", f"{FLOW}, tp AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS v FROM fl), d0 AS (SELECT 'N0' AS id, 1::DOUBLE AS rho)" + "".join(f", d{k + 1} AS (SELECT j AS id, sum(rho * v) AS rho FROM d{k} JOIN tp ON id = i GROUP BY j)" for k in range(3)))
add("dual_walk", "lanes", matrices.dual_walk, "SELECT a.edge_id AS e1, b.edge_id AS e2, count(*) AS value FROM members a JOIN members b ON a.node_id = b.node_id AND a.edge_id <> b.edge_id GROUP BY ALL")
add("bethe_hessian", "trade", lambda g: rounded(matrices.bethe_hessian(g, 2.0), "value"), f"SELECT id AS i, id AS j, {r('1 + coalesce(sum(shared), 0)')} AS value FROM nodes LEFT JOIN adj ON id = u GROUP BY id UNION ALL SELECT u, v, {r('-2.0 * shared')} FROM adj")
add("adjacency_tensor", "orders", lambda g: rounded(matrices.tensor(g), "weight"), f'SELECT members, n AS "order", {r("sum(weight)")} AS weight FROM (SELECT string_agg(node_id, \',\' ORDER BY node_id) AS members, count(*) AS n, any_value(weight) AS weight FROM members GROUP BY edge_id) GROUP BY ALL')
add("encapsulation", "orders", matrices.encapsulation, "SELECT a.edge_id AS child, b.edge_id AS parent FROM members a JOIN members b ON a.node_id = b.node_id AND a.edge_id <> b.edge_id JOIN sz p ON a.edge_id = p.edge_id JOIN sz q ON b.edge_id = q.edge_id WHERE p.n < q.n GROUP BY a.edge_id, b.edge_id, p.n HAVING count(*) = p.n", "sz AS (SELECT edge_id, count(*) AS n FROM members GROUP BY edge_id)")
add("boundary_operator", "lanes", matrices.boundary, "SELECT DISTINCT least(src, tgt) || ',' || greatest(src, tgt) AS simplex, unnest([greatest(src, tgt), least(src, tgt)]) AS face, unnest([1, -1])::BIGINT AS sign FROM arcs")
add("dual_graph", "orders", matrices.dual, "SELECT node_id AS id, string_agg(edge_id, ',' ORDER BY edge_id) AS edges FROM members GROUP BY node_id")
add("line_graph", "lanes", matrices.line_graph, "SELECT DISTINCT a.edge_id AS e1, b.edge_id AS e2 FROM members a JOIN members b ON a.node_id = b.node_id AND a.edge_id < b.edge_id")
add("directed_line_graph", "lanes", lambda g: matrices.line_graph(g, True), "SELECT DISTINCT a.edge_id AS e1, b.edge_id AS e2 FROM inc a JOIN inc b ON a.node_id = b.node_id AND a.edge_id <> b.edge_id AND a.role = 'target' AND b.role = 'source'")
add("digraph", "orders", matrices.digraph, "SELECT src, tgt, max(edge_id) AS edge_id, arg_max(weight, edge_id) AS weight FROM pairs GROUP BY src, tgt")
add("clique_projection", "orders", lambda g: g.cliq.select("u", "v", "edge_id", "weight"), "SELECT u, v, edge_id, weight FROM cliq")
add("bipartite_projection", "trade", lambda g: rounded(matrices.projection(g), "jaccard"), f"SELECT a.src AS u, b.src AS v, count(*) AS shared, {r('count(*) / (any_value(p.n) + any_value(q.n) - count(*))')} AS jaccard FROM pp a JOIN pp b ON a.tgt = b.tgt AND a.src < b.src JOIN dn p ON a.src = p.src JOIN dn q ON b.src = q.src GROUP BY a.src, b.src", "pp AS (SELECT DISTINCT src, tgt FROM pairs), dn AS (SELECT src, count(*) AS n FROM pp GROUP BY src)")
add("hyperedge_similarity", "orders", lambda g: rounded(matrices.hyperedge_similarity(g, "O7"), "jaccard", "dice", "overlap"), f"SELECT edge_id, s AS shared, {r('s / (m + n - s)')} AS jaccard, {r('2 * s / (m + n)')} AS dice, {r('s / least(m, n)')} AS overlap FROM (SELECT b.edge_id, count(*) AS s, (SELECT count(*) FROM members c WHERE c.edge_id = b.edge_id) AS m, (SELECT count(*) FROM members WHERE edge_id = 'O7') AS n FROM members a JOIN members b ON a.node_id = b.node_id WHERE a.edge_id = 'O7' AND b.edge_id <> 'O7' GROUP BY b.edge_id)")
LINKS = f"SELECT a.u, b.u AS v, count(*) AS common, {r('count(*) / (any_value(p.k) + any_value(q.k) - count(*))')} AS jaccard, {r('sum(CASE WHEN w.k > 1 THEN 1 / ln(w.k) END)')} AS adamic_adar, {r('sum(1 / w.k)')} AS resource_allocation, any_value(p.k) * any_value(q.k) AS preferential FROM adj a JOIN adj b ON a.v = b.v AND a.u < b.u JOIN nbr w ON a.v = w.id JOIN nbr p ON a.u = p.id JOIN nbr q ON b.u = q.id WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.u = a.u AND l.v = b.u) GROUP BY a.u, b.u"
add("link_prediction", "lanes", lambda g: rounded(matrices.link_prediction(g), "jaccard", "adamic_adar", "resource_allocation"), LINKS)

# rules
add("rule_transitive", "lanes", lambda g: rounded(rules.transitive(g, "inter"), "score"), f"SELECT p.src AS a, p.tgt AS b, q.tgt AS c, {r('least(p.w * q.w * 0.9::DOUBLE * 0.9::DOUBLE, 1)')} AS score FROM own p JOIN own q ON p.tgt = q.src WHERE p.src <> q.tgt AND NOT EXISTS (SELECT 1 FROM arcs WHERE src = p.src AND tgt = q.tgt)", "own AS (SELECT src, tgt, max(weight) AS w FROM pairs WHERE label = 'inter' AND src <> tgt GROUP BY ALL)")
add("rule_inverse", "trade", lambda g: rules.inverse(g, "inter", "intra"), "SELECT DISTINCT tgt AS src, src AS tgt FROM pairs p WHERE label = 'inter' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.label = 'intra' AND q.src = p.tgt AND q.tgt = p.src)")
add("rule_hub", "orders", lambda g: rounded(rules.hub_inference(g, 2, 0.2), "share"), f"SELECT p.src, tgt, count(*) AS n, {r('count(*) / any_value(t)')} AS share FROM pairs p JOIN (SELECT node_id, count(*) AS t FROM inc WHERE role = 'source' GROUP BY node_id) ON p.src = node_id GROUP BY p.src, tgt HAVING count(*) >= 2 AND count(*) / any_value(t) >= 0.2")
add("rule_property", "orders", lambda g: rules.propagate_property(g, "segment"), "SELECT tgt AS id, min(c_mktsegment) AS value FROM pairs JOIN customer ON src = 'C' || c_custkey GROUP BY tgt")
add("rule_inductive", "trade", rules.inductive, "SELECT label, tgt, count(DISTINCT src) AS members FROM pairs GROUP BY label, tgt HAVING count(DISTINCT src) >= 3")
add("discover_transitive", "lanes", rules.discover_transitive, "SELECT p.label, count(*) AS chains FROM own p JOIN own q ON p.label = q.label AND p.tgt = q.src WHERE p.src <> q.tgt GROUP BY p.label HAVING count(*) >= 2", "own AS (SELECT DISTINCT label, src, tgt FROM pairs WHERE src <> tgt)")
add("discover_inverse", "lanes", rules.discover_inverse, "SELECT p.label, q.label AS back, count(*) AS pairs FROM own p JOIN own q ON p.src = q.tgt AND p.tgt = q.src GROUP BY ALL HAVING count(*) >= 2", "own AS (SELECT DISTINCT label, src, tgt FROM pairs WHERE src <> tgt)")
add("discover_hubs", "orders", rules.discover_hubs, "SELECT node_id AS id, label, count(*) AS edges FROM inc WHERE role = 'source' GROUP BY ALL HAVING count(*) >= 3")
add("edge_violations", "trade", lambda g: rules.violations(g, 2.0), "SELECT edge_id, 'self_loop' AS violation FROM edges WHERE s = c UNION ALL SELECT edge_id, 'weight' FROM edges WHERE weight <= 0 OR weight > 2")
add("dangling", "orders", rules.dangling, "SELECT NULL::VARCHAR AS edge_id, id AS node_id FROM degree WHERE degree = 0 UNION ALL SELECT edge_id, node_id FROM members WHERE node_id NOT IN (SELECT id FROM nodes)")


# search
PARTS = "SELECT 'P' || p_partkey AS id, p_brand AS brand, p_type AS type, p_size AS size FROM part"
EAV = f"eav AS (SELECT id, unnest(['brand', 'type', 'size']) AS field, unnest([brand, type, size::VARCHAR]) AS sval FROM ({PARTS}) UNION ALL SELECT 'C' || c_custkey, unnest(['segment', 'nation']), unnest([c_mktsegment, c_nationkey::VARCHAR]) FROM customer)"
add("attribute_index", "orders", search.attribute_index, "SELECT id, field, sval, TRY_CAST(sval AS DOUBLE) AS dval FROM eav", EAV)
add("search_filters", "orders", lambda g: search.matching(g, search.parse("brand:Brand#1,Brand#2 size:10..30 -type:ECONOMY").filters).select("id"), f"SELECT id FROM ({PARTS}) WHERE brand IN ('Brand#1', 'Brand#2') AND size BETWEEN 10 AND 30 AND type <> 'ECONOMY'")
add("search_text", "orders", lambda g: search.text_match(search.attribute_index(g), ["Household"]), "SELECT id, field FROM eav WHERE list_contains(string_split_regex(lower(trim(sval)), '\\s+'), 'household')", EAV)
add("facets", "orders", lambda g: search.facets(g, ["brand", "type"], search.parse("brand:Brand#1 size:10..30").filters), f"SELECT 'brand' AS field, brand AS value, count(*) AS n FROM ({PARTS}) WHERE size BETWEEN 10 AND 30 GROUP BY brand UNION ALL SELECT 'type', type, count(*) FROM ({PARTS}) WHERE brand = 'Brand#1' AND size BETWEEN 10 AND 30 GROUP BY type")
add("facet_scores", "orders", lambda g: rounded(search.facet_scores(search.attribute_index(g)), "score"), f"SELECT field, {r('CASE WHEN count(*) BETWEEN 2 AND 100 THEN -sum(n / t * log2(n / t)) * log2(count(*)) ELSE 0 END')} AS score FROM (SELECT field, sval, count(*) AS n, sum(count(*)) OVER (PARTITION BY field) AS t FROM eav GROUP BY field, sval) GROUP BY field", EAV)
add("suggest", "orders", lambda g: search.suggest(search.attribute_index(g), "brand", "brand#1"), "SELECT DISTINCT sval AS value FROM eav WHERE field = 'brand' AND starts_with(lower(sval), 'brand#1') ORDER BY lower(sval), sval LIMIT 10", EAV)

# retrieval
add("spread", "lanes", lambda g: rounded(retrieval.spread(g, names(g, "N0").withColumn("energy", F.lit(1.0)), 3), "energy"), f"SELECT id, {r('e')} AS energy FROM s3", "rt AS (SELECT src AS f, tgt AS id, sum(weight * 0.85) AS w FROM pairs GROUP BY ALL UNION ALL SELECT tgt, src, sum(weight * 0.3 * 0.85) FROM pairs WHERE src <> tgt GROUP BY ALL), s0 AS (SELECT 'N0' AS id, 1::DOUBLE AS e)" + "".join(f", t{k} AS (SELECT id, sum(e) AS e FROM (SELECT * FROM s{k} UNION ALL SELECT rt.id, e * w FROM s{k} s JOIN rt ON s.id = f) GROUP BY id), s{k + 1} AS (SELECT * FROM (SELECT id, e * (SELECT max(e) FROM s{k}) / (SELECT max(e) FROM t{k}) AS e FROM t{k}) WHERE e >= 0.01)" for k in range(3)))
GATE = "z0 AS (SELECT 'C7' AS id, 1::DOUBLE AS e)" + "".join(f", z{k + 1} AS (SELECT * FROM (SELECT id, sum(e) AS e FROM (SELECT * FROM z{k} UNION ALL SELECT t.node_id, e * t.weight * 0.85 / n FROM z{k} z JOIN inc s ON z.id = s.node_id AND s.role = 'source' JOIN inc t ON s.edge_id = t.edge_id AND t.role = 'target' JOIN (SELECT edge_id, count(*) AS n FROM inc WHERE role = 'target' GROUP BY edge_id) c ON s.edge_id = c.edge_id) GROUP BY id) WHERE e >= 0.01)" for k in range(2))
for mode in ("linear", "and", "or", "majority"):  # with one source to an edge the gates agree
    add(f"diffuse_{mode}", "orders", lambda g, mode=mode: rounded(retrieval.diffuse(g, names(g, "C7").withColumn("energy", F.lit(1.0)), mode, 2), "energy"), f"SELECT id, {r('e')} AS energy FROM z2", GATE)
add("rank_fusion", "orders", lambda g: rounded(retrieval.rank_fusion(g.incidence.groupBy(F.col("role").alias("list"), F.col("node_id").alias("id")).agg(F.count("*").alias("score")).unionByName(g.members.groupBy(F.lit("size").alias("list"), F.col("node_id").alias("id")).agg(F.sum("size").alias("score")))), "score"), f"SELECT id, {r('sum(1 / (60 + k))')} AS score FROM (SELECT id, row_number() OVER (PARTITION BY l ORDER BY s DESC, id) AS k FROM (SELECT role AS l, node_id AS id, count(*) AS s FROM inc GROUP BY ALL UNION ALL SELECT 'size', a.node_id, count(*) FROM members a JOIN members b ON a.edge_id = b.edge_id GROUP BY a.node_id)) GROUP BY id")
VEC = "u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
add_table("similar_vectors", lambda spark, d: (lambda v: rounded(retrieval.similar(v, v.where("vec_id % 50 = 0")), "cosine"))(read(spark, d, "embeddings")), f"WITH {VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank, {r('c')} AS cosine FROM p) WHERE rank <= 10")
add_table("analogy", lambda spark, d: rounded(retrieval.analogy(read(spark, d, "embeddings"), 1, 2, 3), "cosine"), f"WITH {VEC}, n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM u), g AS (SELECT list_transform(list_zip(a.e, b.e, c.e), lambda x: x[3] + x[2] - x[1]) AS q FROM n a, n b, n c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3) SELECT vec_id AS id, {r('list_cosine_similarity(e, q)')} AS cosine FROM n, g WHERE vec_id NOT IN (1, 2, 3) ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 5")
add_table("recency", lambda spark, d: rounded(retrieval.recency(read(spark, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"))), "score"), f"SELECT user_id AS id, {r('least(sum(pow(0.9::DOUBLE, k - 1)), 100)')} AS score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY user_id")


# time
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals from their time on, of value minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read(spark, sf_dir, "events").select("event_id", "user_id", start.alias("start"), (start + 60 * F.abs("value")).alias("end"))


IV = "iv AS (SELECT event_id, user_id, s, s + 60 * abs(value) AS e FROM (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS s FROM events))"


def allen(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"CASE WHEN {a0} = {b0} AND {a1} = {b1} THEN 'equals' WHEN {a1} = {b0} THEN 'meets' WHEN {a0} = {b1} THEN 'met_by' WHEN {a1} < {b0} THEN 'before' WHEN {a0} > {b1} THEN 'after' WHEN {a0} = {b0} THEN CASE WHEN {a1} < {b1} THEN 'starts' ELSE 'started_by' END WHEN {a1} = {b1} THEN CASE WHEN {a0} < {b0} THEN 'finished_by' ELSE 'finishes' END WHEN {a0} < {b0} AND {a1} > {b1} THEN 'contains' WHEN {a0} > {b0} AND {a1} < {b1} THEN 'during' WHEN {a0} < {b0} THEN 'overlaps' ELSE 'overlapped_by' END"


NEAR = f"near AS (SELECT * FROM (SELECT a.event_id AS a, b.event_id AS b, greatest(0, greatest(a.s, b.s) - least(a.e, b.e)) AS gap, {allen('a.s', 'a.e', 'b.s', 'b.e')} AS relation FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id) WHERE gap <= {{}})"
add_table("allen_to_interval", lambda s, d: temporal.relate_to(intervals(s, d), 1704153600.0, 1704240000.0), f"WITH {IV} SELECT event_id, {allen('s', 'e', '1704153600', '1704240000')} AS relation FROM iv")
add_table("temporal_proximity", lambda s, d: rounded(temporal.close_pairs(intervals(s, d), 600.0, "user_id"), "gap", digits=3), f"WITH {IV}, {NEAR.format(600)} SELECT a, b, {r('gap', 3)} AS gap, relation FROM near")
add_table("temporal_overlaps", lambda s, d: temporal.overlapping(intervals(s, d), "user_id"), f"WITH {IV}, {NEAR.format(0)} SELECT a, b, relation FROM near WHERE relation NOT IN ('before', 'after', 'meets', 'met_by')")
add_table("causal_chains", lambda s, d: temporal.chains(intervals(s, d), "user_id", 1800.0, 3), f"WITH {IV}, {NEAR.format(1800)}, st AS (SELECT a, b FROM near WHERE relation IN ('before', 'meets') UNION ALL SELECT b, a FROM near WHERE relation IN ('after', 'met_by')) SELECT p.a || ',' || p.b || ',' || q.b AS path FROM st p JOIN st q ON p.b = q.a")


# beliefs
def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order priority of each market segment, given how often such orders are closed and dear."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("concept"), F.col("o_orderpriority").alias("outcome"))
    rows = rows.agg(F.count("*").cast("double").alias("w"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("closed"), F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("dear"))
    evidence = rows.select("concept", F.lit(1).alias("seq"), "outcome", F.col("closed").alias("likelihood")).unionByName(rows.select("concept", F.lit(2).alias("seq"), "outcome", F.col("dear").alias("likelihood")))
    return belief.posterior(belief.normalized(rows.select("concept", "outcome", "w")), evidence)


BEL = "bw AS (SELECT c_mktsegment AS concept, o_orderpriority AS outcome, count(*)::DOUBLE AS n, avg((o_orderstatus = 'F')::INT) AS closed, avg((o_totalprice > 150000)::INT) AS dear FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), bp AS (SELECT concept, outcome, n / sum(n) OVER (PARTITION BY concept) AS prior, greatest(closed, 1e-12) * greatest(dear, 1e-12) AS l FROM bw), post AS (SELECT concept, outcome, prior, prior * l / sum(prior * l) OVER (PARTITION BY concept) AS p FROM bp)"
add_table("bayes_posterior", lambda s, d: rounded(_beliefs(s, d), "prior", "p"), f"WITH {BEL} SELECT concept, outcome, {r('prior')} AS prior, {r('p')} AS p FROM post")
add_table("bayes_divergence", lambda s, d: rounded(belief.divergence(_beliefs(s, d)), "kl", "entropy"), f"WITH {BEL} SELECT concept, {r('sum(p * ln(greatest(p, 1e-12) / greatest(prior, 1e-12)))')} AS kl, {r('-sum(p * log2(greatest(p, 1e-12)))')} AS entropy FROM post GROUP BY concept")
add_table("bayes_map", lambda s, d: rounded(belief.map_estimate(_beliefs(s, d)), "p"), f"WITH {BEL} SELECT concept, first(outcome ORDER BY p DESC, outcome) AS outcome, {r('max(p)')} AS p FROM post GROUP BY concept")
add_table("bayes_credible_set", lambda s, d: rounded(belief.credible_set(_beliefs(s, d), 0.7), "p"), f"WITH {BEL} SELECT concept, outcome, {r('p')} AS p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY concept ORDER BY p DESC, outcome ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM post) WHERE b < 0.7")
add_table("bayes_odds", lambda s, d: rounded(belief.odds(_beliefs(s, d), "1-URGENT", "5-LOW"), "odds"), f"WITH {BEL} SELECT concept, {r('''max(p) FILTER (outcome = '1-URGENT') / greatest(max(p) FILTER (outcome = '5-LOW'), 1e-12)''')} AS odds FROM post GROUP BY concept")


def _amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("state_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("node_id"))
    return rows.agg(F.round(F.avg("c_acctbal") / 1e4, 3).alias("re"), F.round(F.stddev_pop("c_acctbal") / 1e4, 3).alias("im"))


AMP = "amp AS (SELECT c_mktsegment AS state_id, 'N' || c_nationkey AS node_id, round(avg(c_acctbal) / 1e4, 3) AS re, round(stddev_pop(c_acctbal) / 1e4, 3) AS im FROM customer GROUP BY ALL)"
add_table("born_probabilities", lambda s, d: rounded(belief.born(_amplitudes(s, d)), "p"), f"WITH {AMP} SELECT state_id, node_id, {r('(re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY state_id)')} AS p FROM amp")
add_table("density_matrix", lambda s, d: rounded(belief.density_matrix(_amplitudes(s, d)), "re", "im"), f"WITH {AMP}, t AS (SELECT state_id, sum(re * re + im * im) AS t FROM amp GROUP BY state_id) SELECT a.state_id, a.node_id AS i, b.node_id AS j, {r('(a.re * b.re + a.im * b.im) / t')} AS re, {r('(a.im * b.re - a.re * b.im) / t')} AS im FROM amp a JOIN amp b ON a.state_id = b.state_id JOIN t ON a.state_id = t.state_id")
add_table("interference", lambda s, d: rounded(belief.interference(_amplitudes(s, d)), "together", "apart", "effect"), f"WITH {AMP} SELECT node_id, {r('sum(re) * sum(re) + sum(im) * sum(im)')} AS together, {r('sum(re * re + im * im)')} AS apart, {r('sum(re) * sum(re) + sum(im) * sum(im) - sum(re * re + im * im)')} AS effect FROM amp GROUP BY node_id HAVING count(*) > 1")

# updates
add("remove_nodes", "trade", lambda g: maintenance.remove_nodes(g, names(g, "N0", "N1")).edges.select("edge_id"), "SELECT edge_id FROM edges WHERE s NOT IN (0, 1) AND c NOT IN (0, 1)")
add("merge_node", "trade", lambda g: maintenance.merge_node(g, "N0", "N1").edges.select("edge_id", F.array_join("source_ids", ",").alias("sources"), F.array_join("target_ids", ",").alias("targets")), "SELECT edge_id, CASE WHEN s <> 1 AND c <> 1 THEN 'N' || s ELSE CASE WHEN s IN (0, 1) THEN 'N0' ELSE 'N0,N' || s END END AS sources, CASE WHEN s <> 1 AND c <> 1 THEN 'N' || c ELSE CASE WHEN c IN (0, 1) THEN 'N0' ELSE 'N0,N' || c END END AS targets FROM edges")
add("decay_weights", "trade", lambda g: rounded(maintenance.decay(g).edges, "weight").select("edge_id", "weight"), f"SELECT edge_id, {r('weight * 0.95')} AS weight FROM edges")
add("edge_diff", "trade", lambda g: maintenance.edge_diff(g, Graph(g.nodes, maintenance.remove_nodes(g, names(g, "N0")).edges.withColumn("weight", F.when(F.col("label") == "intra", F.col("weight") * 2).otherwise(F.col("weight"))))), "SELECT edge_id, CASE WHEN s = 0 OR c = 0 THEN 'removed' ELSE 'modified' END AS change FROM edges WHERE s = 0 OR c = 0 OR label = 'intra'")
add("overlay_commit", "trade", lambda g: maintenance.overlay(g, g.edges.where("label = 'intra'").withColumn("label", F.lit("home"))).edges.select("edge_id", "label"), "SELECT edge_id, CASE WHEN label = 'intra' THEN 'home' ELSE label END AS label FROM edges")
add("provenance_dependents", "lanes", lambda g: maintenance.dependents(forward(g).arcs.select(F.col("tgt").alias("edge_id"), F.col("src").alias("input")), names(g, "N0").withColumnRenamed("id", "edge_id")), "SELECT id AS edge_id, min(d)::BIGINT AS depth FROM dp WHERE d > 0 GROUP BY id", "dp AS (SELECT 'N0' AS id, 0 AS d UNION SELECT tgt, d + 1 FROM dp JOIN arcs ON id = src WHERE src < tgt)")
add("equivalences", "orders", lambda g: rounded(maintenance.equivalences(g, 0.6, ("brand", "type")), "score"), f"SELECT a, b, {r('CASE WHEN s >= 0.6 THEN s ELSE greatest(s, 0.4 * s + 0.6 * j) END')} AS score FROM (SELECT x.id AS a, y.id AS b, (2 + (x.size = y.size)::INT) / 3 AS s, coalesce((SELECT count(*) FROM adj p JOIN adj q ON p.v = q.v WHERE p.u = x.id AND q.u = y.id), 0) AS j FROM ({PARTS}) x JOIN ({PARTS}) y ON x.brand = y.brand AND x.type = y.type AND x.id < y.id) WHERE s >= 0.6")
add_table("operation_stats", lambda s, d: rounded(read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("top")), "mean", "p50", "p95", "top"), f"SELECT event_type, count(*) AS n, {r('avg(value)')} AS mean, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95, {r('max(value)')} AS top FROM events GROUP BY event_type")
