"""The registered queries on beliefs, time and monitors beyond those of weft.queries, to which they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import belief, monitor, temporal
from weft.operators.degrees import rounded
from weft.plans.graph import Graph
from weft.queries import AMP, HOPS, IV, TRI, _amplitudes, add, add_table, allen, intervals, names, r
from weft.sources.graphs import read
from weft.structure_queries import CHANCE

# amplitudes
NORM = "nm AS (SELECT state_id, node_id, re / sqrt(sum(re * re + im * im) OVER w) AS re, im / sqrt(sum(re * re + im * im) OVER w) AS im FROM {} WINDOW w AS (PARTITION BY state_id))"
add_table("create_distribution", lambda s, d: rounded(belief.normal_amplitudes(_amplitudes(s, d)), "re", "im"), f"WITH {AMP}, {NORM.format('amp')} SELECT state_id, node_id, {r('re')} AS re, {r('im')} AS im FROM nm")


def updates(s: SparkSession, d: str) -> DataFrame:
    return _amplitudes(s, d).where(F.col("node_id").isin("N1", "N2")).select("state_id", "node_id", F.lit(2.0).alias("factor"))


SCALED = "ev AS (SELECT state_id, node_id, CASE WHEN node_id IN ('N1', 'N2') THEN 2 ELSE 1 END * re AS re, CASE WHEN node_id IN ('N1', 'N2') THEN 2 ELSE 1 END * im AS im FROM amp)"
add_table("evolve_amplitudes", lambda s, d: rounded(belief.evolve_amplitudes(_amplitudes(s, d), updates(s, d)), "re", "im"), f"WITH {AMP}, {SCALED}, {NORM.format('ev')} SELECT state_id, node_id, {r('re')} AS re, {r('im')} AS im FROM nm")


def reflection(s: SparkSession, d: str) -> DataFrame:
    """A unitary matrix over the nations: each entry -2 / n, and 1 more on the diagonal, times the imaginary unit."""
    ids = read(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("i"))
    both = ids.agg(F.array_sort(F.collect_list("i")).alias("ids")).select("ids", F.explode("ids").alias("i")).select("i", F.explode("ids").alias("j"), F.size("ids").alias("n"))
    return both.select("i", "j", F.lit(0.0).alias("ur"), (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - 2 / F.col("n")).alias("ui"))


TURN = "un AS (SELECT 'N' || a.n_nationkey AS i, 'N' || b.n_nationkey AS j, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1 ELSE 0 END - 2 / (SELECT count(*) FROM nation) AS ui FROM nation a, nation b), ev AS (SELECT state_id, i AS node_id, sum(-ui * im) AS re, sum(ui * re) AS im FROM amp JOIN un ON node_id = j GROUP BY state_id, i)"
add_table("evolve_unitary", lambda s, d: rounded(belief.evolve_unitary(_amplitudes(s, d), reflection(s, d)), "re", "im"), f"WITH {AMP}, {TURN}, {NORM.format('ev')} SELECT state_id, node_id, {r('re')} AS re, {r('im')} AS im FROM nm")
DRAW = "pb AS (SELECT state_id, node_id, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY state_id){} AS p FROM amp), cu AS (SELECT *, sum(p) OVER (PARTITION BY state_id ORDER BY node_id) AS upto, sum(p) OVER (PARTITION BY state_id) AS total FROM pb) SELECT state_id, min(node_id) AS node_id FROM cu WHERE upto > " + CHANCE.format("concat('3:', state_id)") + " * total GROUP BY state_id"
add_table("sample", lambda s, d: belief.sample(_amplitudes(s, d), 3), f"WITH {AMP}, {DRAW.format('')}")


def profile(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"), F.when(F.col("n_regionkey") == 1, 5.0).otherwise(0.5).alias("weight"))


add_table("sample_with_profile", lambda s, d: belief.sample(_amplitudes(s, d), 3, profile(s, d)), f"WITH {AMP}, " + DRAW.format(" * (SELECT CASE WHEN n_regionkey = 1 THEN 5 ELSE 0.5::DOUBLE END FROM nation WHERE 'N' || n_nationkey = node_id)"))


def joint(s: SparkSession, d: str) -> DataFrame:
    """One state over pairs of a class of segments (two of them) and a nation, as a density matrix."""
    rows = _amplitudes(s, d).groupBy(F.lit("all").alias("state_id"), F.concat(F.when(F.col("state_id") < "C", "low").otherwise("high"), F.lit("|"), "node_id").alias("node_id")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return belief.density_matrix(rows)


PAIR = "jt AS (SELECT CASE WHEN state_id < 'C' THEN 'low' ELSE 'high' END AS a, node_id AS n, sum(re) AS re, sum(im) AS im FROM amp GROUP BY ALL), rd AS (SELECT x.a AS i, y.a AS j, sum(x.re * y.re + x.im * y.im) / (SELECT sum(re * re + im * im) FROM jt) AS re, sum(x.im * y.re - x.re * y.im) / (SELECT sum(re * re + im * im) FROM jt) AS im FROM jt x JOIN jt y ON x.n = y.n GROUP BY x.a, y.a)"
add_table("partial_trace", lambda s, d: rounded(belief.partial_trace(joint(s, d)), "re", "im"), f"WITH {AMP}, {PAIR} SELECT 'all' AS state_id, i, j, {r('re')} AS re, {r('im')} AS im FROM rd")
ROOT = "ab AS (SELECT coalesce(max(re) FILTER (i = 'low' AND j = 'low'), 0) AS a, coalesce(max(re) FILTER (i = 'high' AND j = 'high'), 0) AS b, coalesce(max(re * re + im * im) FILTER (i = 'low' AND j = 'high'), 0) AS c FROM rd), ei AS (SELECT unnest([(a + b + sqrt((a - b) * (a - b) + 4 * c)) / 2, (a + b - sqrt((a - b) * (a - b) + 4 * c)) / 2]) AS e FROM ab)"
add_table("von_neumann_entropy", lambda s, d: rounded(belief.von_neumann_entropy(belief.partial_trace(joint(s, d))), "entropy"), f"WITH {AMP}, {PAIR}, {ROOT} SELECT 'all' AS state_id, {r('-sum(e * log2(e))')} AS entropy FROM ei WHERE e > 1e-12")


def narrow(s: SparkSession, d: str) -> DataFrame:
    """The amplitudes, in one state with all but one at a hundredth, and in one with one outcome only."""
    small = _amplitudes(s, d).withColumn("k", F.when((F.col("state_id") == "BUILDING") & (F.col("node_id") != "N3"), 0.01).otherwise(1.0))
    return small.where("state_id <> 'MACHINERY' or node_id = 'N3'").select("state_id", "node_id", (F.col("re") * F.col("k")).alias("re"), (F.col("im") * F.col("k")).alias("im"))


def names_of(s: SparkSession, *ids: str) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "state_id string")


TRIG = "na AS (SELECT state_id, node_id, CASE WHEN state_id = 'BUILDING' AND node_id <> 'N3' THEN 0.01 ELSE 1 END AS k, re * k AS re, im * k AS im FROM amp WHERE state_id <> 'MACHINERY' OR node_id = 'N3'), pp AS (SELECT state_id, node_id, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY state_id) AS p FROM na), st AS (SELECT state_id, count(*) AS n, max(p) AS top, first(node_id ORDER BY p DESC, node_id) AS m, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS h FROM pp GROUP BY state_id)"
add_table("collapse_triggers", lambda s, d: belief.triggers(narrow(s, d), names_of(s, "FURNITURE")), f"WITH {AMP}, {TRIG} SELECT state_id, concat_ws(',', CASE WHEN state_id = 'FURNITURE' THEN 'staleness' END, CASE WHEN n = 1 THEN 'single_outcome' END, CASE WHEN top > 0.8 THEN 'dominance' END, CASE WHEN h < 0.3 AND n >= 2 THEN 'convergence' END) AS fired, greatest(0, CASE WHEN state_id = 'FURNITURE' THEN 0.9 ELSE 0 END, CASE WHEN n = 1 THEN 1 ELSE 0 END, CASE WHEN top > 0.8 THEN 0.8 ELSE 0 END, CASE WHEN h < 0.3 AND n >= 2 THEN 0.7 ELSE 0 END)::DOUBLE AS confidence, confidence >= 0.5 AS recommended, CASE WHEN n = 1 OR top > 0.8 THEN m END AS dominant FROM st")


def ages(s: SparkSession, d: str) -> DataFrame:
    return _amplitudes(s, d).select("state_id").distinct().select("state_id", (F.length("state_id") * 10.0).alias("age"))


add_table("decay_stale_states", lambda s, d: rounded(belief.faded(_amplitudes(s, d), ages(s, d), 85.0), "total"), f"WITH {AMP}, t AS (SELECT state_id, length(state_id) * 10.0::DOUBLE AS age, sum(re * re + im * im) AS a FROM amp GROUP BY state_id), l AS (SELECT state_id, CASE WHEN age > 85 THEN a * exp(-2 * age / 85) ELSE a END AS x FROM t) SELECT state_id, {r('x')} AS total, x < 1e-12 AS decayed FROM l")
add_table("belief_insights", lambda s, d: rounded(belief.insights(_amplitudes(s, d), 0.1), "effect"), f"WITH {AMP}, x AS (SELECT node_id, sum(re) * sum(re) + sum(im) * sum(im) - sum(re * re + im * im) AS e FROM amp GROUP BY node_id HAVING count(*) > 1) SELECT node_id, CASE WHEN e < 0 THEN 'contradiction' ELSE 'reinforcement' END AS kind, {r('e')} AS effect FROM x WHERE abs(e) >= 0.1")


def pairs_of(s: SparkSession, d: str) -> DataFrame:
    """How often customers of a segment and a nation order with a priority: the correlation of segments' outcomes with priorities' ones."""
    rows = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("a_state"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("a_node"), F.lit("priority").alias("b_state"), F.col("o_orderpriority").alias("b_node")).agg(F.count("*").cast("double").alias("strength"))


COR = "cr AS (SELECT c_mktsegment AS a_state, 'N' || c_nationkey AS a_node, o_orderpriority AS b_node, count(*)::DOUBLE AS strength FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
add_table("correlations", pairs_of, f"WITH {COR} SELECT a_state, a_node, 'priority' AS b_state, b_node, strength FROM cr")
add_table("sample_correlated", lambda s, d: belief.correlated(s.createDataFrame([("BUILDING", "N3")], "state_id string, node_id string"), pairs_of(s, d)), f"WITH {COR} SELECT 'priority' AS state_id, b_node AS node_id, strength FROM cr WHERE a_state = 'BUILDING' AND a_node = 'N3' ORDER BY strength DESC, b_node LIMIT 1")
add_table("entangled_groups", lambda s, d: belief.entangled_groups(read(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("b")).where("a <> 'N7'")), "WITH n AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation WHERE n_nationkey <> 7), m AS (SELECT b, least(min(a), b) AS c FROM n GROUP BY b) SELECT a AS id, c AS component FROM n JOIN m USING (b) UNION ALL SELECT b, c FROM m")


def weights(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("concept"), F.col("o_orderpriority").alias("outcome")).agg(F.count("*").cast("double").alias("w"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("likelihood"))


add_table("bayes_reset", lambda s, d: rounded(belief.uniform(weights(s, d)), "p"), f"SELECT c_mktsegment AS concept, o_orderpriority AS outcome, {r('1 / count(*) OVER (PARTITION BY c_mktsegment)')} AS p FROM (SELECT DISTINCT c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)")
CLOSED = "greatest(avg((o_orderstatus = 'F')::INT) FILTER (o_orderpriority = '{}'), 1e-12)"
add_table("bayes_factor", lambda s, d: rounded(belief.bayes_factor(weights(s, d).select("concept", F.lit(1).alias("seq"), "outcome", "likelihood"), "1-URGENT", "5-LOW"), "factor"), f"SELECT c_mktsegment AS concept, {r(CLOSED.format('1-URGENT') + ' / ' + CLOSED.format('5-LOW'))} AS factor FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")

# time
add_table("contains_point", lambda s, d: temporal.at(intervals(s, d), 1704240000.0).select("event_id"), f"WITH {IV} SELECT event_id FROM iv WHERE s <= 1704240000 AND e >= 1704240000")
add_table("valid_events", lambda s, d: temporal.valid(intervals(s, d).withColumn("end", F.when(F.col("event_id") % 7 == 0, F.col("start") - 1).otherwise(F.col("end")))).select("event_id"), f"WITH {IV} SELECT event_id FROM iv WHERE event_id % 7 <> 0")
add_table("infer_constraints", lambda s, d: temporal.constraints(intervals(s, d), "user_id"), f"WITH {IV} SELECT a.event_id AS a, b.event_id AS b, {allen('a.s', 'a.e', 'b.s', 'b.e')} AS relation FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id")
for name, kinds in (("before", ("before",)), ("after", ("after",)), ("overlapping", temporal.OVERLAPPING)):
    add_table(f"find_{name}", lambda s, d, kinds=kinds: temporal.related(intervals(s, d), 5, kinds), f"WITH {IV}, o AS (SELECT s AS os, e AS oe FROM iv WHERE event_id = 5) SELECT * FROM (SELECT event_id, {allen('s', 'e', 'os', 'oe')} AS relation FROM iv, o WHERE event_id <> 5) WHERE relation IN {(*kinds, '')}")
SPAN = "sp AS (SELECT user_id, min(s) AS s, max(e) AS e FROM iv GROUP BY user_id)"
add_table("temporal_spans", lambda s, d: rounded(temporal.spans(intervals(s, d), "user_id"), "start", "end", digits=3), f'WITH {IV}, {SPAN} SELECT user_id, {r("s", 3)} AS start, {r("e", 3)} AS "end" FROM sp')


def neighbours(s: SparkSession, d: str) -> DataFrame:
    ids = read(s, d, "events").select("user_id").distinct()
    return ids.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"))


add_table("temporal_inconsistencies", lambda s, d: temporal.inconsistent(temporal.spans(intervals(s, d).withColumn("half", F.floor(F.col("event_id") / 64)), "half"), intervals(s, d).select(F.floor(F.col("event_id") / 64).alias("a"), (F.floor(F.col("event_id") / 64) + 1).alias("b")).distinct(), "half"), f"WITH {IV}, sp AS (SELECT event_id // 64 AS h, min(s) AS s, max(e) AS e FROM iv GROUP BY h) SELECT * FROM (SELECT a.h AS a, b.h AS b, {allen('a.s', 'a.e', 'b.s', 'b.e')} AS relation FROM sp a JOIN sp b ON b.h = a.h + 1) WHERE relation IN ('after', 'started_by')")
add_table("violated_constraints", lambda s, d: temporal.violated(intervals(s, d), intervals(s, d).select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"), F.lit("before").alias("declared"))), f"WITH {IV} SELECT * FROM (SELECT a.event_id AS a, b.event_id AS b, 'before' AS declared, {allen('a.s', 'a.e', 'b.s', 'b.e')} AS actual FROM iv a JOIN iv b ON b.event_id = a.event_id + 1) WHERE actual <> 'before'")


# monitors
def log(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("event_type").alias("operation"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("rule"), (F.col("value") > 50).alias("ok"), "value", (F.col("value") / 100).alias("fitness"))


TREND = "(last(f ORDER BY ts, event_id) - first(f ORDER BY ts, event_id)) / count(*)"
add_table("fitness_trend", lambda s, d: rounded(monitor.trend(log(s, d)), "slope"), f"SELECT event_type AS operation, {r(TREND)} AS slope, CASE WHEN {TREND} > 0.02 THEN 'improving' WHEN {TREND} < -0.02 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT *, value / 100 AS f, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY event_type")
add_table("rule_effectiveness", lambda s, d: rounded(monitor.effectiveness(log(s, d)), "success", "share", "mean"), f"SELECT event_type AS rule, count(*) AS n, {r('avg((value > 50)::INT)')} AS success, {r('count(*) / (SELECT count(*) FROM events)')} AS share, {r('avg(value)')} AS mean FROM events GROUP BY event_type")
add_table("rule_bias", lambda s, d: rounded(monitor.bias(log(s, d)), "entropy", "evenness"), f"SELECT count(*) AS rules, {r('-sum(p * log2(p))')} AS entropy, {r('-sum(p * log2(p)) / log2(count(*))')} AS evenness, first(event_type ORDER BY p DESC, event_type) AS favourite FROM (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type)")
HEALTH = "hl AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT avg((degree = 0)::INT) FROM degree) AS alone, (SELECT avg(degree) FROM degree) AS degree, (SELECT count(*) FROM edges) AS edges, (SELECT avg(weight) FROM edges) AS weight), hf AS (SELECT *, (1 - alone + least(weight, 1)) / 2 AS fitness FROM hl)"
add("system_health", "orders", lambda g: rounded(monitor.health(g), "alone", "degree", "weight", "fitness"), f"SELECT nodes, edges, {r('alone')} AS alone, {r('degree')} AS degree, {r('weight')} AS weight, {r('fitness')} AS fitness FROM hf", HEALTH)
add("tuning_triggers", "orders", lambda g: rounded(monitor.alarms(monitor.health(g), {"degree": (None, 1.0), "alone": (0.9, None), "fitness": (0.0, 2.0)}), "value"), f"SELECT 'degree' AS name, {r('degree')} AS value, NULL::DOUBLE AS low, 1.0::DOUBLE AS high FROM hf WHERE degree > 1 UNION ALL SELECT 'alone', {r('alone')}, 0.9, NULL FROM hf WHERE alone < 0.9 UNION ALL SELECT 'fitness', {r('fitness')}, 0.0, 2.0 FROM hf WHERE fitness NOT BETWEEN 0 AND 2", HEALTH)
add("infinite_regress", "lanes", lambda g: monitor.regress(g, 3), "SELECT label, src, count(*) AS chains FROM rg WHERE len(p) = 4 GROUP BY label, src", "al AS (SELECT DISTINCT label, src, tgt FROM pairs WHERE src <> tgt), rg AS (SELECT label, src, [src, tgt] AS p, tgt AS e FROM al UNION ALL SELECT rg.label, rg.src, list_append(p, al.tgt), al.tgt FROM rg JOIN al ON al.label = rg.label AND e = al.src WHERE len(p) < 4 AND NOT list_contains(p, al.tgt))")
add("negation_cycles", "trade", lambda g: monitor.negation_cycles(g, "inter", "intra", 4), "SELECT array_to_string(p, ',') AS path FROM nc JOIN al ON al.src = e AND al.tgt = p[1] AND al.label <> nc.label WHERE len(p) % 2 = 0 AND p[1] = list_min([p[1], coalesce(p[3], p[1])])", "al AS (SELECT DISTINCT label, src, tgt FROM pairs WHERE src <> tgt), nc AS (SELECT [src, tgt] AS p, tgt AS e, label FROM al WHERE label = 'inter' UNION ALL SELECT list_append(p, al.tgt), al.tgt, al.label FROM nc JOIN al ON e = al.src AND al.label <> nc.label WHERE len(p) < 4 AND NOT list_contains(p, al.tgt))")


def frames(g: Graph) -> DataFrame:
    """Each node's number of edges and largest label, seen forwards and by all edges."""
    out = None
    for view, rows in (("out", g.incidence.where("role = 'source'")), ("all", g.members)):
        per = rows.groupBy(F.col("node_id").alias("id")).agg(F.count("*").cast("string").alias("edges"), F.max("label").alias("label"))
        both = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).alias("value")) for c in ("edges", "label")])
        rows = per.select(F.lit(view).alias("view"), "id", F.explode(both).alias("x")).select("view", "id", "x.property", "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out


add("invariant_properties", "orders", lambda g: monitor.stable(frames(g), 2), "SELECT a.node_id AS id, 'edges' AS property, a.n::VARCHAR AS value FROM fo a JOIN fa b ON a.node_id = b.node_id AND a.n = b.n UNION ALL SELECT a.node_id, 'label', a.l FROM fo a JOIN fa b ON a.node_id = b.node_id AND a.l = b.l", "fo AS (SELECT node_id, count(*) AS n, max(label) AS l FROM inc WHERE role = 'source' GROUP BY node_id), fa AS (SELECT node_id, count(*) AS n, max(label) AS l FROM members GROUP BY node_id)")
add("local_clustering", "lanes", lambda g: rounded(monitor.local_clustering(g, names(g, "N0", "N5")), "value"), f"SELECT {r('avg(CASE WHEN k > 1 THEN 2 * t / (k * (k - 1)) ELSE 0 END)')} AS value FROM cc WHERE id IN ('N0', 'N5') OR id IN (SELECT v FROM adj WHERE u IN ('N0', 'N5'))", TRI)
add("map_boundaries", "orders", monitor.boundaries, "SELECT id, CASE WHEN k = 0 THEN 'isolated' WHEN k >= (SELECT avg(k) FROM nbr) THEN 'core' ELSE 'edge' END AS zone FROM nbr")
add("suggest_assumptions", "lanes", lambda g: monitor.bridging(g, "N0", 3), "SELECT f.id, count(x.v) AS gain FROM fr f LEFT JOIN (SELECT u, v FROM adj WHERE v <> 'N0' AND v NOT IN (SELECT id FROM n1 UNION SELECT id FROM n2)) x ON x.u = f.id GROUP BY f.id ORDER BY 2 DESC, 1 LIMIT 3", "n1 AS (SELECT v AS id FROM adj WHERE u = 'N0'), n2 AS (SELECT DISTINCT v AS id FROM adj WHERE u IN (SELECT id FROM n1)), fr AS (SELECT id FROM n2 WHERE id <> 'N0' AND id NOT IN (SELECT id FROM n1))")
add("robust_reach", "lanes", lambda g: monitor.robust_reach(g, names(g, "N0", "N3"), [4, 4, 2]), "SELECT id FROM (SELECT DISTINCT id FROM h WHERE source IN ('N0', 'N3') AND d <= 4) WHERE id IN (SELECT source FROM h WHERE id IN ('N0', 'N3') AND d <= 4) AND id IN (SELECT id FROM u2)", f"{HOPS}, u1 AS (SELECT id FROM nodes WHERE id IN ('N0', 'N3') UNION SELECT v FROM adj WHERE u IN ('N0', 'N3')), u2 AS (SELECT id FROM u1 UNION SELECT v FROM adj WHERE u IN (SELECT id FROM u1))")
