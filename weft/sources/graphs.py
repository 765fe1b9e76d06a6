"""Graphs derived from the star-schema tables, each with the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, and an edge from supplier to customer nation for each flow of lines; its weight is in means of all flows."""
    flows = _flows(spark, sf_dir)
    return _nations(spark, sf_dir, _with_mean(flows))


def lanes(spark: SparkSession, sf_dir: str) -> Graph:
    """The nations with a sparse set of edges: each nation's main outlet and main source, of all flows that with the most lines for the totals of its two ends; ties by number."""
    flows = _flows(spark, sf_dir)
    out, into = flows.groupBy("s").agg(F.sum("n").alias("ns")), flows.groupBy("c").agg(F.sum("n").alias("nc"))
    share = flows.join(out, "s").join(into, "c").select("s", "c", (F.col("n") / (F.col("ns") * F.col("nc"))).alias("share"))
    outlet = share.groupBy("s").agg(F.min(F.struct(-F.col("share"), "c")).alias("first")).select("s", F.col("first.c").alias("c"))
    source = share.groupBy("c").agg(F.min(F.struct(-F.col("share"), "s")).alias("first")).select(F.col("first.s").alias("s"), "c")
    return _nations(spark, sf_dir, _with_mean(flows).join(outlet.unionByName(source).distinct(), ["s", "c"]))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, c, n: lines of each supplier and customer nation."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("s_nationkey").alias("s"), F.col("c_nationkey").alias("c")).agg(F.count("*").alias("n"))


def _with_mean(flows: DataFrame) -> DataFrame:
    return flows.withColumn("mean", flows.agg(F.avg("n")).scalar())


def _nations(spark: SparkSession, sf_dir: str, flows: DataFrame) -> Graph:
    nation = read(spark, sf_dir, "nation")
    region = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    flows = flows.join(region.select(F.col("k").alias("s"), F.col("r").alias("sr")), "s").join(region.select(F.col("k").alias("c"), F.col("r").alias("cr")), "c")
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    edges = flows.select(F.concat(name("s"), F.lit("-"), name("c")).alias("edge_id"), F.array(name("s")).alias("source_ids"), F.array(name("c")).alias("target_ids"), F.when(F.col("sr") == F.col("cr"), "intra").otherwise("inter").alias("label"), F.round(F.col("n") / F.col("mean"), 4).alias("weight"))
    nodes = nation.select(name("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("data"), F.lit(1.0).alias("weight"))
    # a few hundred rows at most, out of joins of all lines: written once, not computed again by each step of a loop
    return Graph(nodes, checkpoint(edges))


_TRADE = """flows AS MATERIALIZED (SELECT s_nationkey AS s, c_nationkey AS c, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
big AS MATERIALIZED (SELECT s, c, round(n / (SELECT avg(n) FROM flows), 4) AS weight FROM {}),
nodes AS (SELECT 'N' || n_nationkey AS id, n_name AS label, n_regionkey::VARCHAR AS region FROM nation),
edges AS MATERIALIZED (SELECT 'N' || s || '-N' || c AS edge_id, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'intra' ELSE 'inter' END AS label, weight, s, c FROM big JOIN nation a ON s = a.n_nationkey JOIN nation b ON c = b.n_nationkey),
inc AS MATERIALIZED (SELECT edge_id, 'N' || s AS node_id, 'source' AS role, label, weight FROM edges UNION ALL SELECT edge_id, 'N' || c, 'target', label, weight FROM edges)"""
TRADE = _TRADE.format("flows")
LANES = _TRADE.format("(SELECT *, row_number() OVER (PARTITION BY s ORDER BY share DESC, c) AS outlet, row_number() OVER (PARTITION BY c ORDER BY share DESC, s) AS source FROM (SELECT *, n / (sum(n) OVER (PARTITION BY s) * sum(n) OVER (PARTITION BY c))::DOUBLE AS share FROM flows)) WHERE outlet = 1 OR source = 1")


def orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and parts, and an edge for each order from its customer to its parts."""
    # dealt out as numbers: sets half collected take more room
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey")
    parts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string")))).alias("target_ids"))
    rows = read(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = rows.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("edge_id"), F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("source_ids"), "target_ids", F.col("o_orderpriority").alias("label"), (F.floor("o_totalprice") / 100000).alias("weight"))
    text = lambda *cs: F.create_map(*[x for c, k in cs for x in (F.lit(k), F.col(c).cast("string"))])
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), text(("c_mktsegment", "segment"), ("c_nationkey", "nation")).alias("data"), F.lit(1.0).alias("weight"))
    goods = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), text(("p_brand", "brand"), ("p_type", "type"), ("p_size", "size")).alias("data"), F.lit(1.0).alias("weight"))
    return Graph(customers.unionByName(goods), edges)


ORDERS = """edges AS (SELECT 'O' || o_orderkey AS edge_id, o_orderpriority AS label, floor(o_totalprice) / 100000 AS weight, o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
inc AS (SELECT edge_id, 'C' || o_custkey AS node_id, 'source' AS role, label, weight FROM edges UNION ALL SELECT DISTINCT edge_id, 'P' || l_partkey, 'target', label, weight FROM edges JOIN lineitem ON o_orderkey = l_orderkey),
nodes AS (SELECT 'C' || c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'P' || p_partkey, p_name FROM part)"""

def handover(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, and an edge for each order that is not the last of its day, from its customer to that of the next order of the day. It grows with the data, and its nodes keep about as many edges."""
    own = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    rows = read(spark, sf_dir, "orders").withColumn("next", F.lead("o_custkey").over(own)).where("next is not null")
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    edges = rows.select(F.concat(F.lit("H"), F.col("o_orderkey").cast("string")).alias("edge_id"), F.array(name("o_custkey")).alias("source_ids"), F.array(name("next")).alias("target_ids"), F.col("o_orderpriority").alias("label"), (F.floor("o_totalprice") / 100000).alias("weight"))
    nodes = read(spark, sf_dir, "customer").select(name("c_custkey").alias("id"), F.col("c_name").alias("label"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("data"), F.lit(1.0).alias("weight"))
    return Graph(nodes, edges)


HANDOVER = """ho AS MATERIALIZED (SELECT o_orderkey, o_custkey, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS nxt, o_orderpriority, floor(o_totalprice) / 100000 AS weight FROM orders),
edges AS MATERIALIZED (SELECT 'H' || o_orderkey AS edge_id, o_orderpriority AS label, weight, 'C' || o_custkey AS s, 'C' || nxt AS c FROM ho WHERE nxt IS NOT NULL),
inc AS MATERIALIZED (SELECT edge_id, s AS node_id, 'source' AS role, label, weight FROM edges UNION ALL SELECT edge_id, c, 'target', label, weight FROM edges),
nodes AS (SELECT 'C' || c_custkey AS id, c_name AS label FROM customer)"""

#: The views of a Graph, over nodes, edges and inc.
VIEWS = """members AS (SELECT DISTINCT edge_id, node_id, label, weight FROM inc),
pairs AS (SELECT a.node_id AS src, b.node_id AS tgt, a.edge_id, a.label, a.weight FROM inc a JOIN inc b ON a.edge_id = b.edge_id AND a.role = 'source' AND b.role = 'target'),
cliq AS (SELECT a.node_id AS u, b.node_id AS v, a.edge_id, a.label, a.weight FROM members a JOIN members b ON a.edge_id = b.edge_id AND a.node_id < b.node_id),
links AS (SELECT u, v, count(*) AS shared FROM cliq GROUP BY u, v),
adj AS (SELECT u, v, shared FROM links UNION ALL SELECT v, u, shared FROM links),
arcs AS (SELECT DISTINCT src, tgt FROM pairs WHERE src <> tgt),
degree AS (SELECT id, count(edge_id) AS degree FROM nodes LEFT JOIN members ON id = node_id GROUP BY id),
nbr AS (SELECT id, count(v) AS k FROM nodes LEFT JOIN adj ON id = u GROUP BY id)"""


def sql(kind: str, body: str, more: str = "") -> str:
    """body over the views of a graph; more: further common table expressions."""
    return f"WITH RECURSIVE {dict(trade=TRADE, lanes=LANES, orders=ORDERS, handover=HANDOVER)[kind]},\n{VIEWS}{',' + more if more else ''}\n{body}"
