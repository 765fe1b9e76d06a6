"""Graphs in files: Parquet and JSON folders of nodes and edges, edge lists, records. Each path is one that all executors reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.graph import Graph

NODES = "id string, label string, data map<string,string>, weight double"
EDGES = "edge_id string, source_ids array<string>, target_ids array<string>, label string, weight double"


def save(g: Graph, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes path/nodes and path/edges; fmt: parquet, orc or json (a line for each row)."""
    for name in ("nodes", "edges"):
        getattr(g, name).write.format(fmt).mode(mode).save(f"{path}/{name}")


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> Graph:
    return Graph(*(spark.read.format(fmt).schema(schema).load(f"{path}/{name}") for name, schema in (("nodes", NODES), ("edges", EDGES))))


def _plain(c: Column, bad: str) -> Column:
    return F.when(c.rlike(bad), F.raise_error(F.concat(F.lit("not to be written in an edge list: "), c))).otherwise(c)


def write_edgelist(g: Graph, path: str, mode: str = "errorifexists") -> None:
    """A line for each edge: sources, targets, label, weight; tabs between, commas within.

    The format can't escape, so ids with a comma, tab or line end and labels with a tab or line end are an error. A null label is written as empty.
    """
    side = lambda c: F.array_join(F.transform(c, lambda i: _plain(i, "[,\t\r\n]")), ",")
    line = F.concat_ws("\t", side("source_ids"), side("target_ids"), F.coalesce(_plain(F.col("label"), "[\t\r\n]"), F.lit("")), F.coalesce(F.col("weight"), F.lit(1.0)).cast("string"))
    g.edges.select(line.alias("value")).write.mode(mode).text(path)


def read_edgelist(spark: SparkSession, path: str) -> Graph:
    """Lines of fewer than three fields are left out; without a fourth the weight is 1. Nodes are the ids that occur, labelled with the id.

    An edge's id comes from its line: the MD5 and, for lines that are alike, a number.
    """
    part = F.split("value", "\t")
    ids = lambda i: F.array_sort(F.array_distinct(F.filter(F.split(F.get(part, F.lit(i)), ","), lambda x: x != "")))
    lines = spark.read.text(path).where(F.size(part) >= 3).groupBy("value").agg(F.count("*").cast("int").alias("n"))
    rows = lines.select("value", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    weight = F.coalesce(F.get(part, F.lit(3)).try_cast("double"), F.lit(1.0))
    edges = rows.select(F.concat_ws("-", F.md5("value"), F.col("k").cast("string")).alias("edge_id"), ids(0).alias("source_ids"), ids(1).alias("target_ids"), F.get(part, F.lit(2)).alias("label"), weight.alias("weight"))
    nodes = edges.select(F.explode(F.array_union("source_ids", "target_ids")).alias("id")).distinct()
    return Graph(nodes.select("id", F.col("id").alias("label"), F.create_map().cast("map<string,string>").alias("data"), F.lit(1.0).alias("weight")), edges)


def from_records(nodes: DataFrame, edges: DataFrame) -> Graph:
    """From nodes(label or name, data, weight) and edges(source or from, target or to, label or relation, weight), ends given by node labels.

    Missing columns and nulls get "", no data and weight 1. Of nodes with one label the heaviest stays, ties by data as JSON; edges
    with an end that no node has are left out. A node's id is its label, an edge's is made of its ends and label, with repeats once at their greatest weight.
    """
    empty = F.create_map().cast("map<string,string>")
    pick = lambda df, names, default: F.coalesce(*[F.col(c) for c in names if c in df.columns], default)
    named = nodes.select(pick(nodes, ("label", "name"), F.lit(None).cast("string")).alias("id"), pick(nodes, ("data",), empty).alias("data"), pick(nodes, ("weight",), F.lit(1.0)).cast("double").alias("weight")).where("id is not null")
    best = named.groupBy("id").agg(F.max_by("data", F.struct("weight", F.to_json("data"))).alias("data"), F.max("weight").alias("weight"))
    found = best.select("id", F.col("id").alias("label"), "data", "weight")
    rows = edges.select(pick(edges, ("source", "from"), F.lit(None).cast("string")).alias("s"), pick(edges, ("target", "to"), F.lit(None).cast("string")).alias("t"), pick(edges, ("label", "relation"), F.lit("")).alias("label"), pick(edges, ("weight",), F.lit(1.0)).cast("double").alias("weight"))
    rows = rows.join(found.select(F.col("id").alias("s")), "s", "left_semi").join(found.select(F.col("id").alias("t")), "t", "left_semi")
    out = rows.groupBy("s", "t", "label").agg(F.max("weight").alias("weight"))
    key = F.sha2(F.to_json(F.array("s", "t", "label")), 256)
    return Graph(found, out.select(key.alias("edge_id"), F.array("s").alias("source_ids"), F.array("t").alias("target_ids"), "label", "weight"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new, which replace those of the same key; of several new rows of one key one stays, the last by all columns as JSON."""
    one = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.to_json(F.struct(*new.columns))).alias("r")).select("r.*")
    return old.join(one.select(key), key, "left_anti").select(*old.columns).unionByName(one.select(*old.columns))


def fingerprint(g: Graph) -> DataFrame:
    """One row: nodes, edges, digest. Rows are hashed on their own and the hashes added, so the order of rows doesn't count and nothing is gathered."""
    part = lambda df, text: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("h"))
    nodes = part(g.nodes, F.concat_ws("|", "id", "label"))
    edges = part(g.edges, F.concat_ws("|", "edge_id", F.array_join("source_ids", ","), F.array_join("target_ids", ","), "label"))
    one = nodes.select(F.col("n").alias("nodes"), F.col("h").alias("hn")).join(F.broadcast(edges.select(F.col("n").alias("edges"), F.col("h").alias("he"))))
    return one.select("nodes", "edges", F.concat_ws("-", F.col("hn").cast("string"), F.col("he").cast("string")).alias("digest"))


def write_sqlite(g: Graph, path: str) -> None:
    """nodes and edges as tables of a new SQLite file on the driver, which is a format of one machine: rows come partition by partition and are never held together. Lists and maps are JSON."""
    import sqlite3
    from contextlib import closing

    tables = {
        "nodes": g.nodes.select("id", "label", F.to_json("data").alias("data"), "weight"),
        "edges": g.edges.select("edge_id", F.to_json("source_ids").alias("source_ids"), F.to_json("target_ids").alias("target_ids"), "label", "weight"),
    }
    with closing(sqlite3.connect(path)) as con:
        for name, rows in tables.items():
            con.execute(f"CREATE TABLE {name} ({', '.join(rows.columns)})")
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows.columns))})", map(tuple, rows.toLocalIterator()))
        con.commit()


def read_sqlite(spark: SparkSession, path: str, parts: int = 8) -> Graph:
    """The graph of such a file, which all executors must reach; each task reads a range of rows."""
    import sqlite3
    from contextlib import closing

    def table(name: str, columns: list[str], schema: str) -> DataFrame:
        with closing(sqlite3.connect(path)) as con:
            last = con.execute(f"SELECT coalesce(max(rowid), 0) FROM {name}").fetchone()[0]
        step = max(1, -(-last // parts))

        def run(batches):
            import pandas as pd

            for batch in batches:
                for start in batch["id"]:
                    with closing(sqlite3.connect(path)) as con:
                        rows = con.execute(f"SELECT {', '.join(columns)} FROM {name} WHERE rowid > ? AND rowid <= ?", (int(start), int(start) + step)).fetchall()
                    yield pd.DataFrame(rows, columns=columns)

        return spark.range(0, last, step, parts).mapInPandas(run, schema)

    nodes = table("nodes", ["id", "label", "data", "weight"], "id string, label string, data string, weight double")
    edges = table("edges", ["edge_id", "source_ids", "target_ids", "label", "weight"], "edge_id string, source_ids string, target_ids string, label string, weight double")
    ids = lambda c: F.from_json(c, "array<string>").alias(c)
    return Graph(nodes.withColumn("data", F.from_json("data", "map<string,string>")), edges.select("edge_id", ids("source_ids"), ids("target_ids"), "label", "weight"))
