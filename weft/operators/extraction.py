"""Relations from text, by patterns, and their way into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import maintenance
from weft.plans.graph import Graph


def relations(texts: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, source, relation, target: what stands around each of the words, in whole texts: a word, one of words, a word, in lower case.

    Matches are the leftmost that don't overlap. Null texts have none; repeated matches are repeated rows.
    """
    pattern = rf"(\w+) ({'|'.join(words)}) (\w+)"
    text = F.lower(F.col(text_col))
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for k, name in ((1, "source"), (2, "relation"), (3, "target"))])
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(found).alias("x"))
    return rows.select(id_col, "x.source", "x.relation", "x.target")


def confidence(found: DataFrame) -> DataFrame:
    """source, relation, target, n, confidence: how often each relation occurs, and 1 - 1 / (n + 1)."""
    rows = found.groupBy("source", "relation", "target").agg(F.count("*").alias("n"))
    return rows.withColumn("confidence", 1 - 1 / (F.col("n") + 1))


def ingest(g: Graph, found: DataFrame, least: float = 0.0) -> Graph:
    """g with the entities of relations as nodes and the relations as edges, weighted by their confidence, of least or more."""
    rows = confidence(found).where(F.col("confidence") >= least)
    ids = rows.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select("id", F.col("id").alias("label"), F.create_map(F.lit("kind"), F.lit("entity")).alias("data"), F.lit(1.0).alias("weight"))
    edges = rows.select(F.concat_ws(":", "relation", "source", "target").alias("edge_id"), F.array("source").alias("source_ids"), F.array("target").alias("target_ids"), F.col("relation").alias("label"), F.col("confidence").alias("weight"))
    return maintenance.add_all(g, nodes, edges)
