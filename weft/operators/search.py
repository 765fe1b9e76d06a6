"""Structured search over nodes' fields: an index, filters, facets, suggestions; and a small query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.graph import Graph


def attribute_index(g: Graph) -> DataFrame:
    """id, field, sval, dval: a row per field of each node, as text and, where it is one, as a number."""
    rows = g.nodes.select("id", F.explode("data").alias("field", "sval")).where(F.col("sval").isNotNull())
    return rows.select("id", "field", "sval", F.col("sval").try_cast("double").alias("dval"))


def tokens(index: DataFrame) -> DataFrame:
    """id, field, token: the lowered words of each value."""
    return index.select("id", "field", F.explode(F.array_distinct(F.split(F.lower(F.trim("sval")), r"\s+"))).alias("token")).where("token <> ''")


@dataclass(frozen=True)
class Filter:
    """A condition on one field: equal to one of values, or between low and high (either may be None). A node without the field never fits, negated or not."""

    field: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    negated: bool = False


@dataclass
class Query:
    text: str = ""
    filters: list[Filter] = field(default_factory=list)
    boosts: dict[str, float] = field(default_factory=dict)


def parse(text: str) -> Query:
    """``f:v``, ``-f:v``, ``f:a,b``, ``f:lo..hi`` and ``^f:factor``, separated by white space; all else is text."""
    query, words = Query(), []
    for word in text.split():
        name, colon, value = word.lstrip("-^").partition(":")
        if not colon or not name or not value:
            words.append(word)
        elif word.startswith("^"):
            query.boosts[name] = float(value)
        elif ".." in value:
            low, _, high = value.partition("..")
            query.filters.append(Filter(name, (), float(low) if low else None, float(high) if high else None, word.startswith("-")))
        else:
            query.filters.append(Filter(name, tuple(value.split(",")), negated=word.startswith("-")))
    query.text = " ".join(words)
    return query


def matching(g: Graph, filters: list[Filter]) -> DataFrame:
    """The nodes that fit all filters; none if there is no filter."""
    if not filters:
        return g.nodes.limit(0)
    rows = g.nodes
    for f in filters:
        value = F.col("data")[f.field]
        fits: Any = value.isin(*f.values) if f.values else F.lit(True)
        number = value.try_cast("double")
        for bound, test in ((f.low, number >= F.lit(f.low)), (f.high, number <= F.lit(f.high))):
            fits = fits if bound is None else fits & F.coalesce(test, F.lit(False))
        rows = rows.where(value.isNotNull() & (~fits if f.negated else fits))
    return rows


def text_match(index: DataFrame, words: list[str]) -> DataFrame:
    """id, field of the fields that have all words."""
    wanted = [w.lower() for w in words]
    return tokens(index).where(F.col("token").isin(wanted)).groupBy("id", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select("id", "field")


def facets(g: Graph, fields: list[str], filters: list[Filter] | None = None) -> DataFrame:
    """field, value, n over the nodes that fit the filters (all without any); a field's own filter doesn't count for it."""
    out = None
    for name in fields:
        others = [f for f in filters or [] if f.field != name]
        rows = (matching(g, others) if others else g.nodes).select(F.lit(name).alias("field"), F.col("data")[name].alias("value")).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def facet_scores(index: DataFrame) -> DataFrame:
    """field, score: entropy (bits) times log2 of the number of values, for fields of 2 to 100 values, else 0."""
    counts = index.groupBy("field", "sval").agg(F.count("*").alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    p = F.col("n") / F.col("total")
    entropy = counts.join(total, "field").groupBy("field").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.max("k").alias("k"))
    return entropy.select("field", F.when(F.col("k").between(2, 100), F.col("entropy") * F.log2(F.col("k").cast("double"))).otherwise(0.0).alias("score"))


def suggest(index: DataFrame, name: str, prefix: str, top_k: int = 10) -> DataFrame:
    """value: the first top_k values, in lowered order, that begin with the prefix, whatever the case."""
    rows = index.where((F.col("field") == name) & F.lower("sval").startswith(prefix.lower())).select(F.col("sval").alias("value")).distinct()
    return rows.orderBy(F.lower("value"), "value").limit(top_k)


def build(text: str = "", filters: dict[str, Any] | None = None, boosts: dict[str, float] | None = None) -> Query:
    """A query from parts: a filter is a value, a tuple of values, or a pair (low, high) of numbers or None."""
    out = Query(text, boosts=dict(boosts or {}))
    for name, value in (filters or {}).items():
        if isinstance(value, tuple) and len(value) == 2 and not any(isinstance(v, str) for v in value):
            out.filters.append(Filter(name, (), *value))
        else:
            out.filters.append(Filter(name, value if isinstance(value, tuple) else (str(value),)))
    return out


def index_stats(index: DataFrame) -> DataFrame:
    """field, entries, values: how many nodes have a field, and how many different values."""
    return index.groupBy("field").agg(F.count("*").alias("entries"), F.countDistinct("sval").alias("values"))


def field_values(index: DataFrame, name: str) -> DataFrame:
    """value: the different values of a field, in order."""
    return index.where(F.col("field") == name).select(F.col("sval").alias("value")).distinct().orderBy("value")


def plan(g: Graph, query: Query, vectors: bool = False) -> tuple[str, float]:
    """The strategy for a query and the share of nodes that its filters leave.

    Without text: browse. Filters that leave under 0.01: index_only; under 0.1: index_then_embed where there are vectors, else
    index_then_activate. Text without filters: embed_only or activate_only. All else: hybrid.
    """
    share = matching(g, query.filters).count() / max(g.nodes.count(), 1) if query.filters else 1.0
    if query.filters and not query.text:
        return "browse", share
    if query.filters and share < 0.01:
        return "index_only", share
    if query.filters and share < 0.1:
        return "index_then_embed" if vectors else "index_then_activate", share
    if query.text and not query.filters:
        return "embed_only" if vectors else "activate_only", share
    return "hybrid", share


def score(candidates: DataFrame, activation: DataFrame | None = None, similarity: DataFrame | None = None, boosts: dict[str, float] | None = None, min_score: float = 0.0) -> DataFrame:
    """id, score of candidates(id, data): the mean of 1 (being found by the index), 0.4 times activation(id, score) and 0.6 times similarity(id, score), weighted 1, 0.4 and 0.6; times the boosts of the fields that a node has."""
    rows, total, weights = candidates, F.lit(1.0), 1.0
    for name, table, weight in (("act", activation, 0.4), ("sim", similarity, 0.6)):
        if table is not None:
            rows = rows.join(table.select("id", F.col("score").alias(name)), "id", "left")
            total, weights = total + weight * F.coalesce(name, F.lit(0.0)), weights + weight
    boost = F.lit(1.0)
    for field_name, factor in (boosts or {}).items():
        boost = boost * F.when(F.col("data")[field_name].isNotNull(), factor).otherwise(1.0)
    return rows.select("id", (total / weights * boost).alias("score")).where(F.col("score") >= min_score)


def search(g: Graph, query: Query, top_k: int = 10, offset: int = 0, activation: DataFrame | None = None, similarity: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """rank, id, label, score: a page of what fits filters and text, by score, ties by id. Without filters and text all nodes are candidates."""
    rows = matching(g, query.filters) if query.filters else g.nodes
    if query.text:
        rows = rows.join(text_match(attribute_index(g), query.text.split()).select("id").distinct(), "id", "left_semi")
    found = score(rows.select("id", "data"), activation, similarity, query.boosts, min_score)
    page = found.orderBy(F.desc("score"), "id").limit(offset + top_k)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint")).where(F.col("rank") > offset)
    return ranked.join(g.nodes.select("id", "label"), "id").select("rank", "id", "label", "score")
