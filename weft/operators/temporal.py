"""Intervals: Allen's relations, interval joins, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.iterate import checkpoint

#: The relations in which two intervals share more than an end.
OVERLAPPING = ("equals", "overlaps", "overlapped_by", "during", "contains", "starts", "started_by", "finishes", "finished_by")


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Allen's relation of [a0, a1] to [b0, b1]. Touching ends count before shared starts, so points at an interval's end meet it."""
    return (
        F.when((a0 == b0) & (a1 == b1), "equals").when(a1 == b0, "meets").when(a0 == b1, "met_by").when(a1 < b0, "before").when(a0 > b1, "after")
        .when(a0 == b0, F.when(a1 < b1, "starts").otherwise("started_by")).when(a1 == b1, F.when(a0 < b0, "finished_by").otherwise("finishes"))
        .when((a0 < b0) & (a1 > b1), "contains").when((a0 > b0) & (a1 < b1), "during").when(a0 < b0, "overlaps").otherwise("overlapped_by")
    )


def valid(events: DataFrame) -> DataFrame:
    """Events whose ends are numbers, the start not behind the end."""
    return events.where(~F.isnan("start") & ~F.isnan("end") & (F.col("start") <= F.col("end")))


def relate_to(events: DataFrame, start: float, end: float) -> DataFrame:
    """event_id and relation of each event to the interval [start, end]."""
    return events.select("event_id", relation(F.col("start"), F.col("end"), F.lit(start), F.lit(end)).alias("relation"))


def _cells(events: DataFrame, reach: float, width: float) -> DataFrame:
    """events with each cell of ``width`` that they, widened by reach, touch: an equality to join ranges by."""
    cell = lambda x: F.floor(x / width)
    return events.withColumn("cell", F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("end") + reach))))


def close_pairs(events: DataFrame, max_gap: float, key: str | None = None, width: float | None = None) -> DataFrame:
    """a < b, gap, relation: events (of one key) at most max_gap apart; gap is 0 where they overlap.

    Intervals are joined by the cells that they touch, each pair in the first cell that both touch, so rows
    meet only near each other. width: of a cell; by default the mean length plus max_gap.
    """
    if width is None:
        width = max(float(events.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0) + max_gap, 1e-6)
    side = lambda p: _cells(events, max_gap / 2, width).select("cell", *([key] if key else []), F.col("event_id").alias(p), F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"))
    rows = side("a").join(side("b"), ["cell", *([key] if key else [])]).where("a < b")
    first = F.greatest(F.floor((F.col("a0") - max_gap / 2) / width), F.floor((F.col("b0") - max_gap / 2) / width))
    gap = F.greatest(F.lit(0.0), F.greatest("a0", "b0") - F.least("a1", "b1"))
    return rows.where(F.col("cell") == first).select("a", "b", gap.alias("gap"), relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("relation")).where(F.col("gap") <= max_gap)


def overlapping(events: DataFrame, key: str | None = None) -> DataFrame:
    """a < b, relation of events (of one key) that share more than an end."""
    return close_pairs(events, 0.0, key).where(F.col("relation").isin(*OVERLAPPING)).select("a", "b", "relation")


def chains(events: DataFrame, key: str, max_gap: float, length: int) -> DataFrame:
    """path (ids, comma-joined) of ``length`` events of one key, each before or met by the next, at most max_gap apart."""
    pairs = close_pairs(events, max_gap, key)
    ahead = pairs.where(F.col("relation").isin("before", "meets")).select("a", "b").unionByName(pairs.where(F.col("relation").isin("after", "met_by")).select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = checkpoint(ahead)
    at = step.select(F.array("a", "b").alias("path"), F.col("b").alias("last"))
    for _ in range(length - 2):
        at = checkpoint(at.join(step, F.col("last") == F.col("a")).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last")))
    return at.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def violated(events: DataFrame, constraints: DataFrame) -> DataFrame:
    """a, b, declared, actual of the constraints (a, b, declared) that the events' intervals don't fulfil."""
    side = lambda p: events.select(F.col("event_id").alias(p), F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"))
    rows = constraints.join(side("a"), "a").join(side("b"), "b").select("a", "b", "declared", relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("actual"))
    return rows.where("declared <> actual")


def at(events: DataFrame, t: float) -> DataFrame:
    """The events whose interval has t, ends included."""
    return events.where((F.col("start") <= t) & (F.col("end") >= t))


def related(events: DataFrame, event_id, relations: tuple[str, ...]) -> DataFrame:
    """event_id, relation of the events that stand in one of the relations to the given one."""
    one = events.where(F.col("event_id") == event_id).agg(F.min("start").alias("s"), F.max("end").alias("e"))
    rows = events.where(F.col("event_id") != event_id).withColumn("s", one.select("s").scalar()).withColumn("e", one.select("e").scalar())
    found = rows.select("event_id", relation(F.col("start"), F.col("end"), F.col("s"), F.col("e")).alias("relation"))
    return found.where(F.col("relation").isin(*relations))


def constraints(events: DataFrame, key: str) -> DataFrame:
    """a < b, relation of all pairs of events of one key. Every pair is a row: keys are to have few events each."""
    side = lambda p: events.select(key, F.col("event_id").alias(p), F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"))
    rows = side("a").join(side("b"), key).where("a < b")
    return rows.select("a", "b", relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("relation"))


def spans(events: DataFrame, key: str) -> DataFrame:
    """key, start, end: from the first start to the last end of the key's events."""
    return events.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def inconsistent(span: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """a, b, relation of the pairs(a, b) of keys of which the first should not come after the second but does, or was started by it."""
    side = lambda p: span.select(F.col(key).alias(p), F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", relation(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("relation"))
    return rows.where(F.col("relation").isin("after", "started_by"))
