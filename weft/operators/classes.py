"""Rows that are alike as classes: what is compared is one of each class, and pairs of classes are spread to their members at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.iterate import checkpoint


def classes(rows: DataFrame, *by: str, piece: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Of rows(id, by..): classes(c, by..), a row for each value of ``by``, and members(c, piece, ids), a class's ids in sorted lists of ``piece`` at most. Both are written once."""
    lists = dealt(rows, *by, piece=piece)
    kinds = checkpoint(lists.where("piece = 0").select(*by).withColumn("c", F.monotonically_increasing_id()))
    same = [F.col(f"k.{x}").eqNullSafe(F.col(f"r.{x}")) for x in by]
    return kinds, checkpoint(lists.alias("r").join(kinds.alias("k"), same).select("c", "piece", "ids"))


def dealt(rows: DataFrame, *by: str, piece: int = 1000) -> DataFrame:
    """by.., piece, ids: the ids of rows(id, by..) with the same values, in sorted lists of ``piece`` at most. The rows are read and shuffled once; what is written is lists."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    own = rows.select("id", *by).withColumn("piece", F.floor((place - 1) / piece).cast("int"))
    return checkpoint(own.groupBy(*by, "piece").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def _meeting(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pa <= pb, ia, ib and the further columns of pairs(ca, cb, ..): the lists of which each two ids are a pair."""
    more = [c for c in pairs.columns if c not in ("ca", "cb")]
    side = lambda x: members.select(F.col("c").alias(f"c{x}"), F.struct("c", "piece").alias(f"p{x}"), F.col("ids").alias(f"i{x}"))
    both = pairs.join(side("a"), "ca").join(side("b"), "cb").where("ca <> cb or pa <= pb")
    return both.select(_first("pa", "pb").alias("pa"), _first("pb", "pa").alias("pb"), _first("ia", "ib").alias("ia"), _first("ib", "ia").alias("ib"), *more)


def _first(x: str, y: str) -> Column:
    return F.when(F.col("pa") > F.col("pb"), F.col(y)).otherwise(F.col(x))


def lists_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """xs, ys, own: what spread(pairs, members) gives, as lists: each x with each y, or where ``own`` holds each two of xs."""
    return _meeting(pairs, members).select(F.col("ia").alias("xs"), F.col("ib").alias("ys"), (F.col("pa") == F.col("pb")).alias("own"))


def _brought(known: DataFrame, of: DataFrame) -> DataFrame:
    """pa <= pb, xs, ys, whole of lists known(xs, ys, own): their parts in each two of the lists of(p, n, id); whole: the parts are all of both."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("xs").alias("ids")), F.struct(F.lit(1).alias("side"), F.col("ys").alias("ids")))
    rows = known.withColumn("k", F.monotonically_increasing_id()).select("k", "own", F.explode(sides).alias("s")).select("k", "own", "s.side", F.explode("s.ids").alias("id"))
    parts = rows.join(of, "id").groupBy("k", "own", "side", "p", "n").agg(F.collect_set("id").alias("ids"))
    on = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("p", "n", "ids")))
    both = parts.groupBy("k", "own").agg(on(0).alias("as"), on(1).alias("bs")).select("own", F.explode("as").alias("a"), "bs").select("own", "a", F.explode("bs").alias("b"))
    both = both.where("not own or a.p <= b.p").select(F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), F.col("a.ids").alias("x"), F.col("b.ids").alias("y"), ((F.size("a.ids") == F.col("a.n")) & (F.size("b.ids") == F.col("b.n"))).alias("whole"))
    return both.select(_first("pa", "pb").alias("pa"), _first("pb", "pa").alias("pb"), _first("x", "y").alias("xs"), _first("y", "x").alias("ys"), "whole")


def spread(pairs: DataFrame, members: DataFrame, but: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """a < b and the other columns of pairs(ca, cb, ..), each two classes once, a class with itself as well: all pairs of their members.

    but(a, b), a < b: pairs left out. known(xs, ys, own): pairs left out as well, as lists_of gives them. Both are brought to the lists that they are from; the pairs
    that stay are not shuffled, and lists that are known as a whole are left out without their pairs.
    """
    more = [c for c in pairs.columns if c not in ("ca", "cb")]
    both, out = _meeting(pairs, members), None
    if but is not None:
        of = members.select(F.struct("c", "piece").alias("p"), F.explode("ids").alias("id"))
        at = but.join(of.toDF("pa", "a"), "a").join(of.toDF("pb", "b"), "b")
        out = at.select(_first("pa", "pb").alias("pa"), _first("pb", "pa").alias("pb"), _first("a", "b").alias("x"), _first("b", "a").alias("y"))
        out = out.groupBy("pa", "pb", "x").agg(F.collect_set("y").alias("ys"))
    if known is not None:
        of = members.select(F.struct("c", "piece").alias("p"), F.size("ids").alias("n"), F.explode("ids").alias("id"))
        lists = checkpoint(_brought(known, of))
        both = both.join(lists.where("whole").select("pa", "pb").distinct(), ["pa", "pb"], "left_anti")
        ways = F.array(F.struct(F.col("xs").alias("x"), F.col("ys").alias("y")), F.when(F.col("pa") == F.col("pb"), F.struct(F.col("ys").alias("x"), F.col("xs").alias("y"))))
        part = lists.where("not whole").select("pa", "pb", F.explode(ways).alias("w")).where("w is not null").select("pa", "pb", F.explode("w.x").alias("x"), F.col("w.y").alias("ys"))
        out = (part if out is None else out.unionByName(part)).groupBy("pa", "pb", "x").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    if out is not None:
        out = out.groupBy("pa", "pb").agg(F.map_from_entries(F.collect_list(F.struct("x", "ys"))).alias("out"))
        both = both.join(out, ["pa", "pb"], "left")
    # few rows that become many: dealt out by number, as adaptive plans would put them in one task
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pa", "pb")
    one = both.select("pa", "pb", F.posexplode("ia").alias("i", "x"), "ib", *more, *(["out"] if out is not None else []))
    ys = F.when(F.col("pa") == F.col("pb"), F.slice("ib", F.col("i") + 2, F.size("ib"))).otherwise(F.col("ib"))
    if out is not None:
        ys = F.when(F.col("out").isNull(), ys).otherwise(F.array_except(ys, F.coalesce(F.col("out")[F.col("x")], F.array().cast("array<string>"))))
    return one.select("x", F.explode(ys).alias("y"), *more).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *more)
