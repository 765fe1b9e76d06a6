"""States of a multiway expansion as a table states(state, parent, nodes): what siblings differ in, which states are alike, paths between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import inference
from weft.operators.alike import alike, items_of, pairs_of
from weft.operators.classes import classes, dealt, spread
from weft.operators.paths import components
from weft.plans.iterate import checkpoint


def similar_sets(sets: DataFrame, least: float, digits: int | None = None) -> DataFrame:
    """a < b, similarity of sets(id, items) with a Jaccard index of ``least`` or more (above 0), rounded to so many digits."""
    index = F.col("shared") / (F.col("sizes") - F.col("shared"))
    return _similar(sets, least, (index if digits is None else F.round(index, digits)).alias("similarity"))


def _similar(sets: DataFrame, least: float, *columns: Column) -> DataFrame:
    """a < b, and columns over shared and sizes, which are computed once for all pairs that leave a task together.

    Where few items occur in all, blocks of sets are compared as bits; else sets meet over their rare items.
    """
    lists = dealt(_whole(sets), "items")
    if (items := items_of(lists)) is not None:
        return pairs_of(alike(lists, items, least).select("xs", "ys", "own", "sure", *columns))
    found, members = similar_classes(sets, least)
    return spread(found.select("ca", "cb", *columns), members)


def _whole(sets: DataFrame) -> DataFrame:
    """The sets as sorted items, without nulls; none that is empty."""
    return sets.select("id", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where(F.size("items") > 0)


def similar_classes(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """ca <= cb, shared, sizes (of both together), similarity of classes of equal sets, those of one set included, and members(c, piece, ids) of the classes; empty sets are in none.

    Items are put in order of how many classes have them, the rarest first. Two sets that share so much have an item in common among the first
    n - ceil(least n) + 1 of each, so they meet over these only, and only where their sizes allow the index. No pair is missed.
    """
    kinds, members = classes(_whole(sets), "items")
    items = kinds.select(F.col("c").alias("id"), F.explode("items").alias("x"))
    rare = items.groupBy("x").agg(F.count("*").alias("df"))
    rows = items.join(rare, "x").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda s: s["x"]).alias("xs")).withColumn("n", F.size("xs"))
    # 128 bits, set by hashes of the items: two sets have no more in common than bits, and what fell on one bit in the first
    word = lambda k: F.aggregate("xs", F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.when(F.pmod(F.shiftright(F.xxhash64(x), 6), F.lit(2)) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint"))))
    rows = checkpoint(rows.withColumn("lo", word(0)).withColumn("hi", word(1)).withColumn("spare", F.col("n") - F.bit_count("lo") - F.bit_count("hi")))
    prefix = F.col("n") - F.greatest(F.ceil(least * F.col("n") - 1e-9), F.lit(1)).cast("int") + 1
    meet = rows.select("id", "n", "lo", "hi", "spare", "xs", F.slice("xs", F.lit(1), prefix).alias("first"), F.explode(F.slice("xs", F.lit(1), prefix)).alias("x"))
    side = lambda c: meet.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("xs").alias(f"x{c}"), F.col("first").alias(f"f{c}"), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}"), F.col("spare").alias(f"s{c}"), "x")
    pairs = side("a").join(side("b"), "x").where("a < b").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    most = F.bit_count(F.col("loa").bitwiseAND(F.col("lob"))) + F.bit_count(F.col("hia").bitwiseAND(F.col("hib"))) + F.col("sa")
    pairs = pairs.where(most >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)
    common = F.size(F.array_intersect("xa", "xb"))
    # a pair meets at each item that both have among their first ones; the first of them counts
    first = F.element_at(F.array_intersect("fa", "fb"), 1) == F.col("x")
    found = pairs.where(first).select(F.col("a").alias("ca"), F.col("b").alias("cb"), common.cast("bigint").alias("shared"), (F.col("na") + F.col("nb")).alias("sizes")).withColumn("similarity", F.col("shared") / (F.col("sizes") - F.col("shared")))
    own = kinds.select(F.col("c").alias("ca"), F.col("c").alias("cb"), F.size("items").cast("bigint").alias("shared"), (2 * F.size("items")).alias("sizes"), F.lit(1.0).alias("similarity"))
    return found.where(F.col("similarity") >= least - 1e-12).unionByName(own), members


def leaves(states: DataFrame) -> DataFrame:
    """The states that are no state's parent. Each row meets those that name it as their parent, so the states are computed once."""
    row = F.struct(*states.columns)
    named = F.when(F.lit(False), row)  # no row of its own: null, of that type
    both = F.array(F.struct(F.col("state").alias("key"), row.alias("row")), F.struct(F.col("parent").alias("key"), named.alias("row")))
    rows = states.select(F.explode(both).alias("x")).select("x.key", "x.row").where("key is not null or row is not null")
    named = F.max(F.col("row").isNull()).over(Window.partitionBy("key"))
    return rows.withColumn("named", named).where("row is not null and not named").select("row.*")


def produced(states: DataFrame) -> DataFrame:
    """state, parent, new: the nodes of each state that its parent doesn't have; all of a state without parent."""
    up = states.select(F.col("state").alias("parent"), F.col("nodes").alias("old"))
    rows = states.join(up, "parent", "left")
    return rows.select("state", "parent", F.array_sort(F.array_except("nodes", F.coalesce("old", F.array().cast("array<string>")))).alias("new"))


def siblings_of(states: DataFrame) -> DataFrame:
    """a, b: each two different states of one parent, in both orders."""
    side = lambda c: states.where("parent is not null").select("parent", F.col("state").alias(c))
    return side("a").join(side("b"), "parent").where("a <> b").select("a", "b")


def groups(states: DataFrame, least: int = 2) -> DataFrame:
    """parent, states (sorted): those that share a parent, where there are ``least`` or more."""
    return states.where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_set("state")).alias("states")).where(F.size("states") >= least)


def lateral_insights(states: DataFrame, state: str) -> DataFrame:
    """sibling, own, other: what the state produced and a sibling didn't, and the other way round, where there is any difference."""
    new = checkpoint(produced(states))
    one = new.where(F.col("state") == state).select("parent", F.col("new").alias("mine"))
    rows = new.join(one, "parent").where(F.col("state") != state)
    rows = rows.select(F.col("state").alias("sibling"), F.array_except("mine", "new").alias("own"), F.array_except("new", "mine").alias("other"))
    return rows.where((F.size("own") > 0) | (F.size("other") > 0))


def state_similarity(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of pairs(a, b): 0.7 of the nodes' Jaccard index and 0.3 of the produced nodes' one; two empty sets are alike."""
    both = states.select("state", "nodes").join(produced(states).select("state", "new"), "state")
    side = lambda c: both.select(F.col("state").alias(c), F.col("nodes").alias(f"n{c}"), F.col("new").alias(f"p{c}"))
    index = lambda x, y: F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(1.0)
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (0.7 * index("na", "nb") + 0.3 * index("pa", "pb")).alias("similarity"))


def correlations(states: DataFrame, least: float = 0.3, digits: int | None = None) -> DataFrame:
    """a < b, dice, shared: leaves whose nodes have a Dice coefficient of ``least`` or more, rounded to so many digits, with the number of common nodes."""
    dice = 2 * F.col("shared") / F.col("sizes")
    columns = (dice if digits is None else F.round(dice, digits)).alias("dice"), F.col("shared")
    return _similar(leaves(states).select(F.col("state").alias("id"), F.col("nodes").alias("items")), least / (2 - least), *columns)


def merged(states: DataFrame, least: float = 0.7) -> DataFrame:
    """state, into: the leaves that merge with others they are similar to, directly or over others, with the smallest state of each group."""
    # sets are joined, each with the list of its states, of which all are one group; the smallest state of a list names it
    lists = dealt(_whole(leaves(states).select(F.col("state").alias("id"), F.col("nodes").alias("items"))), "items")
    low = checkpoint(lists.groupBy("items").agg(F.min(F.get("ids", F.lit(0))).alias("id"), F.sum(F.size("ids")).alias("n")))
    pairs = similar_sets(low, least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    of = checkpoint(components(pairs, low).join(low, "id"))
    # a set of one state that is like no other has nothing to merge
    into = of.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    part = of.join(into, "component", "left_semi").select("items", F.col("component").alias("into"))
    return lists.join(part, "items").select(F.explode("ids").alias("state"), "into")


def near(states: DataFrame, state: str, most: float, least: float = 0.0) -> DataFrame:
    """state, distance of the states whose nodes differ from the given one's by a Jaccard distance of least to most; each is compared with the one."""
    one = states.where(F.col("state") == state).agg(F.first("nodes").alias("x"))
    rows = states.where(F.col("state") != state).withColumn("x", one.scalar())
    rows = rows.select("state", (1 - F.size(F.array_intersect("nodes", "x")) / F.greatest(F.size(F.array_union("nodes", "x")), F.lit(1))).alias("distance"))
    return rows.where(F.col("distance").between(least, most))


def transfer(states: DataFrame, source: str, target: str) -> DataFrame:
    """node: what the source has and the target lacks."""
    pick = lambda s: states.where(F.col("state") == s).select(F.explode("nodes").alias("node")).distinct()
    return pick(source).join(pick(target), "node", "left_anti")


def plan_path(states: DataFrame, source: str, target: str) -> DataFrame:
    """place, state: the way from one state to another over parents: up to their nearest common ancestor, then down."""
    two = states.where(F.col("state").isin(source, target))
    up = checkpoint(inference.ancestors_of(states, two))
    both = up.where(F.col("state") == source).select("ancestor", F.col("d").alias("da")).join(up.where(F.col("state") == target).select("ancestor", F.col("d").alias("db")), "ancestor")
    top = checkpoint(both.agg(F.min(F.struct((F.col("da") + F.col("db")).alias("all"), "ancestor", "da", "db")).alias("m")).where("m is not null").select("m.*"))
    rise = up.where(F.col("state") == source).withColumn("da", top.select("da").scalar()).where("d <= da").select(F.col("d").alias("place"), F.col("ancestor").alias("state"))
    fall = up.where(F.col("state") == target).withColumn("all", top.select("all").scalar()).withColumn("db", top.select("db").scalar()).where("d < db").select((F.col("all") - F.col("d")).alias("place"), F.col("ancestor").alias("state"))
    return rise.unionByName(fall)
