"""Benchmark decontamination by winnowing.

Of every window of ``span - GRAM + 1`` consecutive GRAM-word hashes the least is kept as a fingerprint, in benchmark items
and documents alike. A passage of ``span`` words that both have makes up such a window in both, so they have its
fingerprint in common: none is missed. Documents and items are joined by fingerprints, and each hit is extended over all windows
that document and item share, which are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpoint, flagged, hash_filter

#: Words in a hashed gram.
GRAM = 4
#: Fixed value: what is between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of fingerprints up to which they are broadcast; with more, both sides are shuffled.
BROADCAST = 8 << 20
#: Items that a document's row meets at a time.
ITEMS = 64


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def pairwise(values: Column, size: Column, apart: int, combine) -> Column:
    """combine(values[i], values[i + apart]) for each i that has both. size: of values."""
    n = F.greatest(size - apart, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(apart + 1), n), combine)


def with_grams(rows: DataFrame) -> DataFrame:
    """rows with words; adds n, the hash of each word (one) and of each gram (four). Each step is a projection of its own, computed once."""
    rows = rows.withColumn("n", F.size("words")).withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two", pairwise(F.col("one"), F.col("n"), 1, lambda a, b: F.xxhash64(a, b)))
    return rows.withColumn("four", pairwise(F.col("two"), F.col("n") - 1, 2, lambda a, b: F.xxhash64(a, b))).drop("two")


def with_least(rows: DataFrame, width: int) -> DataFrame:
    """Adds least, of each window of that many grams the least hash, by doubling the width and one overlapping step."""
    rows, size, have = rows.withColumn("least", F.col("four")), F.col("n") - (GRAM - 1), 1
    while have < width:
        apart = min(have, width - have)
        rows = rows.withColumn("least", pairwise(F.col("least"), size, apart, lambda a, b: F.least(a, b)))
        size, have = size - apart, have + apart
    return rows


def with_windows(rows: DataFrame, span: int) -> DataFrame:
    """Adds windows, the hash of each stretch of span words: of the grams that make it up, by doubling and one overlapping step."""
    rows, size, have = rows.withColumn("windows", F.col("four")), F.col("n") - (GRAM - 1), GRAM
    while have < span:
        apart = min(have, span - have)
        rows = rows.withColumn("windows", pairwise(F.col("windows"), size, apart, lambda a, b: F.xxhash64(a, b)))
        size, have = size - apart, have + apart
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: id_col, n_words, n_hit, hit_spans, items and contaminated.

    A benchmark item's windows are its stretches of span words; an item of fewer words, but not none, is one window.
    A word inside an occurrence of a window is hit: n_hit counts these words, and hit_spans has their stretches as (start, end), word
    numbers from 0, the end exclusive. items has the ids of the items of which a window occurs, as strings, sorted. contaminated: some word is
    hit, and at least one in twenty. Null and empty texts have no words, and items without words have no window. Items of equal id count as
    one item each of whose texts has windows; a null item id is left out of the list but its hits count. Repeated rows come
    out as they came in, null ids as well; an empty table gives an empty one, an empty benchmark hits nothing. Other columns, whatever
    their names, are not read.

    Items shorter than a window are found by a hash of their longest word instead. Only texts that a hash filter of the hits may have are
    shuffled; each meets its items ITEMS at a time, so a row holds one text and so many items however many it meets.
    """
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), words_of(benchmark[item_text]).alias("words")).where(F.size("words") > 0).distinct()
    items = with_windows(with_least(with_grams(items), span - GRAM + 1), span).withColumn("key", F.xxhash64("item", "words"))
    longest = F.array_position("words", F.reduce("words", F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)))
    short = F.col("n") < span
    prints = F.when(short, F.array(F.get("one", longest.cast("int") - 1))).otherwise(F.array_distinct("least"))
    items = items.select("item", "key", F.col("words").alias("iw"), "windows", prints.alias("prints"), short.alias("short"), (longest - 1).cast("int").alias("longest"))
    sides = items.select("key", "short", F.explode("prints").alias("h"))
    size = sides.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("short").cast("int")), F.lit(0)).alias("short")).first()

    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("th"))
    split = own.select("id", "th", words_of(F.col("text")).alias("words"))
    hashed = with_least(with_grams(split), span - GRAM + 1)
    # only where there are short items, words are fingerprints too
    marks = F.array_distinct(F.concat("least", "one") if size.short else F.col("least"))
    marks = hashed.select("id", "th", F.explode(marks).alias("h"))
    wanted = sides.select("h", "key").distinct()
    hits = checkpoint(marks.join(F.broadcast(wanted) if size.n * 16 <= BROADCAST else wanted, "h").select("id", "th", "key").distinct())
    turn = F.floor((F.row_number().over(Window.partitionBy("id", "th").orderBy("key")) - 1) / ITEMS)
    met = hits.withColumn("turn", turn).join(items, "key").groupBy("id", "th", "turn").agg(F.collect_list(F.struct("item", "iw", "windows", "prints", "short", "longest")).alias("hits"))
    met = met.withColumnsRenamed({"id": "hid", "th": "hth"}).drop("turn")

    maybe = flagged(own, F.xxhash64("id", "th"), hash_filter(hits.select(F.xxhash64("id", "th"))), "maybe").where("maybe").select("id", "th", "text").dropDuplicates(["id", "th"])
    both = maybe.join(met, F.col("id").eqNullSafe(F.col("hid")) & F.col("th").eqNullSafe(F.col("hth"))).select("id", "th", words_of(F.col("text")).alias("words"), "hits")
    both = with_windows(with_grams(both), span).select("id", "th", "hits", once(["words", "one", "windows", "n", "hits"], lambda row: F.transform(row["hits"], lambda hit: _places(row, hit, span))).alias("places"))
    found = F.filter(F.transform(F.arrays_zip("hits", "places"), lambda x: F.when(F.size(x["places"]) > 0, x["hits"]["item"])), lambda i: i.isNotNull())
    judged = both.select("id", "th", F.array_distinct(F.flatten("places")).alias("places"), found.alias("items"))
    judged = judged.groupBy(F.col("id").alias("hid"), F.col("th").alias("hth")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = own.select("id", "th", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    out = counted.join(judged, F.col("id").eqNullSafe(F.col("hid")) & F.col("th").eqNullSafe(F.col("hth")), "left")
    n_hit = F.coalesce(F.greatest(F.size("places"), F.lit(0)), F.lit(0)).cast("bigint")
    spans, none = F.coalesce(stretches(F.col("places")), F.array().cast("array<struct<start:int,end:int>>")), F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), spans.alias("hit_spans"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def once(values: list, then) -> Column:
    """then(struct of values), with the values computed once: the optimizer would put them in each place where then uses one."""
    return F.get(F.transform(F.array(F.struct(*values)), then), F.lit(0))


def stretches(places: Column) -> Column:
    """The stretches (start, end) of consecutive numbers in a sorted array without repeats; the end is exclusive."""

    def edges(x: Column) -> Column:
        p = x["places"]
        starts = F.filter(p, lambda v, i: (i == 0) | (F.get(p, i - 1) < v - 1))
        ends = F.filter(p, lambda v, i: F.coalesce(F.get(p, i + 1) > v + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    return once([places.alias("places")], edges)


def _places(row: Column, hit: Column, span: int) -> Column:
    """The places in a document's words that an item's windows cover: windows of equal hash are compared word by word."""
    words, n, size = row["words"], row["n"], F.size(hit["iw"])

    def covered(starts: Column, width) -> Column:
        return F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1)))

    # a short item is laid where its longest word is
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(row["one"], i) == F.get(hit["prints"], F.lit(0)))
    laid = F.filter(F.transform(at, lambda i: i - hit["longest"]), lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, size) == hit["iw"]))

    def whole(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(row["windows"]) - 1), lambda i: F.array_contains(x["common"], F.get(row["windows"], i)))
        own = F.transform(places, lambda i: F.struct(i.alias("i"), (F.array_position(hit["windows"], F.get(row["windows"], i)) - 1).cast("int").alias("k")))
        same = F.filter(own, lambda p: F.slice(words, p["i"] + 1, F.lit(span)) == F.slice(hit["iw"], p["k"] + 1, F.lit(span)))
        return covered(F.transform(same, lambda p: p["i"]), F.lit(span))

    common = F.array_intersect(row["windows"], hit["windows"])
    long = F.when(F.size(common) > 0, once([common.alias("common")], whole))
    return F.array_distinct(F.coalesce(F.when(hit["short"], covered(laid, size)).otherwise(long), F.array().cast("array<int>")))
