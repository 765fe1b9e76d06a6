"""Near copies by the exact Jaccard index of word shingles, found by prefix filtering.

Two sets of shingles with an index of 0.8 share at least four fifths of each. So if the shingles of all texts are put in one order,
the first fifth of one set, and one more, has a shingle in common with that of the other: texts are compared only where
these prefixes meet, and no pair is missed. The order is by how often a shingle occurs, the rarest first, so a text of which
more than a fifth occurs nowhere else is compared with none.

Each set has a bitmap, in which every shingle turns one bit over. Bits in which two bitmaps differ come from shingles that only one
of the two has, so their number is at most that of these shingles: pairs with too many are apart for certain, and are dropped where the prefixes meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpoint, text_chunks
from weft.llm.components import components
from weft.llm.simhash import LOWER

#: Rounds in which a text is compared with a few others only, and with how many, before all that are still apart are compared. Results do not depend on them.
TURNS, PICKS = 1, 16
#: 64-bit words of a bitmap. Results do not depend on it.
WORDS = 16


def joined_words(text: str | None) -> bytes:
    """The words of a text, with A-Z lowered and one blank between them."""
    return b" ".join(text.encode().translate(LOWER).split()) if text else b""


def key_of(words: bytes) -> int:
    """What stands for a text: a 64-bit hash of its words."""
    return xxhash.xxh64_intdigest(words) if words else 0


def shingles(words: bytes, size: int = 5) -> np.ndarray:
    """The distinct hashes (64 bits) of the shingles; fewer words are one shingle, no words none."""
    parts = words.split()
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(words)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(words[a:b]) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def _alike(a: Column, b: Column) -> Column:
    """Sizes with which an index of 0.8 is possible."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """sets with columns b0, b1, ..: the words of the bitmap of hs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = batch.column(batch.schema.get_field_index("hs"))
            sizes = np.diff(hs.offsets.to_numpy())
            flat = hs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.zeros((len(sizes), WORDS), np.uint64)
            np.bitwise_xor.at(bits, (np.repeat(np.arange(len(sizes)), sizes), (flat % np.uint64(WORDS)).astype(np.int64)), np.uint64(1) << (flat // np.uint64(WORDS) % np.uint64(64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(WORDS))], [*batch.schema.names, *(f"b{k}" for k in range(WORDS))])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema.fields)
    return sets.mapInArrow(run, kinds + "".join(f", b{k} bigint" for k in range(WORDS)))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with an index of 0.8 or more. Shingles that occur in one text only are missing in hs, but not in n."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"h{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def similar_links(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """Links (a, b) between keys of texts, enough to connect any two with an index of 0.8 or more; each is of two such texts.

    texts: one column text. In the first rounds a text is compared with at most PICKS others, those whose shingles are the most frequent, which connects
    most of a large group of near copies; then all whose prefixes meet, whose bitmaps allow it and that are not connected yet are compared.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in text_chunks(batches, chars=500_000):
            words = [joined_words(t) for t in some]
            sets = [shingles(w, shingle) for w in words]
            n = np.array([s.size for s in sets], np.int32)
            keys = np.array([key_of(w) for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate([*sets, np.array([], np.uint64)]).view(np.int64))], ["key", "n", "h"])

    prints = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key bigint, n int, h bigint")
    of_h = Window.partitionBy("h")
    shared = prints.select("*", F.count("*").over(of_h).alias("df"), F.min("key").over(of_h).alias("lo"), F.max("key").over(of_h).alias("hi")).where("lo < hi")
    # repeated texts have one key, so their shingles are counted once
    sets = shared.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    least = F.floor((4 * F.col("n") + 4) / 5).cast("int")
    central = F.aggregate("s", F.lit(0.0), lambda x, e: x + e["df"]) / F.col("n")
    sets = sets.where(F.size("s") >= least).select("key", "n", (F.col("n") - F.size("s")).alias("alone"), central.alias("central"), F.col("s.h").alias("hs"), F.slice(F.col("s.h"), F.lit(1), F.size("s") - least + 1).alias("prefix"))
    sets = checkpoint(with_bitmaps(sets))
    bits = [f"b{k}" for k in range(WORDS)]
    meets = sets.select("key", "n", "alone", "central", *bits, F.explode("prefix").alias("h"))

    links, roots = None, None
    for turn in range(TURNS + 1):
        live = meets.withColumn("root", F.col("key")) if roots is None else meets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        live = live.select("*", F.min("root").over(of_h).alias("lo"), F.max("root").over(of_h).alias("hi")).where("lo < hi")
        if turn < TURNS:
            lead = F.min(F.struct((-F.col("central")).alias("x"), F.xxhash64("key", F.lit(turn)).alias("y"), "key", "n", "root")).over(of_h)
            near = live.select("key", "n", "root", lead.alias("l")).where(F.col("root") != F.col("l.root")).where(_alike(F.col("n"), F.col("l.n")))
            picks = near.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct("l.x", "l.y", "l.key"))), 1, PICKS).alias("picks"))
            pairs = picks.select(F.col("key").alias("b"), F.explode("picks.key").alias("a"))
        else:
            live = checkpoint(live.select("h", "key", "n", "alone", "root", *bits))
            side = lambda c: live.select("h", *[F.col(x).alias(f"{c}_{x}") for x in ("key", "n", "alone", "root", *bits)])
            apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in bits], F.col("a_alone") + F.col("b_alone"))
            close = (F.col("a_key") < F.col("b_key")) & (F.col("a_root") != F.col("b_root")) & _alike(F.col("a_n"), F.col("b_n")) & (9 * apart <= F.col("a_n") + F.col("b_n"))
            pairs = side("a").join(side("b"), "h").where(close).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()
        found = checkpoint(_confirmed(pairs, sets))
        links = found if links is None else links.unionByName(found)
        if turn < TURNS and (turn == 0 or not found.isEmpty()):
            roots = components(links)
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Per row: id_col, text_hash (Spark's xxhash64 of the text), component_id and component_text.

    Texts whose sets of shingles have a Jaccard index of 0.8 or more are linked; component_id is the smallest id that can be reached over links, the
    row's own included. A-Z are lowered and words are separated by ASCII white space; texts are told apart, and shingles compared, by
    64-bit hashes. Null and empty texts have no words and are linked with each other only. Repeated rows come out as they came
    in; a null id gets the smallest other id of its component, or null. component_text is the text_hash of the row that has the smallest
    id, the least of them if several rows have that id. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            keys = np.array([key_of(joined_words(t)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys)], ["id", "text_hash", "key"])

    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("string").alias("text"))
    found = checkpoint(rows.mapInArrow(run, f"id {kind}, text_hash bigint, key bigint"))
    roots = components(similar_links(rows.select("text"), shingle)).withColumnRenamed("node", "key")
    rooted = found.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    return rooted.join(least, "root").select(F.col("id").alias(id_col), "text_hash", F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("component_text"))
