"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import SALTS, salt, salt_set, salts_in

#: Fixed value: 2 ** 64, the step between lengths in a rank.
STEP = "18446744073709551616"
LAST_ID = "9223372036854775807"


def normal(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row: id_col, keep_id, group_size, kept and text_sha256 (of the text without ASCII white space).

    Texts are equal if they are identical without white space; null counts as empty. Of equal texts the longest original
    in code points, then the smallest id stays. ids are integers; a null one never stays beside another, and a group
    of null ids only has a null keep_id. Rows that repeat id and text count in group_size and are all kept.
    An empty table gives an empty one; other columns, whatever their names, are not read.

    Every task first combines its own rows of equal text; what is left of a group is dealt out over ``salts``
    tasks by a hash of the ids, and the winners of each meet in one task: at most ``salts`` rows of a group, however
    large it is. Both stages group by the digest and by the whole text, so texts whose digests agree by chance stay
    apart. Rows then meet their group's winner in the same salted parts, by the digest, a second, 64-bit hash of the text, its
    length and the salt, as the text is not shuffled a third time; the collision rule: should different texts agree in all of
    these, their rows come out once for each of the texts. salts: 64 at most. digest: the first of the two hashes, which
    is returned as text_sha256.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("length"), normal(text).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content"))).withColumn("salt", salt("id", salts=salts))
    check = [F.xxhash64("content", F.lit("content")).alias("check"), F.length("content").alias("size")]
    # longer first, then the smaller id, as one number of a fixed width
    rank = F.col("length").cast("decimal(10,0)") * F.lit(STEP).cast("decimal(20,0)") + (F.lit(LAST_ID).cast("decimal(20,0)") - F.col("id").cast("decimal(20,0)"))
    ranked = rows.select("digest", "content", "salt", rank.cast("decimal(38,0)").alias("rank"))
    salted = ranked.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"), salt_set(F.col("salt")).alias("salts"), F.min("salt").alias("salt"))
    keep = F.lit(LAST_ID).cast("decimal(20,0)") - F.col("rank") % F.lit(STEP).cast("decimal(20,0)")
    winners = groups.select("digest", *check, keep.cast("bigint").alias("keep_id"), F.col("n").alias("group_size"), F.explode(F.when(F.col("n") == 1, F.array("salt")).otherwise(salts_in(F.col("salts")))).alias("salt"))
    out = rows.select("id", "digest", "salt", *check).join(winners, ["digest", "check", "size", "salt"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))

