"""A corpus pipeline of five stages over the table of documents, each made of one operator of weft.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All stages but the last return the columns of docs as they came, extra ones included,
whatever their names. Rows are judged one by one, by id and text: null ids and repeated ids are no special case. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, line_dedup, near_copies, quality, word_bpe
from weft.llm.common import checkpoint, free_name, shared_folder, table

KEEP = 0.5


def with_keys(docs: DataFrame) -> DataFrame:
    """Each row as a struct, beside its id and a hash of its text: so its columns can't clash with those of a join."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def rows_of(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def same() -> Column:
    return F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of the highest grade is KEEP or more; toxic ones and those of low quality go.

    A null text is graded like an empty one, and equal texts, so repeated rows too, alike. Where no rating meets a document all rows stay.
    """
    model = quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")))
    return docs.where(quality.grade(docs, model)["tail_probability"] >= KEEP)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without later repeats of runs of 50 words or more; of one that is nothing but repeats no row is left.

    Null and empty texts stay as they are. Of equal runs the one in the row with the smallest id stays, null ids first. Rows that repeat id
    and text come out alike. n_chars follows the text where something was deleted.
    """
    deleted, lines = (free_name(c, docs.columns) for c in ("n_deleted", "n_lines"))
    out = line_dedup.dedup_lines(docs, lines_col=lines, deleted_col=deleted).where(F.expr(f"{deleted} = 0 or trim(both ' \n\t\r' from text) <> ''"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, which are linked at a Jaccard index of 0.8 of their five-word shingles.

    It is the one with the smallest id, null ids last, then by a hash of the text; of rows that repeat id and text one stays. Null and empty
    texts are copies of each other.
    """
    found = near_copies.near_copies(docs).where("doc_id <=> component_id and text_hash = component_text")
    kept = checkpoint(found.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.count("*").alias("found_rows")))
    keyed = with_keys(docs)
    out = keyed.join(kept.where("found_rows = 1"), same(), "left_semi")
    repeated = kept.where("found_rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, same(), "left_semi").dropDuplicates(["id", "text_hash"]))
    return rows_of(out, docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark's passages don't contaminate, each judged by its own text, whatever its id. Null and empty texts stay, as do repeated rows."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text")
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="key").where("contaminated")
    found = found.select(F.col("key.doc_id").alias("found_id"), F.col("key.text_hash").alias("found_hash")).distinct()
    return rows_of(with_keys(docs).join(found, same(), "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each row with its token ids and what they decode to. A null or empty text has no ids."""
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    out = word_bpe.bpe_encode(keyed, path("word_bpe_49k.json"), id_col="key")
    return out.select("key.doc_id", "key.lang", "key.source", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("encode", encode),
]

#: The model-based first stage can't be expressed in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What lies between them is in the folder that the session shares; each table goes once the next is written."""
    folder, docs, done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            where = spark._jvm.org.apache.hadoop.fs.Path(done)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        done = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
