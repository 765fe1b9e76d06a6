"""What the operators of this subpackage share: session helpers, keys for skewed joins, samples and Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step holds at a time, unless a single text is longer.
CHUNK_CHARS = 2_000_000
#: Parts over which the rows of one key are dealt; a set of parts is a 64-bit number.
SALTS = 64
#: Slots of a filter of keys; each holds 64 bits, so the table is of a megabyte at most and may be broadcast.
SLOTS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set a temporary one is taken, on one machine only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp("-shared")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the folder that all executors share, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def salt(*columns: str | Column, salts: int = SALTS) -> Column:
    """A part of a key's rows, by a hash of what tells the rows apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salt_set(part: str | Column) -> Column:
    """The aggregate of the parts that a key's rows have, one bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), part))


def salts_in(bits: Column) -> Column:
    """The parts in such a set, in an array: a key's row, exploded by it, meets each part of the other side once."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("shiftright", bits, k).bitwiseAND(F.lit(1)) == 1)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores added until no column has it (column names don't tell cases apart)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(df: DataFrame, size: int = 8 << 20) -> int:
    """So many partitions that each has about ``size`` bytes by the plan's estimate (which takes a compressed text column for a third of what it is), and no fewer than the session's shuffles have. An unknown size counts as none."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, estimate // size) if estimate < 1 << 50 else least


def _slot(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(SLOTS)).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))


def hash_filter(h: DataFrame) -> DataFrame:
    """A filter of one column of 64-bit hashes: SLOTS rows at most, whatever the input, so it may be broadcast."""
    (name,) = h.columns
    return h.groupBy(_slot(F.col(name)).alias("_wf_slot")).agg(F.bit_or(_bit(F.col(name))).alias("_wf_bits"))


def flagged(rows: DataFrame, h: Column, among: DataFrame, name: str) -> DataFrame:
    """rows with a boolean: false where the hash is certainly not in the filter. It says so of fewer rows as the filter fills, never of a wrong one."""
    keyed = rows.withColumn("_wf_h", h)
    met = keyed.join(F.broadcast(among), _slot(F.col("_wf_h")) == F.col("_wf_slot"), "left")
    return met.withColumn(name, F.coalesce(F.col("_wf_bits").bitwiseAND(_bit(F.col("_wf_h"))) != 0, F.lit(False))).drop("_wf_h", "_wf_slot", "_wf_bits")


def sample_limit(n: int, sample: int) -> int:
    """The limit up to which a 63-bit hash is in a sample of about ``sample`` of n rows; all are if there are fewer."""
    return (1 << 63) - 1 if n <= sample else (sample << 63) // n


def sampled(h: Column, limit: Column) -> Column:
    """Whether a 64-bit hash is in the sample of a limit. The hash's sign does not count."""
    return h.bitwiseAND(F.lit((1 << 63) - 1)) <= limit


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in pieces of about ``chars`` bytes, each with its texts as Python strings."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for start, stop in byte_slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), chars):
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()


def byte_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to ``most`` or less, unless a single one is larger."""
    ends = np.cumsum(sizes.astype(np.int64))
    start, n = 0, ends.size
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop
