"""Driver loops over DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set a temporary one is taken, on one machine only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp("-weft")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the session's checkpoint folder, with its lineage cut.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's estimate is the product of its sides': in a loop it doubles its digits with each
    round, until planning takes minutes. So an estimate beyond 64 bits is dropped.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < 1 << 64:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


def rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 3) -> DataFrame:
    """step applied n times; lineage is cut every few rounds."""
    for k in range(1, n + 1):
        state = step(state)
        if k % every == 0 and k < n:
            state = checkpoint(state)
    return state


def fixpoint(seen: DataFrame, grow: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None = None) -> DataFrame:
    """seen with all that grow adds, semi-naively: in each round grow sees only the rows that the last one found.

    Rows are told apart by keys; most: rounds at most.
    """
    seen = new = checkpoint(seen)
    done = 0
    while most is None or done < most:
        new = checkpoint(grow(new).dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti"))
        if new.isEmpty():
            break
        seen = checkpoint(seen.unionByName(new))
        done += 1
    return seen
