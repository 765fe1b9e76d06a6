"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chance(seed: int, *columns: Column | str) -> Column:
    """A number from 0 up to 1 that only the seed and the values decide, so a recomputed task draws the same one.

    The first 48 bits of the MD5 of seed and values, joined with colons. Nulls are left out.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(2**48)


def path_cost(weight: Column | str) -> Column:
    """What an edge of the weight adds to a path: 1 / max(weight, 1e-9)."""
    return 1 / F.greatest(weight, F.lit(1e-9))


def set_jaccard(a: Column | str, b: Column | str) -> Column:
    """Common over all elements of two arrays; 0 if both are empty, null if one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(F.isnull(a) | F.isnull(b), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def member_ids() -> Column:
    """The members of an edge row, sorted, each once."""
    return F.array_sort(F.array_union("source_ids", "target_ids"))
