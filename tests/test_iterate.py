"""Loops over checkpointed tables."""

from weft.plans import iterate


def test_estimates_do_not_grow_with_rounds(spark):
    to = iterate.checkpoint(spark.range(1, 40).selectExpr("id as a", "greatest(id - 1, 1) as to"))
    for _ in range(5):
        to = iterate.checkpoint(to.join(to.selectExpr("a as to", "to as next"), "to").selectExpr("a", "next as to"))
        assert to._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert {(r.a, r.to) for r in to.collect()} == {(a, max(1, a - 32)) for a in range(1, 40)}
