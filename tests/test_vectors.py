"""Pairs and nearest vectors: ties of copies, null values, blocks."""

import itertools

import numpy as np

from weft.operators import retrieval


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id string, embedding array<double>")


def test_copies_tie_by_id(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(7, 9))
    rows = [(f"v{k}", v[k % 7].tolist()) for k in range(90)]
    ids = [r[0] for r in rows]
    got = {}
    for r in retrieval.semantic_edges(table(spark, rows), 4, 0.1, block=11).collect():
        got.setdefault(r.src, []).append((-r.weight, r.tgt))
    for k, i in enumerate(ids):
        assert [t for _, t in sorted(got[i])] == sorted(j for m, j in enumerate(ids) if m % 7 == k % 7 and j != i)[:4]


def test_pairs_across_blocks_leave_nulls_out(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(50, 6))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"v{k}", x.tolist()) for k, x in enumerate(v)] + [("n0", None), ("n1", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("n2", [1.0])]
    want = {tuple(sorted((f"v{a}", f"v{b}"))) for a, b in itertools.combinations(range(50), 2) if u[a] @ u[b] >= 0.3}
    assert {(r.a, r.b) for r in retrieval.similar_pairs(table(spark, rows), 0.3, block=8).collect()} == want


def test_blocks_meet_without_a_row_for_each_pair(spark):
    rows = table(spark, [(f"v{k}", [1.0, float(k)]) for k in range(20)])
    for df in (retrieval.similar_pairs(rows, 0.3, block=8), retrieval.semantic_edges(rows, 3, 0.3, block=8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan
