"""Sets compared by blocks: each pair once, whatever falls into one block, and no row for a pair before the end."""

import itertools
import random

import pytest

from weft.operators import alike, states

SETS = "id string, items array<string>"


def drawn(seed, n, items):
    rng = random.Random(seed)
    return {f"s{k:03d}": rng.sample(items, rng.randint(0, min(6, len(items)))) for k in range(n)}


def wanted(sets, least):
    index = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]}
    return {p: round(v, 6) for p, v in index.items() if v >= least}


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
@pytest.mark.parametrize("cells", [1, 40, 500_000])
def test_blocks_give_each_pair_once(spark, monkeypatch, least, cells):
    monkeypatch.setattr(alike, "CELLS", cells)
    monkeypatch.setattr(alike, "LISTS", 7)
    monkeypatch.setattr(alike, "ROWS", 3)
    sets = drawn(1, 90, list("abcdefg"))
    monkeypatch.setattr(states, "similar_classes", lambda *a: pytest.fail("a row for each two sets"))
    got = [((r.a, r.b), r.similarity) for r in states.similar_sets(spark.createDataFrame(list(sets.items()), SETS), least, 6).collect()]
    assert dict(got) == wanted(sets, least) and len(got) == len(dict(got))


def test_many_items_go_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(alike, "ITEMS", 5)
    sets = drawn(2, 60, list("abcdefg"))
    got = [((r.a, r.b), r.similarity) for r in states.similar_sets(spark.createDataFrame(list(sets.items()), SETS), 0.4, 6).collect()]
    assert dict(got) == wanted(sets, 0.4) and len(got) == len(dict(got))


def test_states_are_rounded_by_lists(spark):
    rows = [(i, None, x) for i, x in drawn(3, 40, list("abcd")).items()]
    t = spark.createDataFrame(rows, "state string, parent string, nodes array<string>")
    plan = states.correlations(t, 0.6, 6)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above and "Repartition" not in above
    assert "round" not in plan[: plan.index("Generate explode")]
    sets = {i: set(x) for i, _, x in rows if x}
    want = {(a, b): (round(2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])), 6), len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2)}
    assert {(r.a, r.b): (r.dice, r.shared) for r in states.correlations(t, 0.6, 6).collect()} == {p: v for p, v in want.items() if v[0] >= 0.6}
