"""Near copies by the Jaccard index, against a comparison of all pairs."""

import random

import pytest

import corpus_pipeline
from weft.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def sets_of(texts, size=5):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]


def near(a, b):
    return 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and (a == b or 5 * len(a & b) >= 4 * len(a | b))


def firsts(texts):
    """The first text that each is linked with, directly or not."""
    sets, out = sets_of(texts), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if out[i] != out[j] and near(a, b):
                low, high = sorted((out[i], out[j]))
                out = [low if x == high else x for x in out]
    return out


def changed(words, places, rng):
    return [f"x{rng.random()}" if k in places else w for k, w in enumerate(words)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(200)]
    base = [rng.choice(words) for _ in range(100)]
    # a group of copies few of which are near each other, chains, all sizes around the limit, and texts shorter than a shingle
    group = [" ".join(changed(base, rng.sample(range(100), 2), rng)) for _ in range(60)]
    chain = [" ".join([f"c{k}" for k in range(n, n + 60)]) for n in range(0, 60, 5)]
    cut = [" ".join(f"d{k}" for k in range(n)) for n in range(20, 80, 2)]
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + group + chain + cut + ["", None, " ", "One two", "one  TWO", "two one", "a b c d e", "A b c d e", "a b c d e f"]


def test_components_are_those_of_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == dict(enumerate(firsts(texts)))


def test_stage_removes_copies_that_fingerprints_miss(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    copies = [" ".join(changed(base, [60], random.Random(k))) for k in range(40)]
    far = next(c for c in copies if (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(c)).bit_count() > 3)
    other = " ".join(rng.choice(base) for _ in range(120))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, far), (3, other)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()) == [1, 3]
