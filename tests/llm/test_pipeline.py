"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import quality
from weft.llm.queries import ORACLES, QUERIES, WORD_BPE, path

from .test_operators import plain_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what the last returns."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*out, docs]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[:5])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_line_dedup_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    plain = plain_line_dedup(sorted(before.items()), 50)
    assert after == {k: t for k, t in plain.items() if t == before[k] or t.strip(" \n\t\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect() if r["text"] != before[r["doc_id"]])


def plain_quality(before, ratings):
    """Which documents stay, by a plain evaluation of the model that the stage trains: weights and thresholds, one text after another."""
    model = quality.train(before, ratings)
    top = float(model.thresholds[-1])
    kept = set()
    for k, t in texts(before).items():
        score = sum(float(model.weights[quality.bucket(w)]) for w in quality.features(t)) + sum(float(w) * x for w, x in zip(model.weights[quality.BUCKETS :], quality.form(t or ""), strict=True))
        if score >= top:  # a tail probability of a half or more
            kept.add(k)
    return kept


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = set(texts(stages[1]))
    assert kept == plain_quality(stages[0], quality.label_grades(labels))
    grades = {r["doc_id"]: r["grade"] for r in quality.label_grades(labels).collect()}
    assert sum(k in kept for k, g in grades.items() if g == 2) > 0.85 * sum(g == 2 for g in grades.values())
    assert sum(k in kept for k, g in grades.items() if g == 0) < 0.2 * sum(g == 0 for g in grades.values())


def test_near_dedup_stage(stages):
    before = sorted(texts(stages[2]).items())
    sets = []
    for _, t in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    first = list(range(len(before)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                first[b] = a
    assert set(texts(stages[3])) == {k for i, (k, _) in enumerate(before) if root(i) == i}


def test_decontamination_stage(spark, stages):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    wins = {tuple(w[i : i + min(13, len(w))]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [split(r["text"])] for i in range(len(w) - min(13, len(w)) + 1)}
    kept = set()
    for k, t in texts(stages[3]).items():
        w, hit = split(t), set()
        for n in {len(x) for x in wins}:
            hit |= {p for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(k)
    assert set(texts(stages[4])) == kept


def test_encoding_stage(stages):
    before, library = texts(stages[4]), Tokenizer.from_file(path(WORD_BPE))
    rows = stages[5].collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in before.items()}
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_and_queries(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
    assert set(ORACLES) < set(QUERIES) and all(re.fullmatch(r"op\d+_\w+|pipeline", n) for n in QUERIES)
    assert QUERIES["op1_language_id"](spark, SF).columns == ["doc_id", "held_out", "lang_pred", "score"]
    right = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) as a").first()
    assert right["a"] > 0.97
