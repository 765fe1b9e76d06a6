"""Long, empty, skewed and clashing inputs, and the parts of operators that a plain recursion or enumeration can check."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import chat_format, common, decontaminate, exact_dedup, language_id, line_dedup, quality, secrets, simhash, token_counts

KIND = "doc_id bigint, text string"


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# samples and filters


def test_sample_limits():
    for n in (1, 10, 3000, 10**7, 10**10, 10**13):
        limit = common.sample_limit(n, 3000)
        assert 0 < limit < 1 << 63 and math.isclose(limit / 2**63 * n, min(n, 3000), rel_tol=1e-6)


def test_sampled_counts_the_low_63_bits(spark):
    rows = spark.range(0, 20000).select(F.xxhash64("id").alias("h"))
    half = rows.where(common.sampled(F.col("h"), F.lit(common.sample_limit(20000, 10000)))).count()
    assert 9500 < half < 10500 and rows.where(common.sampled(F.col("h"), F.lit(common.sample_limit(5, 5)))).count() == 20000


def test_hash_filter_misses_no_key(spark):
    rows = spark.range(0, 5000)
    among = common.hash_filter(rows.where("id % 7 = 0").select(F.xxhash64("id")))
    got = common.flagged(rows, F.xxhash64("id"), among, "maybe").collect()
    assert len(got) == 5000 and all(r["maybe"] for r in got if r["id"] % 7 == 0) and sum(r["maybe"] for r in got) < 900


def test_salts_cover_all_parts(spark):
    rows = spark.range(0, 1000).select(common.salt("id").alias("s"))
    bits = rows.agg(common.salt_set("s").alias("b"))
    assert bits.select(common.salts_in(F.col("b")).alias("a")).first()["a"] == sorted({r["s"] for r in rows.collect()})


# secrets


def plain_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate(secrets.FORMS):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for m in re.finditer(secrets.CANDIDATE, text):
        c = m[0]
        allowed = any(all(re.search(p, c) for p in must) and not any(re.search(p, c) for p in never) for must, never in secrets.ALLOWED)
        if allowed or any(c[k:] == c[:-k] for k in range(1, secrets.PERIOD + 1)):
            continue
        bits = next(b for p, b in secrets.CLASSES if re.search(p, c))
        count, total, best = Counter(c[: secrets.WINDOW]), 0.0, 0.0
        for i in range(len(c) - secrets.WINDOW + 1):
            if i:
                count[c[i - 1]] -= 1
                count[c[i + secrets.WINDOW - 1]] += 1
            total = sum(n * math.log2(n) for n in count.values() if n)
            best = max(best, math.log2(secrets.WINDOW) - total / secrets.WINDOW)
        if best >= bits:
            out.append((m.start(), len(secrets.FORMS), secrets.ENTROPY, m.end()))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(out))


def test_secrets_in_long_texts(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hex_key = "".join(rng.choices("0123456789abcdef", k=32))
    texts = ["ab-" * 300_000, "ab-" * 10_000 + "x1", "".join(rng.choices(letters, k=300_000)), "a cafe fed bad beads " * 15_000 + hex_key, "token=abc123x " * 20_000, "AKIA" * 9 + " AKIAAKIA", "é" + hex_key + "password = 'hunter2x'"]
    got = by_id(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), KIND)))
    for k, t in enumerate(texts):
        assert got[k]["spans"] == plain_spans(t), k


def test_secrets_in_random_texts(spark):
    rng = random.Random(4)
    parts = ["token=", "secret: ", "a1B2", "AKIA" + "X9" * 8, "0f3c9a" * 5, "/usr/lib/", "-", "_", " ", "é", "deadbeef00" * 3, "example", "q9Zk3LmX8vTt2wYpR5sB1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    got = by_id(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), KIND)))
    assert [got[k]["spans"] for k in range(len(texts))] == [plain_spans(t) for t in texts]


# language identification


def plain_log_p(word, pieces, p):
    word = language_id.START + word
    f = [0.0]
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(max(0, j - 40), j):
            k = pieces.get(word[i:j], -1)
            if k >= 0 or (i == j - 1):
                ways.append(f[i] + math.log(p[max(k, 0)]))
        most = max(ways)
        f.append(most + math.log(sum(math.exp(w - most) for w in ways)))
    return f[-1]


def test_long_words_and_unknown_scripts():
    pieces = language_id.vocabulary_pieces(path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = rng.random((max(pieces.values()) + 1, 2)) ** 8 + 1e-9
    p /= p.sum(0)
    words = ["the", "internationalisation" * 10, "ღ" * 200, "x" * 1000, "a"]
    got = language_id.Model(["a", "b"], pieces, p).log_p(words)
    assert np.allclose(got, [[plain_log_p(w, pieces, p[:, k]) for k in (0, 1)] for w in words], rtol=1e-10)


def test_expected_counts_equal_enumeration():
    pieces = {"▁": 1, "▁a": 2, "a": 3, "b": 4, "ab": 5, "▁ab": 6, "ba": 7}
    p = np.random.default_rng(1).dirichlet(np.ones(8), 2).T

    def ways(rest):
        if not rest:
            yield ()
        for j in range(1, len(rest) + 1):
            if (k := pieces.get(rest[:j], 0 if j == 1 else -1)) >= 0:
                yield from ((k, *more) for more in ways(rest[j:]))

    words = ["ab", "aba", "abab" * 3, "b", "az"]
    weights = np.array([[1.0, 2], [0, 1], [3, 1], [1, 1], [2, 0]])
    want = np.zeros_like(p)
    for w, n in zip(words, weights, strict=True):
        for k in (0, 1):
            found = [(x, math.prod(p[i, k] for i in x)) for x in ways("▁" + w)]
            total = sum(q for _, q in found)
            for x, q in found:
                for i in x:
                    want[i, k] += n[k] * q / total
    got = np.zeros_like(p)
    for some, lattice in language_id.lattices(words, pieces):
        got += lattice.expected(p, weights[some])
    assert np.allclose(got, want)


def test_expected_counts_of_long_words():
    pieces = {"▁": 1, "a": 2, "aa": 3}
    p = np.array([[1e-7], [1e-6], [1e-9], [1e-12]])
    got = language_id.Lattice(["a" * 400], pieces).expected(p, np.ones((1, 1)))[:, 0]
    assert np.isclose(got[1], 1) and np.isclose(got[2] + 2 * got[3], 400) and np.isfinite(got).all()


# SimHash


def test_fingerprints_by_spark_functions(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "One", "one two", "A B c", "é È e", *(" ".join(rng.choices(["a", "B", "cd", "\t", "Ü"], k=rng.randint(1, 60))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("doc_id", F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "").alias("w"))
    grams = F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " "))).when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
    hashes = words.select("doc_id", F.transform(grams, lambda g: F.xxhash64(g)).alias("h"))
    want = {}
    for r in hashes.collect():
        bits = ["1" if 2 * sum(h >> (63 - k) & 1 for h in r["h"]) > len(r["h"]) else "0" for k in range(64)]
        want[r["doc_id"]] = f"{int(''.join(bits), 2):016x}"
    assert {k: r["fingerprint"] for k, r in by_id(simhash.near_duplicates(docs)).items()} == want


def test_crowded_nodes_are_cut_to_the_end(spark):
    rng = random.Random(9)
    values = sorted({rng.getrandbits(14) << 3 for _ in range(600)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), crowd=16).collect()

    def classes(pairs):
        parent = {v: v for v in signed}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return {v: root(v) for v in signed}

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert classes(links) == classes(near)


def test_one_fingerprint_of_many_rows(spark):
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same words in all of these").alias("text"))
    got = by_id(simhash.near_duplicates(docs))
    assert len(got) == 3000 and {got[k]["component_id"] for k in range(0, 3000, 2)} == {0} and {got[k]["component_id"] for k in range(1, 3000, 2)} == {1}


# tokens and chats


def test_long_runs_of_letters():
    rng = random.Random(1)
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["".join(rng.choices("etaoinshrdlu", k=30_000)), "a" * 50_000, "".join(rng.choices("ab", k=10_000))]
    assert token_counts.Counter(path("byte_bpe_50k.json")).count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path("byte_bpe_50k.json")).count(["".join(rng.choices("etaoin", k=1_000_000))])[0] > 100_000


def test_chat_slices_by_bytes(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 40 + "</turn> \\ ###") for c in range(3) for t in range(20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn int, role string, text string, formatted string, id int")
    whole = sorted(map(tuple, chat_format.format_turns(docs).collect()))
    batch = pa.RecordBatch.from_pydict({"n": list(range(7))})
    assert [b - a for a, b in common.byte_slices(np.array([5, 5, 30, 1, 1, 1, 9]), 10)] == [2, 1, 3, 1] and batch.num_rows == 7
    for conv, turn, text, start, end in whole:
        ((role, said),) = chat_format.read_turns(text)
        assert (conv, turn, role, said) in rows and (chat_format.unescape(text[start:end]) == said if role == "assistant" else start == end == 0)


# decontamination


def test_repeated_words_and_many_items(spark):
    items = [(k, f"{'a ' * 20}{'b ' * k}") for k in range(1, 150)] + [(500, "a " * 3000), (501, "which")]
    texts = ["a " * 5000, "b " * 40, "a " * 12 + "c", "which", "x " * 30 + "a " * 13 + "b"]
    docs = spark.createDataFrame([(k, t, "i", "w") for k, t in enumerate(texts)], KIND + ", items string, n_hit string")
    got = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id int, text string")))
    assert got[0]["n_hit"] == 5000 and len(got[0]["items"]) == 150
    assert got[1]["n_hit"] == 40 and got[1]["items"] == sorted(str(k) for k in range(13, 150))
    assert (got[2]["n_hit"], got[3]["n_hit"], got[3]["items"]) == (0, 1, ["501"])
    assert got[4]["n_hit"] == 14 and got[4]["hit_spans"] == [(30, 44)] and "149" in got[4]["items"]


# quality


def words(rng, kind, n=30):
    return " ".join(f"{kind}{rng.randint(0, 20)}" for _ in range(n))


def test_objective_and_gradient():
    rng = np.random.default_rng(0)
    n, width, n_grades = 40, 6, 4
    dense = rng.random((n, width)) * (rng.random((n, width)) < 0.5)
    r, c = np.nonzero(dense)
    grades, own = rng.integers(0, n_grades, n), rng.random(n)
    theta = np.r_[rng.normal(size=width), -0.4, rng.normal(size=n_grades - 2) / 3]
    value, grad = quality.objective(theta, width, r, c, dense[r, c], grades, own, 0.1)
    cuts = [theta[width]]
    for step in theta[width + 1 :]:
        cuts.append(cuts[-1] + math.exp(step))
    want = 0.0
    for i in range(n):
        score = dense[i] @ theta[:width]
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in cuts), 0.0]
        want += own[i] * math.log(above[grades[i]] - above[grades[i] + 1])
    assert math.isclose(value, want - 0.05 * float(theta[:width] @ theta[:width]), rel_tol=1e-9)
    for k in range(theta.size):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (quality.objective(up, width, r, c, dense[r, c], grades, own, 0.1)[0] - quality.objective(down, width, r, c, dense[r, c], grades, own, 0.1)[0]) / 2e-5
        assert math.isclose(slope, grad[k], rel_tol=1e-4, abs_tol=1e-6)


def test_fit_orders_the_thresholds(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(k, words(rng, "bad" if k % 3 == 0 else "poor" if k % 3 == 1 else "good"), "g") for k in range(300)], KIND + ", grade string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(300)] + [(5, None), (None, 1)], "doc_id bigint, grade int")
    model = quality.train(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.grade(docs, model).alias("g")).collect()}
    for k in range(300):
        assert (got[k]["tail_probability"] >= 0.5) == (k % 3 == 2) and abs(got[k]["expected_grade"] - k % 3) < 0.6


@pytest.mark.parametrize(("ratings", "want"), [([], 1.0), ([(999, 0)], 1.0), ([(1, 2), (2, 2)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(1, 7), (None, 0), (2, None)], 1.0)])
def test_quality_with_nothing_to_learn(spark, ratings, want):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (3, ""), (None, "x")], KIND)
    model = quality.train(docs, spark.createDataFrame(ratings, "doc_id bigint, grade int"))
    assert [r["t"] for r in docs.select(quality.grade(docs, model)["tail_probability"].alias("t")).collect()] == pytest.approx([want] * 5)
    none = quality.train(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id bigint, grade int"))
    assert docs.limit(0).select(quality.grade(docs.limit(0), none).alias("g")).collect() == [] and none.thresholds[-1] < 0


def test_alike_documents_of_the_sample(spark):
    docs = spark.createDataFrame([(k, "one long text that is copied many times over and over again") for k in range(20)] + [(k, f"other words {k} here") for k in range(20, 40)], KIND)
    ratings = spark.createDataFrame([(k, 2 if k < 20 else 0) for k in range(40)], "doc_id bigint, grade int")
    one, every = quality.train(docs, ratings), quality.train(docs, ratings, alike=0)
    assert np.count_nonzero(every.weights[: quality.BUCKETS]) > np.count_nonzero(one.weights[: quality.BUCKETS])


# exact and line dedup


def test_exact_dedup_of_colliding_digests(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (4, "c "), (5, None), (6, " "), (None, "c"), (None, None)]
    docs = spark.createDataFrame(rows, KIND)
    got = exact_dedup.exact_duplicates(docs, digest=lambda c: F.lit("same")).collect()
    want = exact_dedup.exact_duplicates(docs).collect()
    shown = lambda rows: sorted([(str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in rows])
    assert shown(got) == shown(want) and len(got) == len(rows)


def test_exact_dedup_of_one_large_group(spark):
    docs = spark.range(0, 4000).select((F.col("id") + 3).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x y")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit(1).alias("digest"), F.lit(2).alias("salt"))
    got = by_id(exact_dedup.exact_duplicates(docs))
    large = [r for r in got.values() if r["group_size"] > 1]
    assert len(got) == 4000 and {(r["keep_id"], r["group_size"]) for r in large} == {(4, 2666)} and [r["doc_id"] for r in large if r["kept"]] == [4]


def test_line_dedup_with_clashing_columns(spark):
    run = "\n".join(" ".join(f"w{i}{k}" for k in range(20)) for i in range(4))
    rows = [(1, run + "\nmore", "keep", "x", 7), (2, "start\n" + run, "keep", "y", 8), (3, None, None, "z", 9), (4, "", "keep", "v", 10)]
    docs = spark.createDataFrame(rows, KIND + ", n_lines string, maybe string, row int")
    out = line_dedup.dedup_lines(docs)
    got = by_id(out)
    assert out.columns == [*docs.columns, "n_lines_", "n_deleted"] and [got[k]["n_lines"] for k in (1, 2, 3, 4)] == ["keep", "keep", None, "keep"]
    assert (got[2]["text"], got[2]["n_deleted"], got[2]["n_lines_"], got[2]["row"], got[1]["text"], got[3]["n_lines_"]) == ("start", 4, 5, 8, rows[0][1], 0)


def test_line_dedup_of_a_very_common_run(spark):
    run = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"own line {k}\n{run}") for k in range(500)], KIND)
    got = by_id(line_dedup.dedup_lines(docs))
    assert got[0]["n_deleted"] == 0 and all(got[k]["text"] == f"own line {k}" for k in range(1, 500))


# the pipeline's stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(0)
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, words(rng, "item"))], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_with_nulls_repeats_and_clashing_columns(spark, folder):
    rng = random.Random(5)
    texts = [None, "", words(rng, "u"), words(rng, "v"), words(rng, "v", 200), words(rng, "ß")]
    rows = [(k, t, None, "s", 0, "a", "b", 3, True, "r") for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], "en", None, 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, KIND + ", lang string, source string, n_chars bigint, kept_id string, bad_id string, n_deleted int, contaminated boolean, row string")
    groups = defaultdict(list)
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, folder)
            got = out.collect()
            groups[name].append(len(got))
            if name != "encode":
                assert out.columns == docs.columns and {tuple(r) for r in got} <= {tuple(r) for r in rows}
    assert {k: v[1] for k, v in groups.items()} == dict.fromkeys(groups, 0)
    assert (groups["line_dedup"][0], groups["decontaminate"][0], groups["encode"][0]) == (10, 10, 10)
    # null and empty texts are copies of each other, and so are the three rows of id 2 and the two of one text
    assert groups["near_dedup"][0] == 5


def test_pipeline_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    (left,) = tmp_path.iterdir()
    assert [x.name for x in left.iterdir()] == ["decontaminate"]
