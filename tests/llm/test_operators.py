"""Each operator against a plain version or the library, and on tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import chat_format, components, decontaminate, exact_dedup, language_id, line_dedup, quality, secrets, simhash, token_counts, word_bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "Of the and thinner that, was <|endoftext|> Σας ÉCOLE 12345 'll   don't\n\nx"
TEXTS = [None, "", " \n\t ", "a", "a", "A b", "aaaa " * 3000, PROSE, PROSE + " ", "é" * 70, "x" * 5000, "token = abcdef123 AKIA" + "A1B2C3D4" * 3 + " 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "日本語 ٣ ½ \U0001f600\x1c\x85z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None, 0) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[7], (None, "a null id", "fr", "s", 1), (None, "a null id", "fr", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1.5)).withColumn("words", F.lit(True)).withColumn("hits", F.lit("h"))


def collected(df):
    return [r.asDict() for r in df.collect()]


def empty(df):
    return df.limit(0)


def test_token_counts_equal_the_library(docs):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = collected(token_counts.token_counts(docs, path("byte_bpe_50k.json")))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert collected(token_counts.token_counts(empty(docs), path("byte_bpe_50k.json"))) == []


def test_word_bpe_equals_the_library(docs):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), ids, library.decode(ids, skip_special_tokens=False)))
    encoded = word_bpe.bpe_encode(docs, path("word_bpe_49k.json"))
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in collected(encoded)) == sorted(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in collected(encoded))
    decoded = collected(word_bpe.bpe_decode(encoded, path("word_bpe_49k.json")))
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in decoded) == sorted((a, d) for a, _, d in want)
    assert collected(word_bpe.bpe_encode(empty(docs), path("word_bpe_49k.json"))) == []


def test_random_texts_equal_the_libraries(spark):
    rng = random.Random(5)
    letters = list("aaabcdeABΣςéÀİßǅ  \t\n\r\x0b\x1c\x1f\x85\xa0　0129²Ⅷ''.,!#|<>日́") + ["<|endoftext|>", "<|startoftext|>", "'re", " the"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(2000)]
    a, b = Tokenizer.from_file(path("byte_bpe_50k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    assert token_counts.Counter(path("byte_bpe_50k.json")).count(texts).tolist() == [len(x.ids) for x in a.encode_batch(texts, add_special_tokens=False)]
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r, x in zip(word_bpe.bpe_encode(mine, path("word_bpe_49k.json"), as_bytes=True).orderBy("doc_id").collect(), b.encode_batch(texts, add_special_tokens=False), strict=True):
        assert r["ids"] == struct.pack(f"<{len(x.ids)}I", *x.ids) and r["decoded"] == b.decode(x.ids, skip_special_tokens=False)


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5}
    p = np.array([[0.01], [0.1], [0.2], [0.3], [0.15], [0.24]])

    def total(w):
        return 1.0 if not w else sum(p[pieces[w[:k]], 0] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces) + (0.01 * total(w[1:]) if w[:1] not in pieces else 0)

    words = ["ab", "aab", "zb", "a"]
    lattice = language_id.Lattice(words, pieces)
    assert np.allclose(np.exp(lattice.log_p(p))[:, 0], [total("▁" + w) for w in words])
    counts = lattice.expected(p, np.ones((4, 1)))
    # expected counts weigh pieces by their length to that of the words
    length = {0: 1} | {v: len(k) for k, v in pieces.items()}
    assert np.isclose(sum(counts[k, 0] * length[k] for k in length), sum(len(w) + 1 for w in words))


def test_language_id(spark, docs):
    train = spark.createDataFrame([(f"the and of that with word{k}", "en") for k in range(30)] + [(f"der die und nicht ein wort{k}", "de") for k in range(30)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language_id.train(train, path("piece_bpe_32k.model"))
    assert model.languages == ["de", "en"]
    test = spark.createDataFrame([(1, "That word and the"), (2, "Nicht der Wort " * 2000), (3, None), (4, "12 !"), (5, "the" * 4000)], "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in collected(language_id.predict(test, model))}
    assert [got[k][0] for k in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert len(collected(language_id.predict(docs, model))) == docs.count()
    none = language_id.train(empty(train), path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in collected(language_id.predict(docs, none))} == {"und"}
    assert collected(language_id.predict(empty(docs), model)) == []


def linked(values, budget=3):
    """The first index that each value is linked with."""
    v, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


@pytest.mark.parametrize("crowd", [4096, 20])
def test_trie_links(spark, crowd):
    rng, values = random.Random(2), set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    found = {r["node"]: r["root"] for r in components.components(simhash.trie_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 3, crowd)).collect()}
    first = linked([x % (1 << 64) for x in signed])
    assert [found.get(x, x) for x in signed] == [signed[k] for k in first]


def test_near_duplicates(docs):
    got = collected(simhash.near_duplicates(docs))
    rows = docs.collect()
    assert sorted((str(r["doc_id"]), int(r["fingerprint"], 16)) for r in got) == sorted((str(r["doc_id"]), simhash.fingerprint(r["text"])) for r in rows)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[4] == 3 and by[8] == 7 and by[None] is None
    assert collected(simhash.near_duplicates(empty(docs))) == []


def test_exact_duplicates(docs):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[squeeze(r["text"])].append((r["doc_id"], len(r["text"] or "")))
    got = collected(exact_dedup.exact_duplicates(docs, salts=3))
    assert len(got) == docs.count()
    for r in got:
        text = next(t for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [(-n, i) for i, n in groups[text] if i is not None]
        assert r["keep_id"] == (min(ids)[1] if ids else None) and r["group_size"] == len(groups[text]) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert collected(exact_dedup.exact_duplicates(empty(docs))) == []


def test_secrets(docs):
    for r, text in ((r, t) for r in collected(secrets.scan_secrets(docs)) for t in [dict(enumerate(TEXTS)).get(r["doc_id"], "a null id") or ""]):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(secrets.FORMS) for m in re.finditer(p, text) if len(m[g]) >= least)
        listed = ",".join(f"{secrets.FORMS[k][0]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("entropy")) == listed
    assert collected(secrets.scan_secrets(empty(docs))) == []


def test_entropy_is_that_of_each_window(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef01", k=rng.randint(20, 60))) for _ in range(40)] + ["a" * 25, "ab" * 20]

    def entropy(w):
        return -sum(c / 20 * np.log2(c / 20) for c in (w.count(x) for x in set(w)))

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.peak_entropy(F.col("w")).alias("h")).collect()
    assert all(np.isclose(r["h"], max(entropy(r["w"][i : i + 20]) for i in range(len(r["w"]) - 19))) for r in got)
    shown = spark.createDataFrame([(1, "key Zx81kQp02LmN47vRt9Yw and 123e4567-e89b-12d3-a456-426614174000 word-word-word-word-1234")], "doc_id int, text string")
    assert secrets.scan_secrets(shown).first()["spans"] == "entropy:4:24"


def test_decontaminate(spark, docs):
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choices([f"w{k}" for k in range(40)], k=n))
    items = [(k, draw(n)) for k, n in enumerate([13, 14, 20, 40, 5, 2, 12, 1])] + [(8, None), (9, ""), (None, draw(15))]
    texts = [draw(60) for _ in range(30)]
    for _, t in items:
        if t:
            w = t.split()
            texts += [f"{draw(9)} {t.upper()} {draw(4)}", " ".join([*w[:14], *w[:14], *draw(3).split()]), " ".join(w[1:]), f"{draw(5)} {' '.join(w[:11])}, {' '.join(w[-13:])}"]
    mine = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id int, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {(tuple(w[i : i + min(13, len(w))]), k) for k, t in items for w in [split(t)] if w for i in range(len(w) - min(13, len(w)) + 1)}
    for r in collected(decontaminate.decontaminate(mine, spark.createDataFrame(items, "item_id int, text string"))):
        w, hit, found = split([*texts, None, ""][r["doc_id"]]), set(), set()
        for win, k in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(k)} - {"None"}
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
        assert sorted(hit) == [p for s in r["hit_spans"] for p in range(s["start"], s["end"])] and all(a["end"] < b["start"] for a, b in zip(r["hit_spans"], r["hit_spans"][1:], strict=False))
    nothing = collected(decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id int, text string")))
    assert len(nothing) == docs.count() and not any(r["n_hit"] for r in nothing)


def plain_line_dedup(rows, least):
    """What is left of each text, windows compared as tuples of lines in order of (id, place)."""
    begun, spans = {}, defaultdict(list)
    for i, text in rows:
        lines = [(k, x.strip(), len(x.split())) for k, x in enumerate((text or "").split("\n")) if x.strip()]
        runs = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n for _, _, n in lines[a : b + 1]) >= least:
                    runs.add((a, b))
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(n for _, _, n in lines[a : b + 1]) >= least:
                    runs.add((a, b))
                    break
        for a, b in sorted(runs):
            begun.setdefault(tuple(x for _, x, _ in lines[a : b + 1]), (i, lines[a][0], lines[b][0]))
            spans[i].append((tuple(x for _, x, _ in lines[a : b + 1]), lines[a][0], lines[b][0]))
    out = {}
    for i, text in rows:
        gone = set()
        for content, a, b in spans[i]:
            j, first, last = begun[content]
            if (j, first) != (i, a):
                gone |= set(range(max(a, last + 1) if j == i else a, b + 1))
        out[i] = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_line_dedup(spark, docs):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choices("abcdefghij", k=rng.randint(1, 4)))
    shared = [[line() for _ in range(rng.randint(2, 6))] for _ in range(5)]
    texts = []
    for _ in range(40):
        body = []
        for _ in range(rng.randint(0, 6)):
            body += rng.choice(shared) if rng.random() < 0.4 else [line(), ""][: rng.randint(1, 2)]
        texts.append("\n".join(body))
    texts += ["q r\n" * 9, None]
    got = {r["doc_id"]: r["text"] for r in collected(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), min_words=6))}
    assert got == plain_line_dedup(list(enumerate(texts)), 6)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_deleted"] and len(collected(out)) == docs.count()
    assert collected(line_dedup.dedup_lines(empty(docs))) == []


def test_quality(spark, docs):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices([a + b + c for a in "bdfghk" for b in "aeiou" for c in "lmnprstvxz"], k=80) + ["idiot"] * (k % 3 == 0) + ["$$$ ###"] * 60 * (k % 3 == 1)), k % 3) for k in range(600)]
    mine = spark.createDataFrame(rows, "doc_id int, text string, grade int")
    model = quality.train(mine, mine.where("doc_id < 400"))
    assert model.thresholds[0] < model.thresholds[1]
    got = mine.where("doc_id >= 400").select("grade", quality.grade(mine, model).alias("q")).collect()
    assert np.mean([(r["q"]["tail_probability"] >= 0.5) == (r["grade"] == 2) for r in got]) > 0.95
    assert all(abs(r["q"]["expected_grade"] - r["grade"]) < 1 for r in got if r["grade"] != 1)
    unrated = quality.train(docs, spark.createDataFrame([], "doc_id bigint, grade int"))
    assert {r["q"]["tail_probability"] for r in docs.select(quality.grade(docs, unrated).alias("q")).collect()} == {1.0}


def test_chat_round_trip(spark):
    rng = random.Random(10)
    bits = ["### ", "</turn>", "\\", "\n", ": ", "a", "é", "###", "Assistant"]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b", None]), rng.choice([None, "".join(rng.choices(bits, k=9))])) for c in range(20) for t in range(rng.randint(1, 5))]
    rows += [rows[0], (None, 0, "user", "x"), (5, None, "assistant", "first")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in collected(chat_format.digest_conversations(chat_format.format_turns(table)))}
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns)), len(loss), sha(loss))
    assert collected(chat_format.digest_conversations(chat_format.format_turns(empty(table)))) == []
