"""The queries opN_<name> and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, quality, secrets, simhash, token_counts, word_bpe
from weft.llm.common import table

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
#: The probability of the highest grade from which a document is kept.
KEEP = 0.5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~apart), path(PIECES), key=F.col("doc_id"))
    kept = docs.select(F.struct("doc_id", apart.alias("held_out")).alias("key"), "text")
    out = language_id.predict(kept, model, id_col="key")
    return out.select("key.doc_id", "key.held_out", "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path(BYTE_BPE))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.bpe_encode(table(spark, sf_dir, "documents"), path(WORD_BPE), as_bytes=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digest_conversations(chat_format.format_turns(rows.unionByName(more)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")))
    graded = docs.select("doc_id", quality.grade(docs, model).alias("grade"))
    return graded.select("doc_id", "grade.expected_grade", "grade.tail_probability", (F.col("grade.tail_probability") >= KEEP).alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_token_counts, op4_secrets, op5_word_bpe, op6_chat_format, op7_decontaminate, op8_quality, op9_line_dedup, op10_exact_dedup, pipeline)}


def _secrets_sql() -> str:
    loose = (secrets.ENTROPY, "[A-Za-z0-9+/_=-]+", 0, secrets.WINDOW)
    forms = [(k, name, pattern.replace("'", "''"), group, least) for k, (name, pattern, group, least) in enumerate((*secrets.FORMS, loose))]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {least} AS least, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS s, string_split_regex(t, '{p}') AS g FROM d" for k, _, p, group, least in forms)
    threshold = " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {bits}" for p, bits in secrets.CLASSES[:-1])
    allowed = " OR ".join([*("(" + " AND ".join([*(f"regexp_matches(hit, '{p}')" for p in must), *(f"NOT regexp_matches(hit, '{p}')" for p in never)]) + ")" for must, never in secrets.ALLOWED), *(f"substr(hit, {k + 1}) = substr(hit, 1, length(hit) - {k})" for k in range(1, secrets.PERIOD + 1))])
    windows = f"list_max(list_transform(range(0, length(hit) - {secrets.WINDOW - 1}), lambda i: list_entropy(string_split(substr(hit, i + 1, {secrets.WINDOW}), ''))))"
    names = ", ".join(f"'{name}'" for _, name, *_ in forms)
    counts = ", ".join(f"(count(*) FILTER (k = {k}))::BIGINT AS n_{name}" for k, name, *_ in forms)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
    e AS (SELECT doc_id, k, least, unnest(h) AS hit, unnest(s) AS sec, unnest(g[1:len(h)]) AS gap, unnest(range(1, len(h) + 1)) AS i FROM f),
    p AS (SELECT doc_id, k, least, hit, sec, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS e FROM e),
    q AS (SELECT doc_id, k, e - length(hit) AS b, e, [{names}][k + 1] || ':' || (e - length(hit)) || ':' || e AS span FROM p WHERE length(sec) >= least AND
      (k < {len(secrets.FORMS)} OR CASE WHEN NOT (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')) OR {allowed} THEN false ELSE {windows} >= CASE {threshold} ELSE {secrets.CLASSES[-1][1]} END END)),
    r AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY b, k, e) FILTER (k < {len(secrets.FORMS)}) AS base, string_agg(span, ',' ORDER BY b, k, e) AS spans FROM q GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for _, name, *_ in forms)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op4_secrets": _secrets_sql(),
    "op6_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    sum(14 + length(replace(replace(role, '\', '\\'), ':', '\:')) + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id""",
    "op7_decontaminate": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    pos AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win))),
    occ AS (SELECT doc_id, item_id, s, pos.k AS k FROM pos JOIN win ON pos.k = win.k AND pos.g = win.g),
    hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op10_exact_dedup": r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents),
    g AS (SELECT content, first(doc_id ORDER BY size DESC, doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY content)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.content) AS text_sha256 FROM d JOIN g ON d.content = g.content""",
}
