"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weft.llm.bpe import SPACE, Merges
from weft.llm.common import text_chunks

#: How a byte-level vocabulary splits text before merging.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pre-tokens whose counts a worker keeps; beyond that it starts anew, which costs time and changes no result.
KNOWN = 300_000


class Counter:
    """Counts tokens; remembers the counts of pre-tokens it has seen."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        out, words = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            parts = self.special.split(text or "")
            out[i] = len(parts) - 1
            words.append(self.split(parts[0]) if len(parts) == 1 else [w for part in parts for w in self.split(part)])
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > KNOWN and self.known:
            self.known.clear()
            new = set().union(*words)
        if new:
            new = list(new)
            self.known.update(zip(new, self.merges.encode([w.encode() for w in new])[1].tolist(), strict=True))
        get = self.known.__getitem__
        out += np.fromiter((sum(map(get, w)) for w in words), np.int64, len(words))
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    """The worker's own counter; it stays for later tasks."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: a byte-level BPE file of the tokenizers library, at the same path on all executors. Special
    strings inside a text count as one token each, nothing is added at the ends, and whole texts count.
    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids come out as they came in; an
    empty table gives an empty one. No shuffle: one pass over the text column.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for part, texts in text_chunks(batches):
            n = count(texts)
            size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
