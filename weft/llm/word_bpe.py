"""BPE encoding and decoding through a table of distinct words.

Texts are split into words, some of them at a time: such a block keeps its distinct words once, and each text as the numbers of
its words. The distinct words of all blocks make one table, dealt out by hash, in which each is encoded once; the ids are joined back
to the blocks, and within a block to the texts, by position. Ids are decoded through the vocabulary's table of pieces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.bpe import SPACE, Merges
from weft.llm.common import parts_for, text_chunks

#: How the word-level vocabulary splits lower-cased text.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"

#: Bytes of text in a block, unless a single text is longer.
BLOCK = 8_000_000


class Vocabulary:
    """A word-level vocabulary: how it splits, its merges and its pieces."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True))) + ")" if self.merges.specials else r"((?!))")
        #: an id that no piece has has an empty one
        self.pieces = pa.array([self.merges.pieces.get(i, "") for i in range(self.merges.width)], pa.string())

    def words(self, text: str | None) -> list[str | int]:
        """A text's words in order; a special token is its id."""
        parts = self.special.split(text or "")
        if len(parts) == 1:
            return self.split(self.normal(parts[0]))
        return [w for k, p in enumerate(parts) for w in ([self.merges.specials[p]] if k % 2 else self.split(self.normal(p)))]

    @staticmethod
    def normal(part: str) -> str:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # letters are lowered one by one
        return part.lower()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each list of ids as its pieces, joined by a space; null: an empty text."""
        flat = ids.flatten()
        if len(flat) and pc.max(flat).as_py() >= len(self.pieces):
            raise ValueError("an id outside the vocabulary")
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), self.pieces.take(flat))
        return pc.binary_join(pieces, " ")


@lru_cache(2)
def vocabulary_of(path: str) -> Vocabulary:
    """The worker's own vocabulary; it stays for later tasks."""
    return Vocabulary(path)


def split_blocks(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Per block: its number, its texts' ids and numbers of words, of each word of its texts the number in the block, and the distinct words.

    The distinct words are dealt out by hash: part_of has the part of each, and words those of each part, in order, line by line.
    A special token has the number -1 - id. Numbers and words are compressed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = vocabulary_of(vocabulary), TaskContext.get().partitionId() << 32
        for batch, texts in text_chunks(batches, chars=BLOCK):
            words = [own.words(t) for t in texts]
            number: dict[str, int] = {}
            for some in words:
                for w in some:
                    if w.__class__ is str:
                        number.setdefault(w, len(number))
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            places = np.fromiter((number[w] if w.__class__ is str else -1 - w for some in words for w in some), np.int32, int(sizes.sum(dtype=np.int64)))
            raw = [w.encode() for w in number]
            part_of = np.fromiter((crc32(w) % parts for w in raw), np.int32, len(raw))
            order = np.argsort(part_of, kind="stable")
            at, starts = np.unique(part_of[order], return_index=True)
            lists = [compressed(b"\n".join([raw[k] for k in some])) for some in np.split(order.tolist(), starts[1:])] if at.size else []
            row = [pa.array([block]), one_list(batch.column(0)), one_list(pa.array(sizes)), pa.array([packed(places)], pa.binary()), pa.array([packed(part_of)], pa.binary()), one_list(pa.array(at, pa.int32())), one_list(pa.array(lists, pa.binary()))]
            yield pa.RecordBatch.from_arrays(row, ["block", "ids", "sizes", "places", "part_of", "parts", "words"])
            block += 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, sizes array<int>, places binary, part_of binary, parts array<int>, words array<binary>")


def one_list(values: pa.Array) -> pa.ListArray:
    """All values as one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expanded(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], n, codec="zstd", asbytes=True) if (n := int.from_bytes(raw[:8], "little")) else b""


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes, the low bytes of all first."""
    return compressed(np.ascontiguousarray(numbers.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(expanded(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def encode_words(lists: DataFrame, vocabulary: str) -> DataFrame:
    """block, part, words to block, part, counts and ids of these words. All lists of a part are in one partition, where each distinct word is encoded once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary_of(vocabulary).merges
        number: dict[bytes, int] = {}
        flat, counts, begins = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            lists = [expanded(raw).split(b"\n") for raw in batch.column(2).to_pylist()]
            new = list(dict.fromkeys(w for some in lists for w in some if w not in number))
            ids, n = merges.encode(new)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            begins = np.r_[begins, flat.size + np.cumsum(n) - n]
            flat, counts = np.r_[flat, ids.astype(np.int32)], np.r_[counts, n.astype(np.int32)]
            found = []
            for some in lists:
                at = np.fromiter(map(number.__getitem__, some), np.int64, len(some))
                found.append((packed(counts[at]), packed(gathered(at, flat, begins, counts)[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (zip(*found, strict=True) if found else ([], [])))], ["block", "part", "counts", "own"])

    return lists.mapInArrow(run, "block bigint, part int, counts binary, own binary")


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """Per row: id_col, n_tokens, ids and decoded.

    vocabulary: a BPE file with word ends of the tokenizers library, at the same path on all executors. ids are
    those of the library without added special tokens, truncation or padding, as an array or (as_bytes) as little-endian unsigned 32-bit
    integers; decoded joins the ids' pieces as the library does without a decoder.
    A null or empty text has no ids and an empty decoding; repeated rows and null ids come out as they came in;
    an empty table gives an empty one; other columns, whatever their names, are not read.

    The blocks are shuffled once, by number, and stay there; their distinct words go to the word's own part of the table and come back as ids.
    In memory are a block as a whole (BLOCK bytes of text, or one longer text) and a part of the table (one for each 8 megabytes of texts by the plan's estimate, and the number of shuffle partitions at least).
    """
    parts = parts_for(docs.select(text_col))
    blocks = split_blocks(docs, vocabulary, id_col, text_col, parts).repartition(parts, "block")

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, words = (batch.column(c).slice(k, 1).flatten() for c in (5, 6))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column(0)[k].as_py())), at, words], ["block", "part", "words"])

    # the shuffle has all columns here and below, so it is done once
    table = encode_words(blocks.mapInArrow(lists, "block bigint, part int, words binary").repartition(parts, "part"), vocabulary)
    back = table.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "own")).alias("table")).withColumnRenamed("block", "of")
    kind = docs.schema[id_col].dataType.simpleString()

    whole = blocks.join(back, F.col("block") == F.col("of"), "left").select(*blocks.columns, "table")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary_of(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                _, keys, sizes, places, part_of, _, _, table = (c.slice(k, 1) for c in batch.columns)
                found = sorted((r["part"], r["counts"], r["own"]) for r in table[0].as_py() or ())
                lengths = np.concatenate([unpacked(c) for _, c, _ in found] or [np.zeros(0, np.int32)]).astype(np.int64)
                flat = np.concatenate([unpacked(x) for _, _, x in found] or [np.zeros(0, np.int32)])
                begins = np.cumsum(lengths) - lengths
                # the table has the words by part, the numbers are in order of appearance
                order = np.argsort(unpacked(part_of[0].as_py()), kind="stable")
                at = np.empty_like(order)
                at[order] = np.arange(order.size)
                ids, counts = gathered(unpacked(places[0].as_py()), flat, begins[at], lengths[at])
                per_text = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(per_text)]]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                raw = pa.Array.from_buffers(pa.binary(), len(per_text), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]) if as_bytes else lists
                yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.diff(ends)), raw, own.decode(lists)], ["id", "n_tokens", "ids", "decoded"])

    out = whole.mapInArrow(run, f"id {kind}, n_tokens bigint, ids {'binary' if as_bytes else 'array<int>'}, decoded string")
    return out.withColumnRenamed("id", id_col)


def gathered(numbers: np.ndarray, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of words, given by number, and how many each has; a negative number is a special token's id."""
    special = numbers < 0
    counts = np.ones(numbers.size, np.int64)
    counts[~special] = lengths[numbers[~special]]
    starts = np.zeros(numbers.size, np.int64)
    starts[~special] = begins[numbers[~special]]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(starts - ends + counts, counts)
    ids = flat[np.minimum(at, flat.size - 1)] if flat.size else np.zeros(at.size, np.int64)
    ids[(ends - counts)[special]] = -1 - numbers[special]
    return ids, counts


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids: id_col and decoded, the ids' pieces joined by a space; null or no ids: an empty text.

    The vocabulary's id-to-piece table has a fixed size and travels with the task. An id outside it is an error. Repeated rows and
    null ids come out as they came in; an empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), vocabulary_of(vocabulary).decode(part.column(1))], ["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
