"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability in a
language is the sum over all its segmentations into pieces of the products of their probabilities, which a
forward pass over the word's end positions computes for all languages and many words at once. Training is
expectation maximisation on the same lattice: forward times backward gives each piece's expected count.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import sample_limit, sampled, text_chunks

#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+").findall
START, UNKNOWN = "▁", 0
#: Words whose log probabilities a worker keeps, the first that it meets; those of others are computed for each batch.
KNOWN = 300_000
#: Words, and places in them, that one lattice has, unless a single word is longer.
WORDS, PLACES = 4096, 1 << 17
#: Places after which the sums of a forward pass are brought back to 1.
RESCALE = 8


def words_of(text: str | None) -> list[str]:
    return LETTERS(text.lower()) if text else []


class Lattice:
    """All segmentations of a set of words: an edge for each piece at each place."""

    def __init__(self, words: list[str], pieces: dict[str, int]):
        """pieces: from piece to number; the beginnings of pieces have number -1 where they are none."""
        word, start, end, piece = [], [], [], []
        self.sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        get = pieces.get
        for k, w in enumerate(words):
            w = START + w
            n = len(w)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    if (p := get(w[i:j])) is None:
                        break
                    if p >= 0:
                        single |= j == i + 1
                        word.append(k)
                        start.append(i)
                        end.append(j)
                        piece.append(p)
                if not single:
                    word.append(k)
                    start.append(i)
                    end.append(i + 1)
                    piece.append(UNKNOWN)
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        self.reach = int((self.end - self.start).max(initial=1))

    @staticmethod
    def _grouped(key: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if key.size else []

    def _sums(self, p: np.ndarray, into: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word, place and language: the sum over all ways to get there, and the log of what it is to be multiplied by.

        Edges lead from place ``into`` to place ``out``, in order of out. Every few places all sums that are still in reach are
        divided by the greatest of them, so none of any word length can get too small.
        """
        n, places = len(self.sizes), int(self.sizes.max(initial=0)) + 1
        f, scale = np.zeros((n, places, p.shape[1])), np.zeros((n, places, p.shape[1]))
        f[:, 0] = 1
        done = 0
        for e in self._grouped(out):
            to = int(out[e[0]])
            if to - done >= RESCALE:
                near = slice(max(0, to - self.reach), to)
                most = f[:, near].max(1)
                most = np.where(most > 0, most, 1)
                f[:, near] /= most[:, None]
                scale[:, near] += np.log(most)[:, None]
                done = to
            more = f[self.word[e], into[e]] * p[self.piece[e]]
            scale[:, to] = scale[:, to - 1]
            for k in range(p.shape[1]):
                f[:, to, k] += np.bincount(self.word[e], more[:, k], n)
        return f, scale

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and logs of their factors at each place, from the beginning on. p: per piece and language."""
        return self._sums(p, self.start, self.end)

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the end on; place 0 is a word's end."""
        sizes = self.sizes[self.word]
        return self._sums(p, sizes - self.end, sizes - self.start)

    def log_p(self, p: np.ndarray) -> np.ndarray:
        """Per word and language: the log of the sum over all segmentations."""
        f, scale = self.forward(p)
        at = np.arange(len(self.sizes)), self.sizes
        return np.log(f[at]) + scale[at]

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count per piece and language, of words that occur weights[word, language] times."""
        (f, up), (b, down) = self.forward(p), self.backward(p)
        at = np.arange(len(self.sizes)), self.sizes
        sizes = self.sizes[self.word]
        back = self.word, sizes - self.end
        logs = up[self.word, self.start] + down[back] - up[at][self.word]
        share = f[self.word, self.start] * p[self.piece] * b[back] / f[at][self.word] * np.exp(logs) * weights[self.word]
        return np.stack([np.bincount(self.piece, share[:, k], p.shape[0]) for k in range(p.shape[1])], 1)


def lattices(words: list[str], pieces: dict[str, int]) -> Iterator[tuple[np.ndarray, Lattice]]:
    """The words' numbers and lattices, some words of like length at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < order.size:
        stop = min(at + WORDS, order.size)
        while stop > at + 1 and (stop - at) * (sizes[order[stop - 1]] + 2) > PLACES:
            stop = at + (stop - at) // 2
        yield order[at:stop], Lattice([words[k] for k in order[at:stop]], pieces)
        at = stop


@dataclass
class Model:
    """languages, in order; pieces with their numbers; p: probability of each piece in each language."""

    languages: list[str]
    pieces: dict[str, int]
    p: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def log_p(self, words: list[str]) -> np.ndarray:
        """Per word and language: the log of the sum over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for some, lattice in lattices(words, self.pieces):
            out[some] = lattice.log_p(self.p)
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability, all languages alike beforehand."""
        counts = [Counter(words_of(t)) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        if self.rows is None:
            self.rows = np.zeros((KNOWN, len(self.languages)))
        new = list(set().union(*counts).difference(self.known))
        log_p, room = self.log_p(new), KNOWN - len(self.known)
        self.rows[len(self.known) : len(self.known) + len(new[:room])] = log_p[:room]
        self.known.update(zip(new[:room], range(len(self.known), KNOWN), strict=False))
        place = dict(zip(new[room:], range(KNOWN, KNOWN + len(new)), strict=False))
        table = np.concatenate([self.rows, log_p[room:]]) if place else self.rows
        get = ChainMap(self.known, place).__getitem__ if place else self.known.__getitem__
        names, scores = [], np.zeros(len(texts))
        for i, (text, c) in enumerate(zip(texts, counts, strict=True)):
            if not c or not any(map(str.isalpha, text)):
                names.append("und")
                continue
            total = np.fromiter(c.values(), float, len(c)) @ table[np.fromiter(map(get, c), np.int64, len(c))]
            best = int(total.argmax())
            names.append(self.languages[best])
            scores[i] = 1 / np.exp(np.maximum(total - total[best], -700)).sum()
        return names, scores


def vocabulary_pieces(path: str) -> dict[str, int]:
    """The pieces of a sentencepiece file that letters can make up, with numbers from 1; 0 is any other character, and -1 the beginning of a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    usable = sorted({p for p in found if p == START or LETTERS(p.removeprefix(START)) == [p.removeprefix(START)]})
    return {p[:k]: -1 for p in usable for k in range(1, len(p))} | {p: k for k, p in enumerate(usable, 1)}


def train(docs: DataFrame, vocabulary: str, sample: int = 2000, rounds: int = 2, smoothing: float = 0.02, text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> Model:
    """Piece probabilities by ``rounds`` of expectation maximisation.

    docs: training rows; those with null text or language count for nothing. sample: about so many documents of
    each language are learnt from, chosen by a hash of key (by default the text); with fewer all are. What reaches
    the driver is one count per vocabulary piece and language. smoothing: the share of the mean of all languages; above 0, so that
    every piece has a probability in every language. No rows: a model without languages. Words are whole, however long.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be above 0")
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[text_col] if key is None else key).alias("h")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(sizes), vocabulary_pieces(vocabulary)
    model = Model(languages, pieces, np.full((size := max(pieces.values(), default=0) + 1, len(languages)), 1 / size))
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, sample_limit(sizes[lang], sample))])
    chosen = rows.where(sampled(F.col("h"), share[F.col("lang")]))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found: Counter = Counter()
            for text, lang in zip(texts, part.column(1).to_pylist(), strict=True):
                found.update((w, lang) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([k for _, k in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "lang", "n"])

    def expect(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
        place, total = {x: k for k, x in enumerate(model.languages)}, np.zeros_like(model.p)
        for batch in batches:
            index = {w: k for k, w in enumerate(dict.fromkeys(batch.column(0).to_pylist()))}
            weights = np.zeros((len(index), len(place)))
            for w, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weights[index[w], place[lang]] += n
            for some, lattice in lattices(list(index), model.pieces):
                total += lattice.expected(model.p, weights[some])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    table = chosen.drop("h").mapInArrow(words, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")).cache()
    for _ in range(rounds):
        found = table.mapInArrow(lambda batches, model=model: expect(batches, model), "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full_like(model.p, 1e-4)
        for piece, lang, n in found.collect():
            counts[piece, lang] += n
        p = counts / counts.sum(0)
        model.p = (1 - smoothing) * p + smoothing * (0.9 * p.mean(1, keepdims=True) + 0.1 / len(p))
    table.unpersist()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, lang_pred and score, the posterior probability of lang_pred with all languages alike.

    A null text or one without a letter is ``und`` with score 0, as are all rows of a model that saw no language.
    Whole texts count; other columns are not read. Ties go to the language first in order. Repeated rows and null
    ids come out as they came in; an empty table gives an empty one. One pass, no shuffle; the model's size is
    that of the vocabulary times the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.pieces, model.p))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # a worker has one, with what it knows already
        for part, texts in text_chunks(batches):
            names, scores = own.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3. A null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
