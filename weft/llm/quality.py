"""Quality grades by ordinal cumulative-link regression.

A document has one latent score: the sum of the weights of its hashed words and of a few measures of its form.
Ordered thresholds cut the score: the probability of a grade of g or more is the logistic function of the score minus threshold g. All grades share
the weights. Weights and thresholds are fitted together on graded ratings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import sample_limit, sampled, text_chunks

WORD = re.compile(r"[^\W\d_]+").findall
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+").findall
SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]+").findall
DIGITS = re.compile(r"\d+").findall
#: Hash buckets for words, and the measures of form behind them.
BUCKETS, FORMS = 1 << 18, 15
KNOWN = 300_000


def features(text: str | None) -> set[str]:
    """The words of a text, lowered, and their first four and five letters where they are longer."""
    words = set(WORD(text.lower())) if text else set()
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def form(text: str) -> list[float]:
    """Measures between 0 and 1: symbols, digits, capitals, repeated words and word pairs; each also steeper, up to 1."""
    words = text.split()
    n, pairs = len(text) or 1, max(len(words) - 1, 1)
    follow = list(zip(words, words[1:], strict=False))
    shares = [sum(map(len, SYMBOL(text))) / n, sum(map(len, DIGITS(text))) / n, sum(map(len, UPPER(text))) / n, sum(a == b for a, b in follow) / pairs, 1 - len(set(follow)) / pairs if follow else 0.0]
    return [*shares, *(min(1.0, 10 * s) for s in shares), *(min(1.0, 40 * s) for s in shares)]


@dataclass
class Model:
    """weights of the buckets, then of the forms; thresholds in ascending order, one less than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Per text and threshold: the probability of a grade above it."""
        out = []
        for text in texts:
            words = features(text)
            new = words.difference(self.known)
            if len(self.known) + len(new) > KNOWN and self.known:
                self.known.clear()
                new = words
            for w in new:
                self.known[w] = float(self.weights[bucket(w)])
            out.append(sum(map(self.known.__getitem__, words)) + float(np.dot(self.weights[BUCKETS:], form(text or ""))))
        return tail(np.array(out, float), self.thresholds)


def constant(grade: int, n_grades: int) -> Model:
    """The model that gives every text one grade."""
    return Model(np.zeros(BUCKETS + FORMS), np.where(np.arange(n_grades - 1) < grade, -500.0, 500.0))


def tail(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -500, 500)))


def telling(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_grades: int, least: float, odds: float) -> np.ndarray:
    """Per bucket: whether it makes some grade likelier, by ``least`` standard errors and by ``odds`` times the odds."""
    words = columns < BUCKETS
    seen = np.bincount(columns[words], minlength=BUCKETS)
    share = np.bincount(grades, minlength=n_grades) / grades.size
    found = np.zeros(BUCKETS, bool)
    for g in np.flatnonzero((share > 0) & (share < 1)):
        here = np.bincount(columns[words], grades[rows[words]] == g, BUCKETS)
        spread = np.sqrt(seen * (1 - seen / grades.size) * share[g] * (1 - share[g]))
        likelier = (here + 0.5) / (seen - here + 0.5) > odds * share[g] / (1 - share[g])
        found |= (here - seen * share[g] > least * np.maximum(spread, 0.5)) & likelier
    return found


def objective(theta: np.ndarray, width: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, own: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The weighted log likelihood less the ridge penalty, and its gradient.

    theta: width weights, one a column, the first threshold, and the logs of the steps from each to the next. own: the rows' weights.
    """
    here, steps_up = np.arange(grades.size), np.exp(theta[width + 1 :])
    cuts = theta[width] + np.r_[0, np.cumsum(steps_up)]
    score = np.bincount(rows, theta[columns] * values, grades.size)
    p = np.c_[np.ones(grades.size), tail(score, cuts), np.zeros(grades.size)]
    low, high = p[here, grades], p[here, grades + 1]
    mass = np.maximum(low - high, 1e-9)
    d_low, d_high = low * (1 - low), high * (1 - high)
    d_score = own * (d_low - d_high) / mass
    grad = np.zeros_like(theta)
    grad[:width] = np.bincount(columns, d_score[rows] * values, width) - ridge * theta[:width]
    d_cut = np.zeros(cuts.size + 2)
    np.add.at(d_cut, grades, -own * d_low / mass)
    np.add.at(d_cut, grades + 1, own * d_high / mass)
    d_cut = d_cut[1:-1]
    grad[width] = d_cut.sum()
    grad[width + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * steps_up
    return float(own @ np.log(mass) - ridge / 2 * theta[:width] @ theta[:width]), grad


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4, least: float = 4.5, odds: float = 6) -> Model:
    """Maximum likelihood with a ridge penalty, all grades weighing alike. Buckets that don't tell grades apart get no weight."""
    seen = np.r_[telling(rows, columns, grades, n_grades, least, odds), np.ones(FORMS, bool)]
    place = np.cumsum(seen) - 1
    ok = seen[columns]
    rows, columns, values = rows[ok], place[columns[ok]], values[ok]
    width = int(seen.sum())
    counts = np.bincount(grades, minlength=n_grades)
    own = (1 / np.maximum(counts, 1) / max((counts > 0).sum(), 1))[grades]
    w, cuts = np.zeros(width), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(n_grades - 1)
    theta = np.r_[w, cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = objective(theta, width, rows, columns, values, grades, own, ridge)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) / (1 + step / 100)
    weights = np.zeros(BUCKETS + FORMS)
    weights[seen] = theta[:width]
    return Model(weights, theta[width] + np.r_[0, np.cumsum(np.exp(theta[width + 1 :]))])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", alike: int = 4) -> Model:
    """Fits on a bounded sample: about ``sample`` rated documents of each grade, chosen by a hash of their id.

    ratings: id_col and grade_col (0 to n_grades - 1); of several ratings of a document the lowest holds, and
    null grades and ids don't count. Documents that repeat a rated id each count; null texts count as empty; other columns, whatever
    their names, are not read. The sample's hashed words come to the driver, nothing else. alike: of the sample's documents of one
    grade that share so many least hashes of their words (near copies, for the most part) one counts, else the words of a text
    that is copied often would seem to tell its grade; 0: all count.

    Where no rated document is there (no ratings, no documents, or ids that don't meet) nothing can be told: all weights are 0 and every text is
    given the highest grade. Where all are of one grade there is nothing to tell apart either, and every text is given that grade.
    """
    rated = ratings.select(ratings[id_col].alias("id"), ratings[grade_col].cast("int").alias("grade")).where(F.col("grade").between(0, n_grades - 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("grade").alias("grade"))
    sizes = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return constant(n_grades - 1, n_grades)
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, sample_limit(n, sample))])
    chosen = rated.where(sampled(F.xxhash64("id"), share[F.col("grade")]))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = [np.unique(np.fromiter((bucket(w) for w in features(t)), np.int32)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.int32())), pa.array([form(t or "") for t in texts], pa.list_(pa.float64()))], ["grade", "words", "form"])

    # the sample's size is bounded by a parameter, so it may be broadcast
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id").select("grade", "text")
    found = rows.mapInArrow(hashed, "grade int, words array<int>, form array<double>").toArrow()
    found = found.combine_chunks()
    grades = found["grade"].to_numpy().astype(np.int64)
    if np.unique(grades).size < 2:
        return constant(int(grades[0]) if grades.size else n_grades - 1, n_grades)
    forms = np.array(found["form"].to_pylist(), float).reshape(-1, FORMS)
    lists = found["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    # short texts are told apart; the hashes are mixed, as their order should not be that of the buckets
    mixed = flat.astype(np.uint32) * np.uint32(2654435761)
    least = [np.sort(mixed[a:b])[:alike].tolist() if alike and b - a >= 2 * alike else [i] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    chosen = {(grades[i], *least[i]): i for i in np.lexsort(forms.T)}
    chosen = np.array(sorted(chosen.values()), np.int64)
    grades, forms, lengths = grades[chosen], forms[chosen], np.diff(ends)[chosen]
    r = np.r_[np.repeat(np.arange(grades.size), lengths), np.repeat(np.arange(grades.size), FORMS)]
    c = np.r_[np.concatenate([flat[ends[i] : ends[i + 1]] for i in chosen] or [flat]).astype(np.int64), np.tile(np.arange(BUCKETS, BUCKETS + FORMS), grades.size)]
    v = np.r_[np.ones(lengths.sum()), forms.ravel()]
    return fit(r, c, v, grades, n_grades)


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of structs: expected_grade and tail_probability, that of the highest grade, of each whole text.

    A null text counts as empty, and an empty one is graded by the thresholds alone. No shuffle.
    """
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        at, values, thresholds = shared.value
        weights = np.zeros(BUCKETS + FORMS)
        weights[at] = values
        own = Model(weights, thresholds)
        for some in texts:
            p = own.score(some)
            yield pd.DataFrame({"expected_grade": p.sum(1), "tail_probability": p[:, -1]})

    return run(docs[text_col].cast("string"))


def label_grades(labels: DataFrame) -> DataFrame:
    """The ratings in a table of labels: 0 toxic, 1 of low quality, 2 neither. A row with a null label has none."""
    value = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", value.alias("grade"))
