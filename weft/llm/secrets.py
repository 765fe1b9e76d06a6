"""Secret scans: fixed forms of credentials, and strings of high entropy."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms by kind, in the order in which equal starts are listed, the group that holds the secret and its least length.
FORMS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ENTROPY = "entropy"
#: The same forms with their least length in the pattern, where a match that is too short can't hide another; they spare the search most hits.
NARROW = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Candidates for the entropy test have a letter and a digit and at least WINDOW characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Allow-list, as patterns that must match and patterns that must not: UUIDs; words or numbers joined by signs, and paths; placeholders.
#: Also allowed is what repeats after at most PERIOD characters. No pattern loops over a group: that would recurse, once a repetition.
ALLOWED = (
    ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",), ()),
    ((r"[+/_=-][A-Za-z0-9]",), (r"^[0-9]", r"[A-Za-z][0-9]|[0-9][A-Za-z]")),
    ((r"(?i)example|sample|dummy|placeholder",), ()),
)
PERIOD = 8
WINDOW = 20
#: Character classes with their thresholds, in bits per character; a candidate is of the first class that it fits.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.75), (r"^[A-Za-z0-9]+$", 3.45), (r"", 3.6))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: the optimizer would put it in each place where then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(sizes: Column) -> Column:
    """The running totals of an array of integers, by doubling: in step j each adds the one 2 ** j places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + F.lit(1))).cast("int"))

    def step(totals: Column, j: Column) -> Column:
        apart = F.least(F.call_function("shiftleft", F.lit(1), j), F.size(totals))
        return F.zip_with(totals, F.concat(F.array_repeat(F.lit(0), apart), F.slice(totals, F.lit(1), F.size(totals) - apart)), lambda a, b: a + b)

    return F.aggregate(steps, sizes, step)


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The spans of a form's leftmost non-overlapping matches, without those whose group is too short, with what matched.

    The pieces between matches and the matches take turns, so their lengths add up to the places. Time is that of a
    pass over the text and n log n for n matches.
    """
    order = [k for k, *_ in FORMS].index(kind) if kind != ENTROPY else len(FORMS)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else None

    def spans(row: Column) -> Column:
        sizes = F.zip_with(row["gaps"], row["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        ends = F.slice(running(sizes), F.lit(1), F.size(row["hits"]))
        both = F.zip_with(ends, row["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(order).alias("kind"), e.alias("end"), h.alias("hit")))
        if secrets is None:
            return F.filter(both, lambda s: F.length(s["hit"]) >= least)
        sized = F.zip_with(both, row["secrets"], lambda s, n: F.struct(s.alias("span"), n.alias("n")))
        return F.transform(F.filter(sized, lambda x: x["n"] >= least), lambda x: x["span"])

    return once(F.struct(gaps.alias("gaps"), hits.alias("hits"), *([] if secrets is None else [secrets.alias("secrets")])), spans)


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of that many characters.

    With counts c, a window's entropy is log2(window) - sum(c log2 c) / window. The sum is carried from one window to the
    next: the entering character's term is replaced by the next larger one, the leaving one's by the next smaller; their counts are
    taken in the window itself, which is carried as well. Time grows with the candidate's length alone.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    start = F.struct(F.lit("").alias("inside"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

    def count(inside: Column, char: Column) -> Column:
        return F.length(inside) - F.length(F.replace(inside, char, F.lit("")))

    def step(done: Column, enters: Column) -> Column:
        full = F.length(done["inside"]) >= window
        leaves = F.substring(done["inside"], 1, 1)
        out = count(done["inside"], leaves)
        rest = F.when(full, F.substring(done["inside"], 2, window)).otherwise(done["inside"])
        left = done["sum"] - F.when(full, F.get(term, out) - F.get(term, out - 1)).otherwise(F.lit(0.0))

        def entered(at: Column) -> Column:
            into = count(at["rest"], enters)
            total = at["left"] + F.get(term, into + 1) - F.get(term, into)
            inside = F.concat(at["rest"], enters)
            return F.struct(inside.alias("inside"), total.alias("sum"), F.when(F.length(inside) >= window, F.least(done["least"], total)).otherwise(done["least"]).alias("least"))

        return once(F.struct(rest.alias("rest"), left.alias("left")), entered)

    return F.aggregate(F.split(candidate, ""), start, step, lambda done: F.lit(math.log2(window)) - done["least"] / window)


def suspicious(candidate: Column) -> Column:
    """Whether a candidate is not on the allow-list and some window of it has its class's entropy."""
    allowed = F.lit(False)
    for must, never in ALLOWED:
        allowed = allowed | reduce(lambda a, b: a & b, [candidate.rlike(p) for p in must] + [~candidate.rlike(p) for p in never])
    size = F.length(candidate)
    for k in range(1, PERIOD + 1):
        allowed = allowed | (F.substring(candidate, F.lit(k + 1), size) == F.substring(candidate, F.lit(1), size - k))
    threshold = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        threshold = F.when(candidate.rlike(pattern), bits).otherwise(threshold)
    return F.when(allowed, False).otherwise(peak_entropy(candidate) >= threshold)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans.

    spans lists kind:start:end in code points, the end exclusive, by start, then kind, comma-joined; base_sha256
    is the digest of that list without the entropy kind. Matches of a kind are the leftmost that don't overlap, in the
    whole text; those of different kinds may overlap. A null or empty text has no spans, and the digest is that of
    the empty string. Repeated rows and null ids come out as they came in; an empty table gives an empty one; other columns,
    whatever their names, are not read.
    Expressions only, in one pass without a shuffle; patterns that a text does not match are not searched for in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def spans(kind: str, pattern: str, group: int, least: int) -> Column:
        own = found(text, kind, pattern, group, least)
        if kind == ENTROPY:
            own = F.filter(own, lambda s: suspicious(s["hit"]))
        own = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.when(text.rlike(pattern), own).otherwise(none).alias(kind)

    rows = rows.select("id", *[spans(kind, NARROW.get(kind, pattern), group, least) for kind, pattern, group, least in FORMS], spans(ENTROPY, CANDIDATE, 0, WINDOW))
    names = F.array(*[F.lit(k) for k, *_ in FORMS], F.lit(ENTROPY))

    def listed(*kinds: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*map(F.col, kinds))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    base = [k for k, *_ in FORMS]
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in (*base, ENTROPY)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(listed(*base), 256).alias("base_sha256"), listed(*base, ENTROPY).alias("spans"))
