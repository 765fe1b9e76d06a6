"""Near duplicates by SimHash fingerprints and a self-join of their binary trie.

The fingerprints, as bit strings, form a binary trie. The join walks pairs of its nodes from the top: a pair's
children are paired again, two different bits cost one of the error budget, and a pair beyond the budget is
pruned with all below it. Sorted fingerprints hold the trie: a node is a range of them.

To spread the walk, the bits are cut into budget + 1 blocks, and the trie is built once with each block in front.
Fingerprints within the budget are equal in one block at least, so in one of these tries they meet below the
same node at that block's depth, and each such node is a task's own. Nodes with many fingerprints below are cut
again in the same way over their remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpoint, salt, salt_set, salts_in, text_chunks
from weft.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Fingerprints below one node from which it is cut again.
CROWD = 4096
#: Rows that a task walks at a time, and node pairs that one step of a walk expands.
ROWS, PAIRS = 1 << 17, 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is in over half of the hashes of its shingles.

    A-Z are lowered; words are separated by ASCII white space. A text of fewer words than a shingle is one shingle; a text
    without words has fingerprint 0.
    """
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    n, bits = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        bits += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


class Walk:
    """A walk over pairs of trie nodes; label: of each fingerprint the first that it is linked with, directly or not."""

    def __init__(self, values: np.ndarray, group: np.ndarray, budget: int):
        self.values, self.budget = values, budget
        self.label = np.arange(values.size)
        self.ones: dict[int, np.ndarray] = {}
        near = (group[1:] == group[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= budget)
        self.label = np.maximum.accumulate(np.where(np.r_[True, ~near], self.label, 0))
        self._changed()

    def _changed(self) -> None:
        self.breaks = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]

    def _before(self, depth: int) -> np.ndarray:
        """How many values before each place have a 1 at depth."""
        if depth not in self.ones:
            self.ones[depth] = np.r_[0, np.cumsum((self.values >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        return self.ones[depth]

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            to = np.arange(self.label.size)
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while (to != (next_to := to[to])).any():
                to = next_to
            self.label = to[self.label]
            self._changed()

    def run(self, starts: np.ndarray, stops: np.ndarray, depths: np.ndarray) -> np.ndarray:
        stack = [(starts, stops, starts, stops, np.zeros_like(starts), depths)]
        while stack:
            chunk = stack.pop()
            if chunk[0].size > PAIRS:
                half = chunk[0].size // 2
                stack += [tuple(x[:half] for x in chunk), tuple(x[half:] for x in chunk)]
                continue
            a0, a1, b0, b1, cost, depth = chunk
            own = a0 == b0
            joined = (self.breaks[a1 - 1] == self.breaks[a0]) & (self.breaks[b1 - 1] == self.breaks[b0]) & (self.label[a0] == self.label[b0])
            open_ = ~joined & ~(own & (a1 - a0 < 2))
            small = open_ & (((a1 - a0) * (b1 - b0) <= 16) | (depth >= 64))
            if small.any():
                self._compare(a0[small], a1[small], b0[small], b1[small])
            for d in np.unique(depth[open_ & ~small]):
                at = open_ & ~small & (depth == d)
                below = self._children(a0[at], a1[at], b0[at], b1[at], cost[at], int(d))
                if below[0].size:
                    stack.append((*below, np.full(below[0].size, d + 1)))
        return self.label

    def _compare(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Compares the fingerprints below pairs of nodes; some thousand comparisons at a time."""
        wide = b1 - b0
        work = np.cumsum((a1 - a0) * wide)
        at = 0
        while at < work.size:
            stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 20), "right")))
            size, w = ((a1 - a0) * wide)[at:stop], wide[at:stop]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i = np.repeat(a0[at:stop], size) + k // np.repeat(w, size)
            j = np.repeat(b0[at:stop], size) + k % np.repeat(w, size)
            near = np.bitwise_count(self.values[i] ^ self.values[j]) <= self.budget
            self._link(i[near], j[near])
            at = stop

    def _children(self, a0, a1, b0, b1, cost, depth: int) -> tuple[np.ndarray, ...]:
        ones = self._before(depth)
        am, bm, own = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0]), a0 == b0
        pairs = [(a0, am, b0, bm, cost, cost >= 0), (am, a1, bm, b1, cost, cost >= 0), (a0, am, bm, b1, cost + 1, cost < self.budget), (am, a1, b0, bm, cost + 1, (cost < self.budget) & ~own)]
        kept = [[x[ok & (p[0] < p[1]) & (p[2] < p[3])] for x in p[:5]] for p in pairs for ok in (p[5],)]
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _linked(path: np.ndarray, pre: np.ndarray, depth: np.ndarray, value: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.r_[True, (path[1:] != path[:-1]) | (pre[1:] != pre[:-1])]
    group = np.cumsum(first)
    starts = np.flatnonzero(first)
    stops = np.r_[starts[1:], path.size]
    many = stops - starts > 1
    label = Walk(value.view(np.uint64), group, budget).run(starts[many], stops[many], depth[starts[many]].astype(np.int64))
    other = label != np.arange(label.size)
    return fp[label[other]], fp[other]


def _turned(width: int, parts: int, part: int):
    """The lowest ``width`` bits of value, turned so that the given one of ``parts`` equal blocks comes first; what the division leaves is in no block."""
    size = width // parts
    mask = (1 << width) - 1 if width < 64 else -1
    value = F.col("value")
    low = value.bitwiseAND(F.lit(mask))
    turned = low if part == 0 else F.shiftleft(low, size * part).bitwiseOR(F.shiftrightunsigned(low, width - size * part)).bitwiseAND(F.lit(mask))
    return turned if width == 64 else value.bitwiseAND(F.lit(~mask)).bitwiseOR(turned)


def trie_links(distinct: DataFrame, budget: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between fingerprints, enough to connect any two that differ in at most budget bits.

    distinct: one column fp, without repeats. What is returned is a spanning forest of the links below each node,
    at most budget + 1 rows per fingerprint and level, however large a group of near copies is. A task walks one node at a time, of
    crowd fingerprints at most: nodes with more are cut again until the bits that are left can't tell more apart.
    """
    parts = budget + 1
    rows = distinct.select(F.lit(0).cast("bigint").alias("path"), F.col("fp").alias("value"), "fp")
    ready, width, depth = [], 64, 0
    while True:
        size = width // parts
        depth += size
        cut = [F.struct((F.col("path") * parts + k).alias("path"), _turned(width, parts, k).alias("value")) for k in range(parts)]
        rows = rows.select(F.explode(F.array(*cut)).alias("c"), "fp").select("c.path", "c.value", "fp", F.shiftrightunsigned("c.value", 64 - depth).alias("pre"), F.lit(depth).alias("depth"))
        width -= size
        sizes = rows.groupBy("path", "pre").agg(F.count("*").alias("n"))
        if width < parts or 1 << width <= crowd:  # so few bits are left that no node can be crowded
            ready.append(rows.join(sizes.where("n > 1").drop("n"), ["path", "pre"], "left_semi"))
            break
        sizes = checkpoint(sizes.where("n > 1"))
        ready.append(rows.join(sizes.where(F.col("n") <= crowd).drop("n"), ["path", "pre"], "left_semi"))
        crowded = sizes.where(F.col("n") > crowd).drop("n")
        if crowded.isEmpty():
            break
        rows = checkpoint(rows.join(crowded, ["path", "pre"], "left_semi").select("path", "value", "fp"))
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    # the depth tells nodes of different levels apart
    rows = rows.select((F.col("path") * 64 + F.col("depth")).alias("path"), "pre", "depth", "value", "fp").repartition("path", "pre").sortWithinPartitions("path", "pre", "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def walk(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _linked(*columns, budget)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(x[0].size for x in held) >= ROWS:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
                end = int(last[-1]) + 1 if last.size else 0  # the last node may go on in the next batch
                held = [[x[end:] for x in columns]]
                if end:
                    yield walk([x[:end] for x in columns])
        if held:
            yield walk([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, shingle: int = 3) -> DataFrame:
    """Per row: id_col, fingerprint (16 hexadecimal digits) and component_id.

    Texts whose fingerprints differ in at most budget bits are linked; component_id is the smallest id that can be
    reached over links, the row's own included. Null and empty texts have fingerprint zero and are linked like any
    other. Rows with equal fingerprints need no links; repeated rows come out as they came in; a null id gets the
    smallest other id of its component, or null. An empty table gives an empty one.
    """
    found = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    # a fingerprint that many texts have, such as that of empty ones, is combined in parts, and each part of its rows meets one copy of its class
    found = found.withColumn("salt", salt("id"))
    nodes = found.groupBy("fp", "salt").agg(F.min("id").alias("first"))
    nodes = checkpoint(nodes.groupBy("fp").agg(F.min("first").alias("first"), salt_set("salt").alias("salts")))
    roots = components(trie_links(nodes.select("fp"), budget))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "salts", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id", F.explode(salts_in(F.col("salts"))).alias("salt"))
    return found.join(classes, ["fp", "salt"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
