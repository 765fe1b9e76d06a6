"""Sets that have much in common, where few items occur in all: blocks of sets meet as bits, and what is alike leaves a task as lists, not as pairs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# tasks get these functions by value, as executors may not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS = 512  # items that are told apart by bits
IDS, LISTS = 65_536, 8_192  # ids and lists of a block, about
ROWS, CELLS = 1_024, 500_000  # sets of one side that are compared at a time, and ids of a batch that is given back


def items_of(lists: DataFrame) -> list | None:
    """The items of lists(items, ..), sorted; None if they are more than ITEMS."""
    found = lists.select(F.explode("items").alias("x")).distinct().limit(ITEMS + 1).collect()
    return sorted(r.x for r in found) if len(found) <= ITEMS else None


def alike(lists: DataFrame, items: list, least: float) -> DataFrame:
    """xs, ys, own, sure, shared, sizes of lists(items, piece, ids), the ids sorted: ids whose sets have a Jaccard index of ``least`` or more (above 0), with the number of common items and of both sets' together.

    Each x is like each y; where ``own`` holds, xs and ys are one list and stand for its pairs; where ``sure`` does, an x comes before its ys. Two ids are in one row's xs and ys at most.

    A block holds lists of sets of one size, so whether two blocks meet at all is known beforehand. Each list goes to the blocks that its own one meets.
    """
    codes = F.transform("items", lambda x: (F.array_position(F.array(*[F.lit(v) for v in items]), x) - 1).cast("int"))
    sizes = sorted(lists.groupBy(F.size("items").alias("n")).agg(F.count("*").alias("lists"), F.sum(F.size("ids")).alias("ids")).collect())
    room = max(4096, min(IDS, sum(r.ids for r in sizes) // 24))
    blocks, at = [], {}
    for r in sizes:
        many = max(-(-r.ids // room), -(-r.lists // LISTS))
        at[r.n] = (len(blocks), many)
        blocks += [r.n] * many
    meet = [(a, b) for a, n in enumerate(blocks) for b in range(a, len(blocks)) if n >= least * blocks[b] - 1e-9]
    spark = lists.sparkSession
    kind = lists.schema["ids"].dataType.elementType.simpleString()
    out = f"xs array<{kind}>, ys array<{kind}>, own boolean, sure boolean, shared bigint, sizes int"
    if not meet:
        return spark.createDataFrame([], out)
    first = spark.createDataFrame([(n, k, many) for n, (k, many) in at.items()], "n int, first int, many int")
    goes = [(b, k, s) for k, (a, c) in enumerate(meet) for b, s in ((a, 0), (c, 1)) if a < c or s == 0]
    goes = spark.createDataFrame(goes, "block int, task int, side int").groupBy("block").agg(F.collect_list(F.struct("task", "side")).alias("to"))
    own = lists.select(codes.alias("codes"), "ids", F.size("items").alias("n"), F.xxhash64("items", "piece").alias("h")).join(F.broadcast(first), "n")
    own = own.select("codes", "ids", (F.col("first") + F.pmod("h", "many")).cast("int").alias("block"))
    sent = own.join(F.broadcast(goes), "block").select("codes", "ids", F.explode("to").alias("t")).select("t.task", "t.side", "codes", "ids")
    columns, loops = len(items), [a == b for a, b in meet]

    def run(batches):
        for task, table in by_task(batches):
            sides = [table.filter(pc.equal(table["side"], s)) for s in (0, 1)]
            yield from compare(sides[0], sides[0] if loops[task] else sides[1], columns, least, loops[task])

    dealt = sent.repartition(len(meet), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, out)


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each task, of batches in order of their tasks."""
    held, task = [], None
    for batch in batches:
        tasks = batch["task"].to_numpy()
        for part in np.split(np.arange(len(tasks)), np.flatnonzero(np.diff(tasks)) + 1):
            if not len(part):
                continue
            if held and tasks[part[0]] != task:
                yield task, pa.Table.from_batches(held)
                held = []
            task = int(tasks[part[0]])
            held.append(batch.slice(part[0], len(part)))
    if held:
        yield task, pa.Table.from_batches(held)


class Lists:
    """The sets of a side as rows of bits, and their ids one after the other."""

    def __init__(self, table: pa.Table, columns: int):
        codes, ids = table["codes"].combine_chunks(), table["ids"].combine_chunks()
        n = codes.value_lengths().to_numpy()
        self.size = int(n[0]) if len(n) else 0
        bits = np.zeros((len(n), -(-columns // 64) * 64), bool)
        bits[np.repeat(np.arange(len(n)), n), codes.flatten().to_numpy()] = True
        self.sets = np.packbits(bits, axis=1).view(np.uint64)
        self.long = ids.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.long) - self.long
        self.ids = ids.flatten()
        self.ends = [self.ids.take(pa.array(at)).to_numpy(zero_copy_only=False) for at in (self.start, self.start + self.long - 1)]

    def lists(self, rows: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Lists of the ids of rows; one list ends after each of ``ends`` rows."""
        long = self.long[rows]
        done = np.cumsum(long)
        places = np.arange(done[-1]) + np.repeat(self.start[rows] - (done - long), long)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], done[ends - 1]]), pa.int32()), self.ids.take(pa.array(places)))


def compare(a: pa.Table, b: pa.Table, columns: int, least: float, loop: bool) -> Iterator[pa.RecordBatch]:
    """The rows of ``alike`` for the lists of two blocks; loop: both are the same."""
    if not len(a) or not len(b):
        return
    x = Lists(a, columns)
    y = x if loop else Lists(b, columns)
    sizes = x.size + y.size
    # the least number of common items, by the same comparison that a pair has to pass
    enough = next((k for k in range(1, min(x.size, y.size) + 1) if k / (sizes - k) >= least - 1e-12), None)
    if enough is None:
        return
    names = ["xs", "ys", "own", "sure", "shared", "sizes"]
    # the first and last ids of lists as numbers in their order
    place = np.unique(np.concatenate([e.astype(str) if e.dtype == object else e for e in x.ends + y.ends]), return_inverse=True)[1]
    x0, x1, y0, y1 = np.split(place, np.cumsum([len(x.long), len(x.long), len(y.long)]))

    def batch(xs, ys, own, sure, shared):
        n = len(xs)
        return pa.RecordBatch.from_arrays([xs, ys, pa.array(np.full(n, own)), pa.array(np.full(n, sure)), pa.array(shared.astype(np.int64)), pa.array(np.full(n, sizes, np.int32))], names)

    if loop:
        for rows in pieces(np.arange(len(x.long)), x.long):
            ids = x.lists(rows, np.arange(1, len(rows) + 1))
            yield batch(ids, ids, True, True, np.full(len(rows), x.size))
    for k in range(0, len(x.long), ROWS):
        common = sum(np.bitwise_count(x.sets[k : k + ROWS, w, None] & y.sets[None, :, w]).astype(np.uint16) for w in range(x.sets.shape[1]))
        r, c = np.nonzero(np.triu(common >= enough, k + 1) if loop else common >= enough)
        if not len(r):
            continue
        s, before, after = common[r, c], x1[k + r] < y0[c], y1[c] < x0[k + r]
        for sure, turned, some in ((True, False, before), (True, True, after), (False, False, ~(before | after))):
            for xs, ys, shared in grouped(x, y, k + r[some], c[some], s[some]):
                yield batch(*((ys, xs) if turned else (xs, ys)), False, sure, shared)


def grouped(x: Lists, y: Lists, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """The lists r of x, each with the ids of all lists c of y that it has the same number s of items in common with."""
    if not len(r):
        return
    order = np.lexsort((s, r))
    r, c, s = r[order], c[order], s[order]
    firsts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])]))
    cost = np.add.reduceat(y.long[c], firsts) + x.long[r[firsts]]
    for groups in pieces(np.arange(len(firsts)), cost):
        lo, hi = firsts[groups[0]], firsts[groups[-1] + 1] if groups[-1] + 1 < len(firsts) else len(r)
        ends = np.append(firsts[groups[1:]], hi) - lo
        yield x.lists(r[firsts[groups]], np.arange(1, len(groups) + 1)), y.lists(c[lo:hi], ends), s[firsts[groups]]


def pieces(rows: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in pieces of a cost of about CELLS each."""
    part = np.cumsum(cost) // CELLS
    yield from (p for p in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(p))


def pairs_of(rows: DataFrame) -> DataFrame:
    """a < b and the further columns of the rows of ``alike``."""
    more = [c for c in rows.columns if c not in ("xs", "ys", "own", "sure")]
    one = rows.select(F.posexplode("xs").alias("i", "x"), "ys", "own", "sure", *more)
    ys = F.when(F.col("own"), F.slice("ys", F.col("i") + 2, F.size("ys"))).otherwise(F.col("ys"))
    first = F.col("sure") | (F.col("x") < F.col("y"))
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return one.select("x", F.explode(ys).alias("y"), "sure", *more).select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), *more)
