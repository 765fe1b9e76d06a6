"""Chat formatting by columnar byte assembly.

A turn is written as a header, its text and a footer: ``### Role: `` text ``</turn>`` and a line end. Inside texts
and roles a backslash is doubled and one is put before each control string, so the output can be read back.
The segments of a whole batch go into one preallocated buffer: lengths give offsets, offsets give the place of
every byte, and headers, texts and footers are scattered there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import byte_slices

#: The template's control strings.
HEAD, COLON, FOOT = "### ", ": ", "</turn>"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
#: Bytes of roles and texts that one buffer is assembled from, unless a single turn is longer; escapes at most double them.
BYTES = 16 << 20
#: The roles whose texts are trained on.
TRAINED = ("assistant",)


def escape(column: pa.Array, controls: tuple[str, ...]) -> pa.Array:
    for control in ("\\", *controls):
        column = pc.replace_substring(column, control, "\\" + control)
    return column


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def scatter(out: np.ndarray, places: np.ndarray, column: pa.StringArray) -> None:
    """Copies each string of column to its place in out."""
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(ends)
    step, at, n = 1 << 20, 0, len(sizes)
    while at < n:  # the scatter indices of about a megabyte at a time
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
        stop = min(stop, n)
        shift = np.repeat(places[at:stop] - ends[at:stop], sizes[at:stop])
        source = np.arange(ends[at], ends[stop])
        out[source + shift] = raw[source]
        at = stop


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one string array, and where in each its escaped text begins and ends, in bytes."""
    heads = pc.binary_join_element_wise(HEAD, escape(role, (":",)), COLON, "")
    bodies = escape(text, (FOOT, HEAD.strip()))
    foot = np.frombuffer(f"{FOOT}\n".encode(), np.uint8)
    heads, bodies = heads.cast(pa.string()), bodies.cast(pa.string())
    head_size, body_size = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (heads, bodies))
    ends = np.cumsum(head_size + body_size + foot.size)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    scatter(out, starts, heads)
    scatter(out, starts + head_size, bodies)
    out[(ends - foot.size)[:, None] + np.arange(foot.size)] = foot
    offsets = np.r_[0, ends].astype(np.int64)
    turns = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(out))
    return turns.cast(pa.string()), head_size, head_size + body_size


def format_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Per turn: id_col, turn_col, formatted, loss_start and loss_end; conversations whole and in order.

    loss_start and loss_end bound, in code points of formatted, the escaped text that is trained on (both 0 in
    turns of other roles). Null roles and texts are empty. The turns of a conversation are sorted by turn_col,
    nulls first, then role and text, and stand in one partition one after another; a conversation's formatted
    text is the turns' joined, and is never held as a whole here. Repeated rows are repeated turns; a null id is a
    conversation of its own; an empty table gives an empty one. Other columns, whatever their names, are not read. A single
    turn may have a gigabyte, as Arrow's strings end at two; a longer one is an error.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, turn_col)}
    own = rows.select(rows[id_col].alias("id"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    own = own.repartition("id").sortWithinPartitions("id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3))).to_numpy(zero_copy_only=False)
            for at, stop in byte_slices(sizes, BYTES):
                batch = whole.slice(at, stop - at)
                formatted, start, end = assemble(batch.column(2), batch.column(3))
                head = pc.utf8_length(escape(batch.column(2), (":",))).to_numpy(zero_copy_only=False) + len(HEAD + COLON)
                body = pc.utf8_length(formatted).to_numpy(zero_copy_only=False) - head - len(FOOT) - 1
                mask = pc.is_in(batch.column(2), pa.array(trained, pa.string())).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), formatted, pa.array(np.where(mask, head, 0).astype(np.int64)), pa.array(np.where(mask, head + body, 0).astype(np.int64))], ["id", "turn", "formatted", "loss_start", "loss_end"])

    out = f"id {kinds[id_col]}, turn {kinds[turn_col]}, formatted string, loss_start bigint, loss_end bigint"
    return own.mapInArrow(run, out).withColumnsRenamed({"id": id_col, "turn": turn_col})


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of formatted turns."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def digest_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What format_turns wrote, read back: per conversation the counts and digests of its turns and of its loss mask.

    turns: the rows of format_turns as they come, so that a conversation's turns are neighbours; they are read one
    by one, and only a hash is kept, however long a conversation is.
    """
    kind = turns.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, state, kinds = None, None, None

        def rows(done: list, id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c) for c in columns[1:])], names)

        def closed() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done, kinds = [], batch.schema.field(0).type
            for now, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or now != key:
                    if state is not None:
                        done.append(closed())
                    key, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                loss = unescape(text[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if done:
                yield rows(done, kinds)
        if state is not None:
            yield rows([closed()], kinds)

    own = turns.select(turns[id_col].alias("id"), "formatted", "loss_start", "loss_end")
    out = f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return own.mapInArrow(run, out).withColumnRenamed("id", id_col)
