"""Repeated runs of lines, found by winnowing line hashes.

Blank lines aside, a window is the shortest stretch of lines from a given one that has ``min_words`` words. In each
window the line with the least hash is selected as a fingerprint, so two texts that share a run of min_words words
select a common line in it. Where a fingerprint occurs more than once, the match is extended both ways: all windows
over that line, those from each line on and those up to each line, are compared by content. A window that occurred before,
in order of id and place, is deleted; together these windows cover every repeated run from end to end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpoint, flagged, free_name, hash_filter, salt, salt_set, salts_in, text_chunks

RECORD = np.dtype([("hash", "V16"), ("words", "<i4"), ("row", "<i4")])


def lines_of(text: str | None) -> np.ndarray:
    """Hash, words and row number of each line that is not blank. White space around a line doesn't count."""
    out = [(xxhash.xxh3_128_digest(s.encode()), len(s.split()), k) for k, line in enumerate((text or "").split("\n")) if (s := line.strip())]
    return np.array(out, RECORD)


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of all windows: the shortest from each line on, then the shortest up to each line."""
    total = np.r_[0, np.cumsum(words)]
    n = words.size
    last = np.searchsorted(total, total[:n] + min_words)  # the line before this place completes the window
    ok = last <= n
    forward = np.arange(n)[ok], last[ok] - 1
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ok = first >= 0
    return np.r_[forward[0], first[ok]], np.r_[forward[1], np.arange(n)[ok]]


def selected(lines: np.ndarray, min_words: int) -> np.ndarray:
    """The lines that are the least of a window, the leftmost of equal ones."""
    first, last = windows(lines["words"], min_words)
    n = int((np.searchsorted(np.r_[0, np.cumsum(lines["words"])], np.r_[0, np.cumsum(lines["words"])][:-1] + min_words) <= lines.size).sum())
    order = _order(lines)
    return np.array(sorted({a + int(order[a : b + 1].argmin()) for a, b in zip(first[:n].tolist(), last[:n].tolist(), strict=True)}), np.int64)


def _order(lines: np.ndarray) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(lines["hash"]).tobytes(), "<i8").reshape(-1, 2)[:, 0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, lines_col: str = "n_lines", deleted_col: str = "n_deleted") -> DataFrame:
    """docs with later repeats of runs of lines deleted, and columns lines_col and deleted_col added.

    A run is a stretch of lines with min_words words or more in all. Of equal runs the one in the row with the
    smallest id (null ids first, then by a hash of the text) and there the earliest stays; where a later one overlaps it in the same text, only
    the lines past it go. Shorter repeats stay, as do texts that are null (0 lines) or have fewer words. Rows that repeat both id and
    text are one document and come out alike. Of a text that is one repeated run nothing is left but an empty text.
    An empty table gives an empty one. Other columns are unchanged, whatever their names; where docs has a column of the name of a
    new one, the new one's name gets underscores at its end (n_lines_).

    A text moves only if some hash filter of the deletions has its row: with few deletions most rows are passed on where they are read.
    """
    names = {c: free_name(c, docs.columns) for c in (lines_col, deleted_col)}
    kind = docs.schema[id_col].dataType.simpleString()
    # the row as a whole, so that its columns can't clash with those below
    keyed = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col]).alias("th"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            lines = [lines_of(t) for t in texts]
            chosen = [selected(x, min_words) for x in lines]
            prints = [_order(x)[p].tolist() for x, p in zip(lines, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in lines], pa.binary()), pa.array([p.tolist() for p in chosen], pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))], ["id", "th", "lines", "places", "prints"])

    rows = keyed.select("id", "th", "text")
    found = checkpoint(rows.mapInArrow(scan, f"id {kind}, th bigint, lines binary, places array<bigint>, prints array<bigint>").where(F.size("places") > 0))
    prints = found.select("id", "th", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("id", "th", F.col("p.prints").alias("h"), F.col("p.places").alias("place"), salt("id", "th").alias("salt"))
    again = prints.groupBy("h", "salt").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), salt_set("salt").alias("salts")).where("n > 1")
    again = again.select("h", F.explode(salts_in(F.col("salts"))).alias("salt"))
    hits = prints.join(again, ["h", "salt"], "left_semi").groupBy("id", "th").agg(F.collect_set("place").alias("hits"))

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, index = batch.column(0), []
            for k, (th, raw, hits) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                lines = np.frombuffer(raw, RECORD)
                first, last = windows(lines["words"], min_words)
                hit = np.zeros(lines.size + 1, np.int64)
                hit[np.array(hits) + 1] = 1
                hit = np.cumsum(hit)
                over = hit[last + 1] > hit[first]
                digests = np.ascontiguousarray(lines["hash"]).tobytes()
                for a, b in sorted(set(zip(first[over].tolist(), last[over].tolist(), strict=True))):
                    index.append(k)
                    out.append((th, xxhash.xxh3_128_digest(digests[16 * a : 16 * b + 16]), int(lines["row"][a]), int(lines["row"][b])))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True))], ["id", "th", "content", "first", "last"])

    same = (F.col("l.id").eqNullSafe(F.col("r.id"))) & (F.col("l.th").eqNullSafe(F.col("r.th")))
    matched = found.alias("l").join(hits.alias("r"), same).select("l.id", "l.th", "l.lines", "r.hits")
    runs = matched.mapInArrow(extend, f"id {kind}, th bigint, content binary, first int, last int").distinct()
    runs = checkpoint(runs.withColumn("salt", salt("id", "th")))
    # a run that many texts have is combined in parts, and each part of its rows meets one copy of its beginning
    begun = runs.groupBy("content", "salt").agg(F.min(F.struct("id", "th", "first", "last")).alias("begun"), F.count("*").alias("n"))
    begun = begun.groupBy("content").agg(F.min("begun").alias("begun"), F.sum("n").alias("n"), salt_set("salt").alias("salts")).where("n > 1")
    begun = begun.select("content", "begun", F.explode(salts_in(F.col("salts"))).alias("salt"))
    own = F.col("id").eqNullSafe(F.col("begun.id")) & F.col("th").eqNullSafe(F.col("begun.th"))
    later = runs.join(begun, ["content", "salt"]).where(~(own & (F.col("first") == F.col("begun.first"))))
    later = later.select("id", "th", F.when(own, F.greatest("first", F.col("begun.last") + 1)).otherwise(F.col("first")).alias("first"), "last").where("first <= last")
    gone = checkpoint(later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("gone")).withColumnsRenamed({"id": "gone_id", "th": "gone_th"}))

    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i <= g["last"])))
    keyed = flagged(keyed, F.xxhash64("id", "th"), hash_filter(gone.select(F.xxhash64("gone_id", "gone_th"))), "maybe")
    whole = keyed.where(~F.col("maybe")).select("row", "text", F.lit(None).cast("array<string>").alias("kept"))
    cut = keyed.where("maybe").join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & F.col("th").eqNullSafe(F.col("gone_th")), "left")
    out = whole.unionByName(cut.select("row", "text", F.when(F.col("gone").isNotNull(), kept).alias("kept")))
    new = F.when(F.col("kept").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    columns = [new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    deleted = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept"))
    return out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint").alias(names[lines_col]), deleted.cast("bigint").alias(names[deleted_col]))
