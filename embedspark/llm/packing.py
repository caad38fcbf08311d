"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A sequence is filled greedily, longest piece first. If a gap is left, its smallest piece is taken
back and two unpacked pieces that fill the widened gap better are put there instead.

Pieces of one length are interchangeable, so the decisions need the number of pieces per length only:
at most ``capacity`` numbers, however many documents there are. The driver runs best-two-fit on these
numbers and repeats a filling as often as the pieces last, which is what the piece-by-piece algorithm
does. The result is a list of fillings whose size is bounded by the capacity. Spark numbers the pieces
of each length (per task, then over tasks) and each piece looks up its sequence by its number.

Null texts count as empty (their only token is the end id). Rows with a null or repeated key are packed
like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from embedspark.llm.common import frugal, text_slices, written
from embedspark.llm.tokens import SLICE_BYTES, encoder


def _within(lengths: np.ndarray) -> np.ndarray:
    """How many earlier entries have the same value."""
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], lengths[order], side="left")
    place = np.empty(len(lengths), "i8")
    place[order] = np.arange(len(lengths)) - first
    return place


def _cut(path: str, end_id: int, capacity: int, digests: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(capacity + 1, "i8")
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids, bounds = words.encode_array(part.column("text"), end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, sizes[row] - capacity * piece)
                ends = 4 * np.cumsum(length)
                data = pa.py_buffer(ids)
                if digests:
                    view = memoryview(ids).cast("B")
                    own = pa.array([zlib.crc32(view[a:b]) for a, b in zip((ends - 4 * length).tolist(), ends.tolist())], pa.int64())
                else:
                    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype("i4"))
                    own = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, data])
                nth = seen[length] + _within(length)
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [
                    part.column("key").take(pa.array(row)),
                    pa.array(piece.astype("i4")),
                    pa.array(capacity * piece),
                    pa.array(length),
                    own,
                    pa.array(np.full(len(row), task, "i8")),
                    pa.array(nth),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "own", "task", "nth"])

    return frugal(cut)


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids, task, nth.

    ``nth`` numbers the pieces of one length inside a task. The table is written to the shared folder,
    so that these numbers hold from then on. With ``digests`` a piece carries the CRC of its ids,
    ``ids_crc32``, in their stead.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    own = ("ids_crc32", "bigint") if digests else ("ids", "binary")
    pieces = rows.mapInArrow(
        _cut(tokenizer, end_id, capacity, digests),
        f"doc_id bigint, piece int, start bigint, length bigint, own {own[1]}, task bigint, nth bigint",
    )
    return written(pieces.withColumnRenamed("own", own[0]), codec="zstd")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings [(times, [(length, pieces of it), ...])] for so many pieces per length."""
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    fillings = []
    while lengths:
        greedy: dict[int, int] = {}
        gap, top = capacity, len(lengths)
        while gap > 0:
            top = bisect_right(lengths, gap, 0, top)
            if not top:
                break
            longest = lengths[top - 1]
            take = min(gap // longest, left[longest])
            greedy[longest] = take
            gap -= take * longest
            top -= 1
        final = dict(greedy)
        if gap > 0 and sum(greedy.values()) > 1:
            smallest = min(greedy)
            pair = _two(lengths, left, greedy, smallest, gap + smallest)
            if pair:
                final[smallest] -= 1
                for length in pair:
                    final[length] = final.get(length, 0) + 1
                final = {length: n for length, n in final.items() if n}
        need = {x: max(greedy.get(x, 0), final.get(x, 0)) for x in final}
        times = min((left[x] - need[x]) // final[x] for x in final) + 1
        fillings.append((times, sorted(final.items(), reverse=True)))
        for length, n in final.items():
            left[length] -= times * n
            if not left[length]:
                del lengths[bisect_left(lengths, length)]
    return fillings


def _two(lengths, left, taken, smallest, room):
    """The two unpacked pieces that fill the room best, if better than the smallest piece did."""

    def free(length):
        # The smallest piece itself counts as unpacked again.
        return left[length] - taken.get(length, 0) + (length == smallest)

    best, found = smallest, None
    last = bisect_right(lengths, room - 1)
    for i in range(last - 1, -1, -1):
        a = lengths[i]
        if 2 * a <= best:
            break
        if not free(a):
            continue
        j = bisect_right(lengths, min(a, room - a)) - 1
        while j >= 0:
            b = lengths[j]
            if free(b) > (a == b):
                if a + b > best:
                    best, found = a + b, (a, b)
                break
            j -= 1
        if best == room:
            break
    return found


class _Plan:
    """Where the n-th piece of a length goes."""

    def __init__(self, fillings):
        rows, used, base = [], {}, 0
        for times, items in fillings:
            offset = 0
            for length, n in items:
                first = used.get(length, 0)
                rows.append((length, first, n, base, offset))
                used[length] = first + times * n
                offset += n * length
            base += times
        rows.sort()
        self.rows = np.array(rows, dtype="i8").reshape(-1, 5)
        self.sequences = base

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # One sorted key out of (length, number): numbers stay far below 2**48.
        keys = (self.rows[:, 0] << 48) + self.rows[:, 1]
        row = self.rows[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
        inside = number - row[:, 1]
        return row[:, 3] + inside // row[:, 2], row[:, 4] + inside % row[:, 2] * length


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``length``, ``task`` and ``nth``."""
    totals = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _Plan(best_two_fit(counts, capacity))
    names = [name for name in pieces.columns if name not in ("task", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            sequence, offset = plan.places(length, number)
            columns = [batch.column(name) for name in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    numbered = pieces.join(firsts, ["task", "length"]).withColumn("number", F.col("first") + F.col("nth"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names]
    return numbered.select(*names, "number").mapInArrow(
        place, ", ".join([*fields, "sequence_id bigint", "offset bigint"])
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, from pieces that carry ``ids``."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
