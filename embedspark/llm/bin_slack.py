"""Minimum-bin-slack packing of documents into sequences of a fixed number of tokens.

A window is seeded with the longest remaining piece. A subset-sum dynamic programme over the remaining
lengths, with one bit per reachable sum, then finds the multiset of pieces that fills the window closest to
its capacity, and walking back through the programme's bit sets gives the number of pieces of each length.
Lengths enter the programme longest first and it stops once the window is known to fill exactly.

Documents longer than a window give whole windows first; only what is left of them is packed. A window
that no multiset fills exactly takes the head of a further piece, whose tail stays unpacked: that piece is
the shortest one, which wastes the least freedom. So no window but the last has padding. What is left in the end,
less than one window, is cut into sequences whose lengths are powers of two, which need none either.

Spark packs the documents of a task by themselves, in pools of bounded size: a pool is filled up to
``pool_tokens`` and packed down to half of that, so that there is always a choice. Each task ends with less than a window.
These remainders, at most ``capacity`` ids a task whatever the table's size, are packed again,
``_FAN_IN`` tasks of the level below in one task, until one is left. Nothing else is shuffled and nothing passes
through the driver. A repeated task gives the same rows.

Null texts count as empty: their only id is the end id. Rows with a null or repeated key, and equal rows, are
packed like any other, each row by itself. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from embedspark.llm.common import frugal, text_slices, written
from embedspark.llm.tokens import SLICE_BYTES, encoder

_FAN_IN = 64
_LEVEL, _TASK = 56, 32  # bits of a sequence's number below its level and below its task
_NAMES = ["doc_id", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset", "origin"]
_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, origin bigint"
)


def closest_fill(counts: Callable[[int], int], lengths: list[int], room: int) -> dict[int, int]:
    """Pieces per length whose lengths add up to ``room``, or else come closest to it from below.

    ``lengths`` in ascending order; ``counts`` tells how many pieces of a length there are. Bit s of a set
    tells whether some pieces add up to s. A count enters as multiples 1, 2, 4, ... and a rest, so a length
    takes few steps.
    """
    sums, all_sums, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        left, times = min(counts(length), room // length), 1
        while left:
            times = min(times, left)
            steps.append((sums, length, times))
            sums |= sums << (length * times) & all_sums
            left -= times
            times *= 2
        if sums & goal:
            break
    rest, taken = sums.bit_length() - 1, defaultdict(int)
    for before, length, times in reversed(steps):
        if not before >> rest & 1:
            taken[length] += times
            rest -= length * times
    return dict(taken)


class Pool:
    """Pieces not yet packed: (document, start) by length."""

    def __init__(self, capacity: int):
        self.capacity, self.tokens = capacity, 0
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []  # ascending

    def add(self, document: int, start: int, length: int) -> None:
        if length not in self.pieces:
            insort(self.lengths, length)
            self.pieces[length] = []
        self.pieces[length].append((document, start))
        self.tokens += length

    def take(self, length: int) -> tuple[int, int]:
        own = self.pieces[length]
        piece = own.pop()
        if not own:
            del self.pieces[length], self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        return piece

    def _cut(self, length: int, head: int, window: list) -> None:
        document, start = self.take(length)
        window.append((document, start, head))
        self.add(document, start + head, length - head)

    def windows(self, low: int) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, until less than ``low`` tokens or less than a window are left."""
        while self.tokens >= max(low, self.capacity):
            seed = self.lengths[-1]
            window = [(*self.take(seed), seed)]
            filling = closest_fill(lambda x: len(self.pieces[x]), self.lengths, self.capacity - seed)
            for length, times in sorted(filling.items(), reverse=True):
                window += [(*self.take(length), length) for _ in range(times)]
            gap = self.capacity - sum(length for *_, length in window)
            if gap:  # all that is left is longer than the gap
                self._cut(self.lengths[0], gap, window)
            yield window

    def remainder(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, less than a window, in sequences whose lengths are powers of two."""
        while self.tokens:
            room, window = 1 << (self.tokens.bit_length() - 1), []
            while room:
                fits = bisect_right(self.lengths, room)
                if not fits:
                    self._cut(self.lengths[0], room, window)
                    break
                length = self.lengths[fits - 1]
                window.append((*self.take(length), length))
                room -= length
            yield window

    def rest(self) -> list[tuple[int, int, int]]:
        return [(document, start, length) for length, own in self.pieces.items() for document, start in own]


class _Packer:
    """Turns the windows of a task into record batches; holds the ids of unpacked documents only."""

    def __init__(self, capacity: int, level: int, keep_ids: bool):
        self.pool, self.capacity, self.keep_ids = Pool(capacity), capacity, keep_ids
        self.sequence = (level << _LEVEL) | (TaskContext.get().partitionId() << _TASK)
        self.of: dict[int, tuple] = {}  # ids, how many ids of the document come before them, key, tokens of the document
        self.open: dict[int, int] = {}  # tokens of a document that are not packed yet
        self.next, self.columns = 0, [[] for _ in range(8)]

    def add(self, key, ids: np.ndarray, before: int, doc_tokens: int) -> None:
        document, self.next = self.next, self.next + 1
        self.of[document], self.open[document] = (ids, before, key, doc_tokens), len(ids)
        start, whole = 0, len(ids) - len(ids) % self.capacity
        while start < whole:
            self.place([(document, start, self.capacity)])
            start += self.capacity
        if start < len(ids):
            self.pool.add(document, start, len(ids) - start)

    def _row(self, document, start, length, sequence, offset, ids=False):
        own, before, key, doc_tokens = self.of[document]
        data = memoryview(own[start : start + length]).cast("B")
        row = (key, before + start, length, zlib.crc32(data), bytes(data) if self.keep_ids or ids else None, doc_tokens, sequence, offset)
        for column, value in zip(self.columns, row):
            column.append(value)
        self.open[document] -= length
        if not self.open[document]:
            del self.of[document], self.open[document]

    def place(self, window) -> None:
        offset = 0
        for document, start, length in window:
            self._row(document, start, length, self.sequence, offset)
            offset += length
        self.sequence += 1

    def forward(self, origin: int) -> Iterator[pa.RecordBatch]:
        """The unpacked rest as rows without a sequence."""
        for document, start, length in self.pool.rest():
            self._row(document, start, length, None, None, ids=True)
        yield from self.batch(origin)

    def batch(self, origin: int | None = None) -> Iterator[pa.RecordBatch]:
        if not self.columns[0]:
            return
        kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
        arrays = [pa.array(column, kind) for column, kind in zip(self.columns, kinds)]
        arrays.append(pa.array([origin] * len(arrays[0]), pa.int64()))
        self.columns = [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    def pack(self, low: int) -> Iterator[pa.RecordBatch]:
        for window in self.pool.windows(low):
            self.place(window)
        yield from self.batch()


def _documents(path: str, end_id: int, capacity: int, keep_ids: bool, pool_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(path), _Packer(capacity, 0, keep_ids)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids, bounds = words.encode_array(part.column("text"), end_id)
                bounds = bounds.tolist()
                for key, first, last in zip(part.column("key").to_pylist(), bounds[:-1], bounds[1:]):
                    # Packed documents must not keep the ids of the whole slice.
                    packer.add(key, ids[first:last].copy(), 0, last - first)
                if packer.pool.tokens > pool_tokens:
                    yield from packer.pack(pool_tokens // 2)
                yield from packer.batch()
        yield from packer.pack(0)
        yield from packer.forward(TaskContext.get().partitionId())

    return frugal(pack)


def _remainders(capacity: int, keep_ids: bool, level: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, origin = _Packer(capacity, level, keep_ids), 0
        for batch in batches:
            origin = batch.column("origin")[0].as_py() // _FAN_IN
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "ids", "start", "doc_tokens")]
            for key, ids, start, doc_tokens in zip(*columns):
                packer.add(key, np.frombuffer(ids, "<u4"), start, doc_tokens)
            yield from packer.pack(0)
        if last:
            for window in packer.pool.remainder():
                packer.place(window)
            yield from packer.batch()
        else:
            yield from packer.forward(origin)

    return frugal(pack)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = True,
    pool_tokens: int = 2_000_000,
) -> DataFrame:
    """Every id of every document in one piece each: doc_id, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its sequence. ``ids``
    (little-endian, 32 bits) is null without ``keep_ids``. Sequences hold ``capacity`` ids, but for less
    than log2(capacity) + 1 of the whole table, whose sizes are powers of two.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    packed = written(rows.mapInArrow(_documents(tokenizer, end_id, capacity, keep_ids, pool_tokens), _SCHEMA), codec="zstd")
    done = [packed.where("sequence_id IS NOT NULL")]
    rest, level = packed.where("sequence_id IS NULL"), 0
    tasks = rest.agg(F.max("origin")).first()[0]
    while tasks is not None:
        level += 1
        groups = tasks // _FAN_IN + 1
        # A range of origins falls to one task, whole groups of _FAN_IN; the scan before stays spread.
        spread = rest.repartitionByRange(groups, F.floor(F.col("origin") / _FAN_IN)) if groups > 1 else rest.repartition(1)
        packed = written(spread.mapInArrow(_remainders(capacity, keep_ids, level, groups == 1), _SCHEMA), codec="zstd")
        done.append(packed.where("sequence_id IS NOT NULL"))
        rest = packed.where("sequence_id IS NULL")
        tasks = rest.agg(F.max("origin")).first()[0]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("origin")


def sequences(packed: DataFrame, capacity: int, pad_id: int) -> DataFrame:
    """The training windows: sequence_id, n_tokens, ids, padded to ``capacity`` unless their size is a power of two."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    found = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pads = F.when(power, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), pads))
    return found.withColumn("ids", F.concat("ids", padding))
