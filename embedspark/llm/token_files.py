"""Token ids in directly addressable files.

Every id is split into 8-bit chunks. Level one holds the lowest chunk of every id, level two the next
chunk of those ids that have one, and so on. A bitmap per level marks the ids that go on, and a rank
directory counts the marks before every 512th bit, so the place of an id's next chunk is one count
away. Any id is read by at most four such steps; nothing else is decoded.

A file is a Parquet table of segments written by Spark, so any store that Spark writes to will do and a
lost task is only repeated. A segment holds whole documents, about ``segment_tokens`` ids, in the order of
the key: columns ``part, seq, start`` (ids before it in its part), ``n_tokens``, ``doc_ids``,
``lengths`` and ``payload``. The payload's bytes:

====================  ===================================================================
``DAC1``              marks the format
u8 levels             number of levels, 1 to 4
u64 * levels          number of chunks of each level
per level             the chunks, one byte each; then, but for the last level, the bitmap (bit i of
                      byte i // 8) and the rank directory (u32 for every 64 bytes of the bitmap)
====================  ===================================================================

Null texts count as empty, null keys come first, rows of the same key are ordered by a hash of their
text, equal rows are written once each. An empty table gives no segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from embedspark.llm.common import frugal, long_list, text_slices
from embedspark.llm.tokens import SLICE_BYTES, encoder

_SCHEMA = (
    "part int, seq int, start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
)
_BLOCK = 64
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype="u1")


def pack_ids(ids: np.ndarray) -> bytes:
    """The payload of an array of ids below 2**32."""
    rest, levels = np.asarray(ids, dtype="u4"), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_ONES[bits].astype("u4"), np.arange(0, len(bits), _BLOCK)) if len(bits) else []
        directory = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(bits) else np.zeros(0)
        levels.append((rest.astype("u1"), bits, directory.astype("<u4")))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    parts = [b"DAC1", struct.pack(f"<B{len(levels)}Q", len(levels), *[len(c) for c, _, _ in levels])]
    for number, (chunks, bits, directory) in enumerate(levels, 1):
        parts.append(chunks.tobytes())
        if number < len(levels):
            parts += [bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


class PackedIds:
    """Reads ids out of a payload without decoding it."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a payload of packed ids")
        count = payload[4]
        sizes = struct.unpack_from(f"<{count}Q", payload, 5)
        at, self.levels = 5 + 8 * count, []
        for number, size in enumerate(sizes, 1):
            chunks = np.frombuffer(payload, "u1", size, at)
            at += size
            bits = directory = None
            if number < count:
                width = (size + 7) // 8
                bits = np.frombuffer(payload, "u1", width, at)
                at += width
                blocks = (width + _BLOCK - 1) // _BLOCK
                directory = np.frombuffer(payload, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[place]) << shift
            if bits is None or not bits[place >> 3] >> (place & 7) & 1:
                break
            block, byte = place // (8 * _BLOCK), place >> 3
            rank = int(directory[block]) + int(_ONES[bits[block * _BLOCK : byte]].sum())
            rank += int(_ONES[bits[byte] & ((1 << (place & 7)) - 1)])
            place, shift = rank, shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        above = np.zeros(0, "u4")
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype("u4")
            if bits is not None:
                ids[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))] |= above << np.uint32(8)
            above = ids
        return above


def _segments(path: str, end_id: int, segment_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words = TaskContext.get().partitionId(), encoder(path)
        seq, before, held, keys, rows = 0, 0, 0, [], []

        def segment():
            ids = np.concatenate(rows)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([seq], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                long_list([np.array([len(r) for r in rows])]),
                pa.array([pack_ids(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                columns, names=["part", "seq", "start", "n_tokens", "doc_ids", "lengths", "payload"]
            )

        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                flat, bounds = words.encode_array(piece.column("text"), end_id)
                bounds = bounds.tolist()
                for key, first, last in zip(piece.column("key").to_pylist(), bounds[:-1], bounds[1:]):
                    rows.append(flat[first:last])
                    keys.append(key)
                    held += last - first
                    if held >= segment_tokens:
                        yield segment()
                        seq, before, held, keys, rows = seq + 1, before + held, 0, [], []
        if rows:
            yield segment()

    return frugal(encode)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    segment_tokens: int = 1 << 20,
) -> None:
    """Encodes every text and writes its ids, in ascending order of the key, below ``folder``.

    One shuffle by ranges of (key, text hash), so that even rows of one key spread over tasks.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie")
    ordered = ordered.sortWithinPartitions("key", "tie").select("key", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), _SCHEMA).write.mode("errorifexists").option(
        "compression", "uncompressed"
    ).parquet(folder)


def _part_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each part. One number per task that wrote, however large the table is."""
    sums = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, before = {}, 0
    for part, n in sorted((row["part"], row["n"]) for row in sums):
        starts[part], before = before, before + n
    return starts


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids (u32 little-endian)."""
    starts = spark.sparkContext.broadcast(_part_starts(spark, folder))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = PackedIds(row["payload"]).all().astype("<u4").tobytes()
                ends = np.cumsum(np.array(row["lengths"], dtype="i8"))
                begins = ends - np.array(row["lengths"], dtype="i8")
                base = starts.value[row["part"]] + row["start"]
                for first in range(0, len(ends), 1000):
                    b, e = begins[first : first + 1000], ends[first : first + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"][first : first + 1000], pa.int64()),
                            pa.array(base + b),
                            pa.array([data[4 * x : 4 * y] for x, y in zip(b, e)], pa.binary()),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    segments = spark.read.parquet(folder).select("part", "start", "doc_ids", "lengths", "payload")
    return segments.mapInArrow(frugal(documents), "doc_id bigint, start bigint, ids binary")


def read_tokens(spark: SparkSession, folder: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """The ids at given places of the whole token sequence: position, token_id.

    Places outside it give no row. Each place is found by its part (a broadcast of one number per
    writing task), joined with that part's segments, and read directly.
    """
    starts = _part_starts(spark, folder)
    parts, begins = list(starts), np.array(list(starts.values()), dtype="i8")

    @F.pandas_udf("int")
    def part_of(place):
        import pandas as pd

        at = np.searchsorted(begins, place.to_numpy(), side="right") - 1
        return pd.Series([parts[i] if i >= 0 else -1 for i in at], dtype="i4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [PackedIds(r["payload"])[r["place"] - r["from"]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["place"] for r in rows], pa.int64()), pa.array(ids, pa.int64())],
                names=["position", "token_id"],
            )

    base = F.create_map(*[F.lit(x) for item in starts.items() for x in item]) if starts else None
    if base is None:
        return spark.createDataFrame([], "position bigint, token_id bigint")
    segments = spark.read.parquet(folder).withColumn("from", F.col("start") + base[F.col("part")])
    places = positions.select(F.col(position).cast("bigint").alias("place")).where("place >= 0")
    found = places.withColumn("part", part_of("place")).join(
        segments.select("part", "from", "n_tokens", "payload"), "part"
    )
    inside = found.where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("n_tokens")))
    return inside.select("place", "from", "payload").mapInArrow(read, "position bigint, token_id bigint")
