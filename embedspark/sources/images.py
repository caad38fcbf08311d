"""Image sources. A packed image is (w, h, channels, data BINARY) with rows of RGB(A) bytes.

Files go through Spark's ``image`` source, which knows JPEG, PNG, GIF and BMP. Payload columns hold
bytes that no file backs; for them a small PNG reader runs inside the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from embedspark.constants import MAX_IMAGE_BYTES
from embedspark.functions import payload as fn
from embedspark.functions.arrow import once_per_row
from embedspark.session import shared_folder
from embedspark.sources import folder

PACKED = T.StructType(
    [
        T.StructField("w", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_PIXELS_PER_BATCH = 1 << 16
_IMAGES_PER_BATCH = 64
_TASKS_PER_CORE = 4  # in which a folder of files is decoded
_LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"
_GROUP_BYTES = 1 << 18  # of pictures whose filters are undone together


def image_files(spark: SparkSession, path: str, limit: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Every image file as path, length, status and payload; files above the limit have no payload.

    The length test goes into both scans, so that contents of refused files are never read.
    """
    files = spark.read.format("binaryFile").load(path)
    length = F.col("length")
    accepted = files.where(length <= limit).select(
        "path", "length", fn.status(fn.OK).alias("status"), F.col("content").alias("payload")
    )
    refused = files.where(length > limit).select(
        "path", "length", fn.size_status(length, limit).alias("status"), F.lit(None).cast("binary").alias("payload")
    )
    return accepted.unionByName(refused)


@F.arrow_udf(T.BinaryType())
def _swap_channels(data: pa.Array, channels: pa.Array) -> pa.Array:
    """BGR(A) to RGB(A)."""
    out = []
    for value, count in zip(data.to_pylist(), channels.to_pylist()):
        if value is None or count < 3:
            out.append(value)
            continue
        pixels = np.frombuffer(value, np.uint8).reshape(-1, count)
        order = [2, 1, 0, 3][:count]
        out.append(pixels[:, order].tobytes())
    return pa.array(out, pa.binary())


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files decoded by Spark's image source as packed images; unreadable ones have only ``error``."""
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    valid = F.col("image.width") > 0
    return images.select(
        F.col("image.origin").alias("path"),
        F.when(valid, F.col("image.width").cast("bigint")).alias("w"),
        F.when(valid, F.col("image.height").cast("bigint")).alias("h"),
        F.when(valid, F.col("image.nChannels")).alias("channels"),
        F.when(valid, _swap_channels("image.data", "image.nChannels")).alias("data"),
        F.when(~valid, F.lit("Failed to decode image")).alias("error"),
    )


def decoded_in_turn(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of the decoded files of each folder right below ``path``, one folder after the other, as one written table.

    The image source keeps all files it is asked for in the driver, and a task for every few of them. Of a large set dealt
    into folders (``in_folders``) the driver holds one folder at a time. Rows of ``work`` must not need files of other folders.
    """
    table = f"{shared_folder(spark)}/table"
    tasks = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    kept = spark.conf.get(_LISTINGS)
    spark.conf.set(_LISTINGS, "0")  # each folder is listed once, so no listing is worth keeping
    try:
        for own in folder.folders_of(path):
            work(decoded_files(spark, own).coalesce(tasks)).write.mode("append").parquet(table)
    finally:
        spark.conf.set(_LISTINGS, kept)
    return spark.read.parquet(table)


def _unfilter(kinds: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Undoes the row filters none, sub and up; (h, w, step) bytes."""
    h, w, step = given.shape
    out = np.zeros((h + 1, w, step), np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = np.cumsum(given[y], axis=0, dtype=np.uint8) if kind == 1 else given[y]
        out[y + 1] = line + out[y] if kind == 2 else line
    return out[1:]


def _unfilter_all(pictures: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Undoes all five row filters of pictures (kinds, bytes) with equally many channels.

    The average and Paeth filters need the left, upper and corner neighbours, so the pictures are undone along
    anti-diagonals, each as one array operation over all rows it crosses in all pictures. What a smaller picture has
    beyond its edges is never read by its own pixels.
    """
    n, step = len(pictures), pictures[0][1].shape[2]
    h, w = (max(given.shape[axis] for _, given in pictures) for axis in (0, 1))
    # Row y is shifted right by y, so that an anti-diagonal is one row of the shifted pictures.
    shifted = np.zeros((h + w - 1, n, h, step), np.int16)
    filters = np.zeros((n, h, 1), np.uint8)
    places = []
    for i, (kinds, given) in enumerate(pictures):
        y, x = np.arange(given.shape[0])[:, None], np.arange(given.shape[1])[None, :]
        places.append((y + x, y))
        shifted[y + x, i, y] = given
        filters[i, : len(kinds), 0] = kinds
    out = np.zeros((h + w + 1, n, h + 1, step), np.int16)
    use = [(filters == kind).astype(np.int16) for kind in (1, 2, 3, 4)]
    for d in range(h + w - 1):
        low, high = max(0, d - w + 1), min(h, d + 1)
        left, up, corner = out[d + 1, :, low + 1 : high + 1], out[d + 1, :, low:high], out[d, :, low:high]
        to_left, to_up = np.abs(up - corner), np.abs(left - corner)
        to_corner = np.abs(left + up - 2 * corner)
        paeth = np.where(to_up <= to_corner, up, corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, paeth)
        sub, above, mean, third = (mask[:, low:high] for mask in use)
        guess = left * sub + up * above + ((left + up) >> 1) * mean + paeth * third
        out[d + 2, :, low + 1 : high + 1] = (shifted[d, :, low:high] + guess) & 255
    return [out[d + 2, i, y + 1].astype(np.uint8) for i, (d, y) in enumerate(places)]


@dataclass
class _Png:
    """A PNG whose bytes are unpacked, but whose row filters are not undone."""

    w: int
    h: int
    color: int
    palette: np.ndarray | None
    alpha: np.ndarray | None
    kinds: np.ndarray
    given: np.ndarray

    def packed(self, pixels: np.ndarray) -> dict:
        w, h, palette, alpha = self.w, self.h, self.palette, self.alpha
        pixels = pixels.reshape(h * w, -1) if pixels.size else pixels.reshape(h * w, self.given.shape[2])
        if self.color == 3:
            rgb = palette[pixels[:, 0]]
            if alpha is None:
                pixels = rgb
            else:
                full = np.full(len(palette), 255, np.uint8)
                full[: len(alpha)] = alpha
                pixels = np.concatenate([rgb, full[pixels]], axis=1)
        elif self.color in (0, 4):
            grey = np.repeat(pixels[:, :1], 3, axis=1)
            pixels = grey if self.color == 0 else np.concatenate([grey, pixels[:, 1:]], axis=1)
        return {"w": w, "h": h, "channels": pixels.shape[1], "data": pixels.tobytes(), "error": None}


def _read_png(payload: bytes | None) -> _Png:
    if payload is None:
        raise ValueError("no payload")
    if payload[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("unsupported image format")
    at, parts, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(payload):
        size, kind = int.from_bytes(payload[at : at + 4], "big"), payload[at + 4 : at + 8]
        body = payload[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or len(head) < 13:
        raise ValueError("missing image header")
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, color, interlace = head[8], head[9], head[12]
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or step is None or interlace:
        raise ValueError("unsupported PNG form")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w * step + 1)
    return _Png(w, h, color, palette, alpha, rows[:, 0], rows[:, 1:].reshape(h, w, step))


def _decoded(payloads: list[bytes | None]) -> list[dict]:
    """Packed images of PNG bytes in their order; pictures with the costly row filters are undone together."""
    out: list[dict] = [{} for _ in payloads]
    costly: dict[int, list[tuple[int, _Png]]] = {}

    def attempt(place: int, work) -> None:
        try:
            out[place] = work()
        except Exception as failure:
            out[place] = {"error": f"Failed to decode image: {failure}"}

    def read(place: int, value: bytes | None) -> dict:
        png = _read_png(value)
        if png.kinds.max(initial=0) <= 2:
            return png.packed(_unfilter(png.kinds, png.given))
        costly.setdefault(png.given.shape[2], []).append((place, png))
        return {}

    for place, value in enumerate(payloads):
        attempt(place, lambda: read(place, value))
    for found in costly.values():
        # Pictures of similar size share a group, whose padded size is bounded unless one picture is larger.
        found.sort(key=lambda one: max(one[1].given.shape))
        while found:
            first = found[-1][1].given.shape
            fits = max(1, _GROUP_BYTES // (max(first) ** 2 * first[2]))
            group, found[-fits:] = found[-fits:], []
            try:
                pixels = _unfilter_all([(png.kinds, png.given) for _, png in group])
            except Exception as failure:
                for place, _ in group:
                    out[place] = {"error": f"Failed to decode image: {failure}"}
                continue
            for (place, png), own in zip(group, pixels):
                attempt(place, lambda: png.packed(own))
    return out


@once_per_row
@F.arrow_udf(PACKED)
def decode_png(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Packed image of PNG bytes; anything unreadable becomes a row with its error text.

    Pictures leave in small batches, because they are much larger than their payloads.
    """
    kind = pa.struct(
        [("w", pa.int64()), ("h", pa.int64()), ("channels", pa.int32()), ("data", pa.binary()), ("error", pa.string())]
    )
    for payload in payloads:
        for first in range(0, len(payload), _IMAGES_PER_BATCH):
            yield pa.array(_decoded(payload.slice(first, _IMAGES_PER_BATCH).to_pylist()), kind)


def explode_pixels(packed: DataFrame, key: str = "image_id") -> DataFrame:
    """Long pixel table (key, w, h, idx, x, y, r, g, b, a) in raster order; opaque without alpha.

    Runs inside the tasks that hold the images; rows leave in batches of bounded size.
    """
    kind = packed.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, w bigint, h bigint, idx bigint, x bigint, y bigint, r int, g int, b int, a int"

    def batch_of(parts: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        """Rows of several (key, w, h, first position, (n, 4) colours) pieces."""
        lengths = [len(colors) for *_, colors in parts]
        keys = pa.array([part[0] for part in parts], key_type)
        w, h, first = (np.repeat([part[i] for part in parts], lengths) for i in (1, 2, 3))
        starts = np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
        idx = first + np.arange(sum(lengths)) - starts
        colors = np.concatenate([part[4] for part in parts]).astype("i4")
        columns = [keys.take(pa.array(np.repeat(np.arange(len(parts)), lengths)))]
        columns += [pa.array(v) for v in (w, h, idx, idx % w, idx // w)]
        columns += [pa.array(np.ascontiguousarray(colors[:, i])) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "w", "h", "idx", "x", "y", "r", "g", "b", "a"])

    def four_channels(data: bytes, channels: int) -> np.ndarray:
        pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
        if channels == 4:
            return pixels
        colors = pixels[:, :3] if channels == 3 else np.repeat(pixels[:, :1], 3, axis=1)
        return np.concatenate([colors, np.full((len(colors), 1), 255, np.uint8)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            key_type = batch.schema.field(key).type
            for image in batch.to_pylist():
                if image["data"] is None:
                    continue
                colors = four_channels(image["data"], image["channels"])
                for first in range(0, len(colors), _PIXELS_PER_BATCH):
                    piece = colors[first : first + _PIXELS_PER_BATCH]
                    parts.append((image[key], image["w"], image["h"], first, piece))
                    held += len(piece)
                    if held >= _PIXELS_PER_BATCH:
                        yield batch_of(parts, key_type)
                        parts, held = [], 0
            if parts:
                yield batch_of(parts, key_type)

    return packed.select(key, "w", "h", "channels", "data").mapInArrow(run, schema)
