"""Image colour statistics on long pixel tables (image_id, idx, r, g, b, a).

The pixel table shrinks at once to one row per image and colour cluster; an image has about 1,100
possible clusters, so everything after the first aggregate is small. Grouping buffers hold plain
numbers only (positions and colours are packed into one BIGINT), which keeps Spark on hash
aggregation with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.constants import ALPHA_THRESHOLD, GEOMETRIC_EPS, HUE_EPS, THUMBNAIL_SIZE
from embedspark.functions import color as fn
from embedspark.functions.resample import resize, to_bytes

CHANNELS = ("r", "g", "b")
_IMAGES_PER_BATCH = 64


def thumbnail_size(w: Column, h: Column, limit: int = THUMBNAIL_SIZE) -> tuple[Column, Column]:
    """Size used for colour work: the long side shrinks to the limit, the other by integer floor."""
    large = F.greatest(w, h) > limit
    wide = w > h
    new_w = F.when(large & wide, F.lit(limit)).when(large, F.floor(w * limit / h)).otherwise(w)
    new_h = F.when(large & wide, F.floor(h * limit / w)).when(large, F.lit(limit)).otherwise(h)
    return new_w.cast("bigint"), new_h.cast("bigint")


def valid_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels with alpha of at least 128."""
    return pixels.where(F.col("a") >= ALPHA_THRESHOLD)


def with_hsv(pixels: DataFrame, kind: str = "float") -> DataFrame:
    """Adds hsv_h, hsv_s and hsv_v of the 8-bit channels, every step rounded to ``kind``."""
    r, g, b = (fn.unit_channel(F.col(c), kind) for c in CHANNELS)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    staged = pixels.withColumns({"_r": r, "_g": g, "_b": b, "_high": high, "_delta": high - low})
    named = {c: F.col(f"_{c}") for c in (*CHANNELS, "high", "delta")}
    return staged.withColumns(
        {
            "hsv_h": fn.hue(named["r"], named["g"], named["b"], named["high"], named["delta"], kind),
            "hsv_s": fn.saturation(named["high"], named["delta"], kind),
            "hsv_v": named["high"],
        }
    ).drop("_r", "_g", "_b", "_high", "_delta")


def with_twin_hsv(pixels: DataFrame) -> DataFrame:
    """Double-precision hue in the form of Python's colorsys, used by the comparison runs."""
    r, g, b = (fn.unit_channel(F.col(c), "double") for c in CHANNELS)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    staged = pixels.withColumns({"_r": r, "_g": g, "_b": b, "_high": high, "_delta": high - low})
    high, delta = F.col("_high"), F.col("_delta")

    def gap(channel: str) -> Column:
        return (high - F.col(f"_{channel}")) / delta

    turn = (
        F.when(F.col("_r") == high, gap("b") - gap("g"))
        .when(F.col("_g") == high, 2.0 + gap("r") - gap("b"))
        .otherwise(4.0 + gap("g") - gap("r"))
    )
    grey = delta == 0.0
    return staged.withColumns(
        {
            "hsv_h": F.when(grey, F.lit(0.0)).otherwise(F.pmod(turn / 6.0, F.lit(1.0))),
            "hsv_s": F.when(grey, F.lit(0.0)).otherwise(delta / high),
            "hsv_v": high,
        }
    ).drop("_r", "_g", "_b", "_high", "_delta")


def with_cluster_key(pixels: DataFrame, kind: str = "float", twin: bool = False) -> DataFrame:
    """Adds the cluster ``key``; for double precision ``twin`` selects the colorsys hue."""
    hsv = with_twin_hsv(pixels) if twin else with_hsv(pixels, kind)
    kind = "double" if twin else kind
    return hsv.withColumn("key", fn.cluster_key(F.col("hsv_h"), F.col("hsv_s"), F.col("hsv_v"), kind))


def _packed() -> Column:
    """Position and colour in one number: its minimum is the first pixel in raster order."""
    return (F.col("idx") * 256 + F.col("r")) * 65536 + F.col("g") * 256 + F.col("b")


def unpacked(packed: Column) -> dict[str, Column]:
    return {
        "idx": F.shiftright(packed, 24),
        "r": F.shiftright(packed, 16) % 256,
        "g": F.shiftright(packed, 8) % 256,
        "b": packed % 256,
    }


def cluster_histogram(
    pixels: DataFrame, twin: bool = False, eps_scale: float = 1.0, image: str = "image_id"
) -> DataFrame:
    """One row per image and cluster: count, first pixel, and channel sums for both means.

    ``eps_scale`` is the scale on which the geometric mean clamps small values: 1 clamps on 0..1,
    255 clamps the 8-bit values themselves.
    """
    kind = "double" if twin else "float"
    keyed = with_cluster_key(valid_pixels(pixels), twin=twin)
    sums = []
    for c in CHANNELS:
        unit = fn.unit_channel(F.col(c), kind).cast("double")
        clamped = F.ln(F.greatest(unit * eps_scale, F.lit(GEOMETRIC_EPS)))
        sums += [F.sum(unit).alias(f"sum_{c}"), F.sum(clamped).alias(f"log_{c}")]
    return keyed.groupBy(image, "key").agg(
        F.count("*").alias("cnt"), F.min(_packed()).alias("first_pixel"), *sums
    )


def _hsv_single(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hue, saturation and value of 0..1 channels, all steps in single precision."""
    single = np.float32
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    delta = high - low
    grey = delta < single(HUE_EPS)
    safe = np.where(grey, single(1), delta)
    red = np.mod((g - b) / safe, single(6)) / single(6)
    green = ((b - r) / safe + single(2)) / single(6)
    blue = ((r - g) / safe + single(4)) / single(6)
    near_red, near_green = np.abs(high - r) < single(HUE_EPS), np.abs(high - g) < single(HUE_EPS)
    hue = np.where(grey, single(0), np.where(near_red, red, np.where(near_green, green, blue)))
    saturation = np.where(high > 0, delta / np.where(high > 0, high, single(1)), single(0))
    return hue, saturation, high


def packed_histogram(images: DataFrame, image: str = "image_id", limit: int | None = None) -> DataFrame:
    """``cluster_histogram`` straight from packed images (w, h, channels, data).

    The pixels never become rows: a task turns each picture into its few hundred clusters. Use it
    for picture bytes; the long form is for pixels that already are rows. Pictures with a side above
    ``limit`` are shrunk to their thumbnails first, in the same pass.
    """
    kind = images.schema[image].dataType.simpleString()
    sums = ", ".join(f"sum_{c} double, log_{c} double" for c in CHANNELS)
    schema = f"{image} {kind}, key int, cnt bigint, first_pixel bigint, {sums}"
    ten = np.float32(10)
    shape = ["w", "h", "channels", "data"]

    def shrunk(w: int, h: int, channels: int, data: bytes) -> bytes:
        if limit is None or max(w, h) <= limit:
            return data
        goal = [max(1, side * limit // max(w, h)) for side in (w, h)]
        pixels = np.frombuffer(data, np.uint8).reshape(h, w, channels)
        return to_bytes(resize(pixels, *goal, "lanczos")).tobytes()

    def clusters(data: bytes, channels: int) -> list[np.ndarray]:
        pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
        idx = np.arange(len(pixels))
        if channels == 4:
            idx = np.flatnonzero(pixels[:, 3] >= ALPHA_THRESHOLD)
        bytes_of = pixels[idx, :3].astype("i8") if channels >= 3 else np.repeat(pixels[idx, :1], 3, axis=1).astype("i8")
        unit = (bytes_of / 255.0).astype("f4")
        h, s, v = (
            (part * ten).astype("i4") for part in _hsv_single(unit[:, 0], unit[:, 1], unit[:, 2])
        )
        keys, first, member, counts = np.unique(
            h * 1000 + s * 10 + v, return_index=True, return_inverse=True, return_counts=True
        )
        r, g, b = bytes_of[first].T if len(first) else np.zeros((3, 0), "i8")
        out = [keys.astype("i4"), counts, ((idx[first] * 256 + r) * 256 + g) * 256 + b]
        for c in range(3):
            values = unit[:, c].astype("f8")
            for weights in (values, np.log(np.maximum(values, GEOMETRIC_EPS))):
                out.append(np.bincount(member, weights=weights, minlength=len(keys)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Clusters of a picture may have many times its bytes, so few pictures are held at a time.
            for start in range(0, batch.num_rows, _IMAGES_PER_BATCH):
                keys, parts = [], []
                for row in batch.slice(start, _IMAGES_PER_BATCH).to_pylist():
                    if row["data"] is not None:
                        parts.append(clusters(shrunk(**{c: row[c] for c in shape}), row["channels"]))
                        keys += [row[image]] * len(parts[-1][0])
                if keys:
                    columns = [np.concatenate(part) for part in zip(*parts)]
                    arrays = [pa.array(keys, batch.schema.field(image).type), *map(pa.array, columns)]
                    names = [image, "key", "cnt", "first_pixel"]
                    names += [f"{part}_{c}" for c in CHANNELS for part in ("sum", "log")]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return images.select(image, *shape).mapInArrow(run, schema)


def dominant_clusters(histogram: DataFrame, first_seen: bool = False, image: str = "image_id") -> DataFrame:
    """Most frequent cluster per image with its first pixel; ties go to the lowest key.

    ``first_seen`` gives ties to the cluster seen first instead. Both orders are single numbers:
    a key is below 2**15 and an image has fewer than 2**31 pixels.
    """
    if first_seen:
        order = F.col("cnt") * F.lit(2**31) - F.shiftright("first_pixel", 24)
    else:
        order = F.col("cnt") * F.lit(2**15) - F.col("key")
    return histogram.groupBy(image).agg(
        F.max_by("first_pixel", order).alias("dominant_pixel"),
        F.max_by("key", order).alias("dominant_key"),
        F.max("cnt").alias("dominant_count"),
    )


def channel_means(method: Column | str, eps_scale: float = 1.0) -> dict[str, Column]:
    """Average per channel from summed clusters; anything but ``geometric`` is arithmetic."""
    chosen = F.lit(method) if isinstance(method, str) else method
    out = {}
    for c in CHANNELS:
        arithmetic = F.col(f"sum_{c}") / F.col("valid")
        geometric = F.exp(F.col(f"log_{c}") / F.col("valid")) / eps_scale
        out[c] = F.when(chosen == "geometric", geometric).otherwise(arithmetic)
    return out


def image_totals(histogram: DataFrame, first_seen: bool = False, image: str = "image_id") -> DataFrame:
    """One row per image: valid pixel count, channel sums, dominant pixel."""
    if first_seen:
        order = F.col("cnt") * F.lit(2**31) - F.shiftright("first_pixel", 24)
    else:
        order = F.col("cnt") * F.lit(2**15) - F.col("key")
    return histogram.groupBy(image).agg(
        F.sum("cnt").alias("valid"),
        *[F.sum(f"{part}_{c}").alias(f"{part}_{c}") for part in ("sum", "log") for c in CHANNELS],
        F.max_by("first_pixel", order).alias("dominant_pixel"),
    )


def color_info(r: Column, g: Column, b: Column, half_even: bool = False) -> Column:
    """STRUCT<rgb ARRAY<FLOAT>, hex STRING>."""
    return F.struct(
        F.array(r.cast("float"), g.cast("float"), b.cast("float")).alias("rgb"),
        fn.rgb_to_hex(r, g, b, half_even).alias("hex"),
    )


def average_color(method: Column | str, eps_scale: float = 1.0, twin: bool = False) -> Column:
    means = channel_means(method, eps_scale)
    if not twin:
        means = {c: value.cast("float") for c, value in means.items()}
    return color_info(*[means[c] for c in CHANNELS], half_even=twin)


def dominant_color(twin: bool = False) -> Column:
    kind = "double" if twin else "float"
    parts = unpacked(F.col("dominant_pixel"))
    return color_info(*[fn.unit_channel(parts[c], kind) for c in CHANNELS], half_even=twin)


def image_statistics(
    images: DataFrame,
    pixels: DataFrame,
    method: Column | None = None,
    default_method: str = "geometric",
    twin: bool = False,
) -> DataFrame:
    """Colour data of every image; images without valid pixels keep their row with NULL colours.

    ``pixels`` are those of the thumbnails; ``packed_statistics`` shrinks larger pictures itself.
    ``twin`` applies the comparison rules: double precision, clamping on the 8-bit scale, halves to
    even and ties to the cluster seen first.
    """
    scale = 255.0 if twin else 1.0
    return assemble_statistics(
        images, cluster_histogram(pixels, twin, scale), method, default_method, twin
    )


def assemble_statistics(
    images: DataFrame,
    histogram: DataFrame,
    method: Column | None = None,
    default_method: str = "geometric",
    twin: bool = False,
    limit: int = THUMBNAIL_SIZE,
) -> DataFrame:
    """``image_statistics`` from clusters of the thumbnails, however they were made; other image columns are kept."""
    scale = 255.0 if twin else 1.0
    totals = image_totals(histogram, first_seen=twin)
    chosen = F.coalesce(method if method is not None else F.lit(None).cast("string"), F.lit(default_method))
    joined = images.withColumn("method", chosen).join(totals.hint("merge"), "image_id", "left")
    present = F.col("valid").isNotNull()
    colors = F.struct(
        average_color(F.col("method"), scale, twin).alias("avg_color"),
        dominant_color(twin).alias("dominant_color"),
    )
    new_w, new_h = thumbnail_size(F.col("w"), F.col("h"), limit)
    kept = [c for c in images.columns if c not in ("channels", "data")]
    return joined.select(
        *kept,
        new_w.alias("processed_w"),
        new_h.alias("processed_h"),
        "method",
        F.coalesce("valid", F.lit(0)).alias("valid_pixels"),
        F.when(present, colors).alias("color_data"),
    )


def packed_statistics(
    images: DataFrame,
    method: Column | None = None,
    default_method: str = "geometric",
    limit: int = THUMBNAIL_SIZE,
) -> DataFrame:
    """Colour data of packed images, computed on their thumbnails."""
    return assemble_statistics(images, packed_histogram(images, limit=limit), method, default_method, limit=limit)


def top_clusters(histogram: DataFrame, n: int = 5, require_full: bool = True, image: str = "image_id") -> DataFrame:
    """The n largest clusters per image; with ``require_full`` only where at least n exist."""
    order = Window.partitionBy(image).orderBy(F.desc("cnt"), "key")
    ranked = histogram.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if not require_full:
        return ranked
    found = F.count("*").over(Window.partitionBy(image))
    return ranked.withColumn("_found", found).where(F.col("_found") == n).drop("_found")


def key_ranks(histogram: DataFrame, colors: DataFrame, image: str = "image_id") -> DataFrame:
    """For given (image, key): whether the cluster exists, its count and 1-based count rank.

    Clusters are many more than the images whose size Spark sees, so the join is a merge join, not a broadcast.
    """
    order = Window.partitionBy(image).orderBy(F.desc("cnt"))
    ranked = histogram.select(image, "key", "cnt", F.rank().over(order).alias("rank"))
    return colors.join(ranked.hint("merge"), [image, "key"], "left").withColumn("exists", F.col("cnt").isNotNull())


_PLACE, _COLOR = 10**20, 10**8  # decimal places of a packed pixel: distance, position (12 digits), colour (8 digits)


def nearest_pixels(pixels: DataFrame, colors: DataFrame, image: str = "image_id") -> DataFrame:
    """Valid pixel closest to a given colour (target_r, target_g, target_b on 0..1) per image.

    Distances are compared at 12 digits: colours equally far away tie, and the first pixel wins. Distance, position
    and colour of a pixel are packed into one number, whose minimum is combined in the task: a row per image and task is
    all that moves, however many colours a picture has.
    """
    targets = [f"target_{c}" for c in CHANNELS]

    def distance() -> Column:
        gaps = [fn.unit_channel(F.col(c), "double") - F.col(f"target_{c}") for c in CHANNELS]
        return F.sqrt(sum((gap * gap for gap in gaps), F.lit(0.0)))

    steps = F.round(F.round(distance(), 12) * 1e12).cast("decimal(13,0)")
    color = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("decimal(8,0)")
    packed = steps * F.lit(Decimal(_PLACE)) + F.col("idx").cast("decimal(12,0)") * F.lit(Decimal(_COLOR)) + color
    near = valid_pixels(pixels).join(colors, image)
    best = near.groupBy(image).agg(F.min(packed).alias("_packed"), *[F.min(t).alias(t) for t in targets])
    rest = best.withColumn("_rest", F.col("_packed") % F.lit(Decimal(_PLACE)))
    rgb = (F.col("_rest") % F.lit(Decimal(_COLOR))).cast("bigint")
    found = rest.select(
        image,
        F.expr(f"_rest div {_COLOR}BD").alias("idx"),
        *targets,
        F.shiftright(rgb, 16).alias("r"),
        (F.shiftright(rgb, 8) % 256).alias("g"),
        (rgb % 256).alias("b"),
    )
    return with_cluster_key(found.withColumn("distance", distance())).select(image, "distance", "idx", "key")
