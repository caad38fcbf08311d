import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embedspark.constants import IMAGE_MEAN, IMAGE_STD
from embedspark.functions.resample import resize, to_bytes, weights
from embedspark.operators import color, image as ops
from embedspark.plans.binary_fixtures import metadata_bytes, picture, png_bytes
from embedspark.sources import exif, images
from embedspark.sources.images import decode_png, decoded_files, explode_pixels, image_files
from embedspark.sources.payloads import cache_key, latest_by_key, to_fetch

PACKED = "image_id int, w bigint, h bigint, channels int, data binary"


def kernel_loop(kind, x):
    x = abs(x)
    if kind == "bicubic":
        if x < 1:
            return 1.5 * x**3 - 2.5 * x**2 + 1
        return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0
    if kind == "lanczos":
        if x == 0:
            return 1.0
        return np.sin(np.pi * x) * np.sin(np.pi * x / 3) * 3 / (np.pi * x) ** 2 if x < 3 else 0.0
    return max(1 - x, 0.0)


@pytest.mark.parametrize("kind,support", [("bicubic", 2), ("lanczos", 3), ("bilinear", 1)])
@pytest.mark.parametrize("size,goal", [(31, 7), (8, 20), (5, 5), (3, 1), (1, 4)])
def test_axis_weights_match_a_loop(kind, support, size, goal):
    got = weights(size, goal, kind)
    scale = max(size / goal, 1.0)
    for o in range(goal):
        centre = (o + 0.5) * size / goal
        raw = np.array([kernel_loop(kind, (t + 0.5 - centre) / scale) for t in range(size)])
        assert got[o] == pytest.approx(raw / raw.sum(), abs=1e-12)
        assert np.count_nonzero(np.abs(got[o]) > 1e-12) <= 2 * support * scale + 2


def test_resize_keeps_constant_pictures_and_rounds_half_up():
    flat = np.full((9, 13, 3), 77, np.uint8)
    assert (to_bytes(resize(flat, 20, 5, "lanczos")) == 77).all()
    assert to_bytes(np.array([-3.0, 0.49, 0.5, 254.5, 300.0])).tolist() == [0, 0, 1, 255, 255]


def test_documented_sizes(spark):
    rows = [(640, 480), (1920, 1080), (480, 640), (100, 100)]
    df = spark.createDataFrame(rows, "w bigint, h bigint").select(*ops.resize_target(F.col("w"), F.col("h")))
    assert [tuple(r) for r in df.collect()] == [(298, 224), (398, 224), (224, 298), (224, 224)]


def test_documented_normalisation(spark):
    black = np.zeros((224, 224, 3), np.uint8)
    tensor = ops.preprocessed(black, ops.CLIP)
    assert tensor[:, 0, 0] == pytest.approx([-1.79, -1.75, -1.48], abs=0.01)
    tensor = ops.preprocessed(black + 255, ops.CLIP)
    assert tensor[:, 0, 0] == pytest.approx([1.93, 2.07, 2.14], abs=0.02)
    df = spark.range(3).select(ops.normalized(F.lit(255), F.col("id").cast("int")).alias("v"))
    want = [(1 - m) / s for m, s in zip(IMAGE_MEAN, IMAGE_STD)]
    assert [r["v"] for r in df.collect()] == pytest.approx(want, rel=1e-6)


def plain_tensor(pixels):
    """The server steps in order, written out."""
    rgb = pixels[:, :, :3]
    h, w = rgb.shape[:2]
    new_w, new_h = (224, h * 224 // w) if w < h else (w * 224 // h, 224)
    big = to_bytes(resize(rgb, new_w, new_h, "bicubic"))
    left, top = (new_w - 224) // 2, (new_h - 224) // 2
    out = np.zeros((3, 224, 224), np.float32)
    for c in range(3):
        part = big[top : top + 224, left : left + 224, c].astype(np.float32) / np.float32(255)
        out[c] = (part - np.float32(IMAGE_MEAN[c])) / np.float32(IMAGE_STD[c])
    return out


def test_embedding_equals_a_plain_loop(spark):
    shapes = {1: (12, 20), 2: (20, 12), 3: (16, 16), 4: (9, 31), 5: (8, 8)}
    rows = [(i, w, h, 4, picture(i, w, h).tobytes()) for i, (w, h) in shapes.items()]
    df = spark.createDataFrame(rows + [(9, None, None, None, None)], PACKED).coalesce(1)
    encoder = ops.ProjectionImageEncoder(32)
    got = {r["image_id"]: r["embedding"] for r in ops.embed_images(df, encoder, batch=2, dim=10).collect()}
    assert got.pop(9) is None
    for i, (w, h) in shapes.items():
        tensor = plain_tensor(picture(i, w, h))
        cells = tensor.astype("f8").reshape(3, 14, 16, 14, 16).mean(axis=(2, 4)).reshape(-1)
        vector = cells @ encoder.matrix
        want = (vector / np.linalg.norm(vector))[:10]
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_batching_does_not_change_vectors(spark):
    rows = [(i, 10 + i, 12, 4, picture(i, 10 + i, 12).tobytes()) for i in range(8)]
    df = spark.createDataFrame(rows, PACKED)
    one = {r["image_id"]: r["embedding"] for r in ops.embed_images(df, batch=1).collect()}
    eight = {r["image_id"]: r["embedding"] for r in ops.embed_images(df.coalesce(1), batch=8).collect()}
    for i in one:
        assert np.linalg.norm(eight[i]) == pytest.approx(1.0, abs=1e-4)
        assert one[i] == pytest.approx(eight[i], abs=1e-4)
    assert any(np.abs(np.array(one[0]) - one[i]).sum() > 0.01 for i in range(1, 8))


def test_squashed_configuration():
    pixels = picture(3, 20, 10)
    tensor = ops.preprocessed(pixels, ops.SQUASHED)
    assert tensor.shape == (3, 224, 224)
    want = to_bytes(resize(pixels[:, :, :3], 224, 224, "bilinear")).astype("f4") / 255
    want = (want - np.float32((0.485, 0.456, 0.406))) / np.float32((0.229, 0.224, 0.225))
    assert tensor == pytest.approx(want.transpose(2, 0, 1), abs=1e-5)
    config = ops.config_from({"size": {"height": 10, "width": 12}, "keep_aspect": False, "resample": 0, "do_center_crop": False})
    assert ops.preprocessed(pixels, config).shape == (3, 10, 12)


def test_thumbnails_only_shrink(spark):
    rows = [(1, 30, 10, 3, picture(1, 30, 10)[:, :, :3].tobytes()), (2, 8, 8, 4, picture(2, 8, 8).tobytes())]
    df = spark.createDataFrame(rows, PACKED)
    got = {r["image_id"]: r for r in ops.thumbnails(df, 12).collect()}
    assert (got[1]["w"], got[1]["h"]) == (12, 4)
    want = to_bytes(resize(picture(1, 30, 10)[:, :, :3], 12, 4, "lanczos"))
    assert bytes(got[1]["data"]) == want.tobytes()
    assert bytes(got[2]["data"]) == rows[1][4]


def test_statistics_come_from_the_thumbnail(spark):
    rows = [(1, 600, 100, 4, picture(1, 600, 100).tobytes()), (2, 8, 8, 4, picture(2, 8, 8).tobytes()), (3, None, None, 3, None)]
    df = spark.createDataFrame(rows, PACKED)
    got = {r["image_id"]: r for r in color.packed_statistics(df, default_method="arithmetic").collect()}
    small = to_bytes(resize(picture(1, 600, 100), 512, 85, "lanczos"))
    seen = small[small[:, :, 3] >= 128][:, :3] / 255
    assert (got[1]["w"], got[1]["h"], got[1]["processed_w"], got[1]["processed_h"]) == (600, 100, 512, 85)
    assert got[1]["valid_pixels"] == len(seen) < 512 * 85
    assert list(got[1]["color_data"]["avg_color"]["rgb"]) == pytest.approx(seen.mean(0).tolist(), abs=1e-6)
    assert got[2]["valid_pixels"] == (picture(2, 8, 8)[:, :, 3] >= 128).sum()
    assert got[3]["valid_pixels"] == 0 and got[3]["color_data"] is None


def test_class_vectors_shapes():
    out = np.arange(24.0).reshape(2, 3, 4)
    assert ops.class_vectors(out, 2, 4).tolist() == [[0, 1, 2, 3], [12, 13, 14, 15]]
    assert ops.class_vectors(out[:, 0], 2, 4).tolist() == [[0, 1, 2, 3], [12, 13, 14, 15]]
    with pytest.raises(ValueError, match="Unexpected vision model output shape"):
        ops.class_vectors(out, 3, 4)


# --------------------------------------------------------------------------------------------------
# Bytes


@pytest.mark.parametrize("channels", [3, 4])
def test_png_reader_undoes_every_filter(spark, channels):
    pixels = picture(77, 19, 11)[:, :, :channels]
    rows = [(f, png_bytes(pixels, f)) for f in range(5)]
    df = spark.createDataFrame(rows, "f int, payload binary").select("f", decode_png("payload").alias("p"))
    for r in df.collect():
        p = r["p"]
        assert p["error"] is None and (p["w"], p["h"], p["channels"]) == (19, 11, channels)
        assert bytes(p["data"]) == pixels.tobytes()


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def small_png(color, rows, extra=b"", depth=8):
    head = struct.pack(">IIBBBBB", 2, 1, depth, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_color_kinds_and_errors(spark):
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    cases = [
        (small_png(0, b"\0\x07\x09"), bytes([7, 7, 7, 9, 9, 9]), 3),
        (small_png(4, b"\0\x07\xff\x09\x80"), bytes([7, 7, 7, 255, 9, 9, 9, 128]), 4),
        (small_png(3, b"\0\x01\x00", palette), bytes([4, 5, 6, 1, 2, 3]), 3),
        (small_png(3, b"\0\x01\x00", palette + chunk(b"tRNS", b"\x11")), bytes([4, 5, 6, 255, 1, 2, 3, 17]), 4),
        (small_png(2, b"\0" * 13, depth=16), None, None),
        (b"GIF89a", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload binary")
    for r in df.select("i", decode_png("payload").alias("p")).collect():
        _, data, channels = cases[r["i"]]
        if data is None:
            assert r["p"]["error"].startswith("Failed to decode image")
        else:
            assert bytes(r["p"]["data"]) == data and r["p"]["channels"] == channels


def test_files_through_the_image_source(spark, tmp_path):
    for i, channels in ((1, 3), (2, 4)):
        (tmp_path / f"{i}.png").write_bytes(png_bytes(picture(i, 9, 7)[:, :, :channels], 0))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in decoded_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"1.png", "2.png", "broken.png"}
    assert got["broken.png"]["data"] is None and got["broken.png"]["error"] == "Failed to decode image"
    for i, channels in ((1, 3), (2, 4)):
        assert bytes(got[f"{i}.png"]["data"]) == picture(i, 9, 7)[:, :, :channels].tobytes()
        assert got[f"{i}.png"]["error"] is None
    files = image_files(spark, str(tmp_path), limit=100)
    found = {r["path"].rsplit("/", 1)[1]: (r["status"]["code"], r["payload"]) for r in files.collect()}
    assert found == {"1.png": (400, None), "2.png": (400, None), "broken.png": (200, b"nothing")}
    assert "LessThanOrEqual(length,100)" in files._jdf.queryExecution().executedPlan().toString()


def test_explode_pixels_of_all_channel_counts(spark):
    rows = [(1, 2, 1, 1, bytes([5, 6])), (2, 1, 2, 3, bytes([1, 2, 3, 4, 5, 6])), (3, 1, 1, 4, bytes([1, 2, 3, 4])), (4, None, None, None, None)]
    got = {(r["image_id"], r["idx"]): (r["x"], r["y"], r["r"], r["g"], r["b"], r["a"]) for r in explode_pixels(spark.createDataFrame(rows, PACKED)).collect()}
    assert got == {
        (1, 0): (0, 0, 5, 5, 5, 255), (1, 1): (1, 0, 6, 6, 6, 255),
        (2, 0): (0, 0, 1, 2, 3, 255), (2, 1): (0, 1, 4, 5, 6, 255), (3, 0): (0, 0, 1, 2, 3, 4),
    }


def test_cache(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "x")], "id int, seq int, body string")
    keyed = df.withColumn("key", cache_key(F.col("id"), F.lit(150), F.lit(300)))
    last = {r["key"]: r["body"] for r in latest_by_key(keyed, "key", ["seq"]).collect()}
    assert last == {"image_1_150x300": "new", "image_2_150x300": "x"}
    assert [r["key"] for r in to_fetch(keyed, keyed.where("id = 2"), "key").collect()] == ["image_1_150x300"]


# --------------------------------------------------------------------------------------------------
# Metadata


def read(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload binary")
    return [r["exif"] for r in exif.with_exif(df).orderBy("i").collect()]


def test_metadata_shapes_and_last_tag_wins(spark):
    fields, none, broken = read(spark, metadata_bytes(20, 7, "Canon", "EOS"), metadata_bytes(7, 7, "a", "b"), metadata_bytes(22, 1, "a", "b"))
    assert none == {} and broken == {}
    assert fields["Make"] == '"Dup"' and fields["Model"] == '["EOS","Canon"]'
    assert fields["Orientation"] == "8" and fields["BitsPerSample"] == "[8,8,20]"
    assert fields["ExposureTime"] == repr(1 / 7) and fields["ExposureBiasValue"] == "-9.0"
    assert fields["GPSLatitude"] == "[20.0,7.0,0.0]"


def test_metadata_of_little_endian_files_and_png(spark):
    entry = struct.pack("<HHI", 271, 2, 4) + b"Abc\0"
    number = struct.pack("<HHIHH", 0x9999, 3, 1, 5, 0)
    block = b"II*\0" + struct.pack("<IH", 8, 2) + entry + number + struct.pack("<I", 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"eXIf", block)
    tiff_fields, png_fields, empty = read(spark, block, png, None)
    assert tiff_fields == png_fields == {"Make": '"Abc"', "Tag(0x9999)": "5"}
    assert empty == {}


def test_json_text_is_escaped(spark):
    df = spark.createDataFrame([("ascii", ['a"b\\c\n'])], "type string, values array<string>")
    row = df.select(exif.shaped_value(F.struct(F.lit("t").alias("tag"), "type", "values"))).first()
    assert row[0] == '"a\\"b\\\\c\\n"'


def test_batch_query_equals_a_plain_loop(spark, sf_dir):
    from embedspark.plans import catalog

    sizes = {
        r["p_partkey"]: (8 + r["p_size"] % 24, 8 + r["p_partkey"] % 24)
        for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    }
    encoder = ops.ProjectionImageEncoder()
    rows = catalog.QUERIES["i10_image_batch_embed"](spark, sf_dir).collect()
    assert {r["image_id"] for r in rows} == set(sizes)
    for r in rows:
        if r["batch_size"] > 4:
            assert r["code"] == 400 and r["norm"] is None
            continue
        tensor = plain_tensor(picture(r["image_id"], *sizes[r["image_id"]]))
        vector = encoder.run(tensor[None])[0, 0]
        assert r["code"] == 200 and r["width"] == 64
        assert r["norm"] == pytest.approx(np.linalg.norm(vector[:64]) / np.linalg.norm(vector), abs=2e-4)


def test_crop_larger_than_the_picture_is_filled_up():
    pixels = np.arange(5 * 3 * 3, dtype=np.uint8).reshape(5, 3, 3)
    config = ops.Preprocess(do_resize=False, do_center_crop=True, crop_size=(8, 2), do_rescale=False, do_normalize=False)
    tensor = ops.preprocessed(pixels, config)
    assert tensor.shape == (3, 8, 2)
    # Two rows above and one below; the columns are cut as usual.
    assert not tensor[:, :2].any() and not tensor[:, 7:].any()
    assert np.array_equal(tensor[:, 2:7], pixels[:, 0:2].transpose(2, 0, 1))


def test_channels_pass_on_without_conversion(spark):
    plain = dict(do_resize=False, do_center_crop=False, do_rescale=False)
    rows = [(1, 2, 1, 4, bytes(range(8))), (2, 2, 1, 3, bytes(range(6))), (3, 1, 1, 1, bytes([9])), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "image_id long, w long, h long, channels int, data binary")

    def tensors(**more):
        found = df.select("image_id", ops.image_tensor(ops.Preprocess(**plain, **more)).alias("t")).collect()
        return {r["image_id"]: r["t"] for r in found}

    kept = tensors(do_convert_rgb=False, do_normalize=False)
    assert kept == {1: [0, 4, 1, 5, 2, 6, 3, 7], 2: [0, 3, 1, 4, 2, 5], 3: [9], 4: None}
    rgb = tensors(do_convert_rgb=True, do_normalize=False)
    assert rgb == {1: [0, 4, 1, 5, 2, 6], 2: [0, 3, 1, 4, 2, 5], 3: [9, 9, 9], 4: None}
    known = tensors(do_convert_rgb=False, do_normalize=True)
    assert known[1] is None and known[3] is None and len(known[2]) == 6


def test_measured_tensors_equal_the_tensors_and_stay_in_the_task(spark):
    rows = [(i, 8 + i % 5, 9 + i % 3, 4, picture(i, 8 + i % 5, 9 + i % 3).tobytes()) for i in range(70)] + [(99, 2, 2, 4, None)]
    df = spark.createDataFrame(rows, PACKED).coalesce(1)
    whole = {r["image_id"]: r["t"] for r in df.select("image_id", ops.image_tensor(ops.SQUASHED).alias("t")).collect()}
    found = df.select("image_id", ops.image_tensor(ops.SQUASHED, measured=True).alias("t")).collect()
    assert whole[99] is None and len(found) == 71
    for r in found:
        tensor = whole[r["image_id"]]
        assert r["t"] is None if tensor is None else tuple(r["t"]) == (len(tensor), min(tensor), max(tensor))


def test_pictures_of_all_sizes_and_filters_are_undone_together():
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 256, (1 + 7 * i % 31, 1 + 5 * i % 23, 3 + i % 2), dtype=np.uint8) for i in range(60)]
    files = [png_bytes(p, i % 5) for i, p in enumerate(pictures)]
    calls = []

    def counted(group):
        calls.append(len(group))
        return undone(group)

    undone, images._unfilter_all = images._unfilter_all, counted
    try:
        found = images._decoded([*files, None, files[4][:-30], b"none"])
    finally:
        images._unfilter_all = undone
    for p, got in zip(pictures, found):
        assert (got["h"], got["w"], got["channels"]) == p.shape and got["data"] == p.tobytes() and got["error"] is None
    assert all(got["error"].startswith("Failed to decode image") for got in found[60:])
    assert sum(calls) == 24 and len(calls) <= 4


def test_clusters_of_few_pictures_are_held_at_a_time(spark):
    class Caught:
        schema = spark.createDataFrame([], PACKED).schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = color.packed_histogram(Caught())
    rows = [{"image_id": i, "w": 8, "h": 9, "channels": 4, "data": picture(i, 8, 9).tobytes()} for i in range(1, 150)]
    found = list(run(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(found) == 3 and max(len(set(b.column(0).to_pylist())) for b in found) <= 64
    assert {k for b in found for k in b.column(0).to_pylist()} == set(range(1, 150)) - {50, 100}


def test_folders_are_decoded_in_turn(spark, tmp_path, monkeypatch):
    for i in range(30):
        path = tmp_path / "in" / str(i % 4) / f"{i}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png_bytes(picture(i, 9 + i, 12), i % 5) if i != 13 else b"no picture")
    asked, whole = [], images.decoded_files
    monkeypatch.setattr(images, "decoded_files", lambda s, path: asked.append(path) or whole(s, path))
    listings = spark.conf.get(images._LISTINGS)
    found = images.decoded_in_turn(spark, str(tmp_path / "in"), lambda df: df)
    rows = {r["path"].rpartition("/")[2]: r for r in found.collect()}
    assert asked == [str(tmp_path / "in" / str(k)) for k in range(4)]
    assert len(rows) == 30 and rows.pop("13.png")["error"] and all(r["error"] is None for r in rows.values())
    for i in set(range(30)) - {13}:
        row = rows[f"{i}.png"]
        assert (row["w"], row["h"]) == (9 + i, 12) and bytes(row["data"]) == picture(i, 9 + i, 12).tobytes()
    assert spark.conf.get(images._LISTINGS) == listings
