import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspark.functions import color as fn
from embedspark.operators import color as ops
from embedspark.operators import color_qa as qa

PIXELS = "image_id int, idx bigint, r int, g int, b int, a int"


def pixel_rows(image, colors, alpha=255):
    return [(image, i, *color, alpha) for i, color in enumerate(colors)]


def hsv32(r, g, b):
    """The single-precision rule with numpy floats."""
    f = np.float32
    r, g, b = f(r) / f(255), f(g) / f(255), f(b) / f(255)
    high, low = max(r, g, b), min(r, g, b)
    delta = f(high - low)
    s = f(delta / high) if high > 0 else f(0)
    if delta < f(1e-6):
        h = f(0)
    elif abs(high - r) < f(1e-6):
        h = f(np.mod(f(f(g - b) / delta), f(6)) / f(6))
    elif abs(high - g) < f(1e-6):
        h = f(f(f(f(b - r) / delta) + f(2)) / f(6))
    else:
        h = f(f(f(f(r - g) / delta) + f(4)) / f(6))
    return h, s, high


def key_of(h, s, v, kind):
    ten = kind(10)
    return int(kind(h * ten)) * 1000 + int(kind(s * ten)) * 10 + int(kind(v * ten))


def test_hex(spark):
    rows = [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    got = [tuple(r) for r in df.select(
        fn.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")),
        fn.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"), half_even=True),
    ).collect()]
    assert [g[0] for g in got] == ["#ffffff", "#000000", "#ff0000", "#808080"]
    # 127.5 rounds up in both rules, 126.5 only in the first.
    half = spark.createDataFrame([(126.5 / 255,)], "x double")
    away, even = half.select(
        fn.rgb_to_hex(F.col("x"), F.col("x"), F.col("x")),
        fn.rgb_to_hex(F.col("x"), F.col("x"), F.col("x"), half_even=True),
    ).first()
    assert (away, even) == ("#7f7f7f", "#7e7e7e")


@pytest.mark.parametrize("twin", [False, True])
def test_cluster_keys_on_a_color_grid(spark, twin):
    levels = list(range(0, 256, 15))
    colors = [(r, g, b) for r in levels for g in levels for b in levels]
    df = spark.createDataFrame(pixel_rows(1, colors), PIXELS)
    got = {(r["r"], r["g"], r["b"]): r["key"] for r in ops.with_cluster_key(df, twin=twin).collect()}
    for color in colors:
        if twin:
            want = key_of(*colorsys.rgb_to_hsv(*[c / 255 for c in color]), float)
        else:
            want = key_of(*hsv32(*color), np.float32)
        assert got[color] == want, color


def test_known_hues(spark):
    df = spark.createDataFrame(pixel_rows(1, [(255, 0, 0), (0, 255, 0), (128, 128, 128), (0, 0, 0)]), PIXELS)
    red, green, grey, black = ops.with_hsv(df).orderBy("idx").collect()
    assert (red["hsv_h"], red["hsv_s"], red["hsv_v"]) == (0.0, 1.0, 1.0)
    assert green["hsv_h"] == pytest.approx(1 / 3)
    assert (grey["hsv_h"], grey["hsv_s"]) == (0.0, 0.0) and grey["hsv_v"] == pytest.approx(128 / 255)
    assert (black["hsv_s"], black["hsv_v"]) == (0.0, 0.0)


def test_key_collision_is_kept(spark):
    # White (s 0, v 10) and a dark saturated-by-a-tenth red share key 10.
    df = spark.createDataFrame(pixel_rows(1, [(255, 255, 255), (20, 17, 17)]), PIXELS)
    assert {r["key"] for r in ops.with_cluster_key(df).collect()} == {10}


def statistics(spark, rows, sizes, **options):
    images = spark.createDataFrame(sizes, "image_id int, w bigint, h bigint")
    df = spark.createDataFrame(rows, PIXELS)
    return {r["image_id"]: r for r in ops.image_statistics(images, df, **options).collect()}


def test_means_and_null_colors(spark):
    rows = pixel_rows(1, [(255, 0, 0), (0, 255, 0), (0, 0, 255)]) + pixel_rows(2, [(1, 2, 3)], 127)
    rows += pixel_rows(3, [(10, 20, 30)], 128)
    sizes = [(1, 3, 1), (2, 1, 1), (3, 1, 1), (4, 1000, 10)]
    got = statistics(spark, rows, sizes, method=F.lit("arithmetic"))
    assert got[1]["color_data"]["avg_color"]["rgb"] == pytest.approx([1 / 3] * 3)
    assert got[2]["color_data"] is None and got[2]["valid_pixels"] == 0
    assert got[3]["color_data"]["dominant_color"]["hex"] == "#0a141e"
    assert got[4]["color_data"] is None
    assert (got[4]["processed_w"], got[4]["processed_h"]) == (512, 5)
    geometric = statistics(spark, rows, sizes)[1]["color_data"]["avg_color"]
    assert geometric["rgb"] == pytest.approx([math.exp(2 * math.log(1e-8) / 3)] * 3, rel=1e-5)
    twin = statistics(spark, rows, sizes, twin=True)[1]["color_data"]["avg_color"]
    value = math.exp((2 * math.log(1e-8) + math.log(255)) / 3) / 255
    assert twin["rgb"] == pytest.approx([value] * 3, rel=1e-5)


def test_dominant_ties(spark):
    # Two clusters of equal size: blue comes first, red has the lower key.
    df = spark.createDataFrame(pixel_rows(1, [(0, 0, 255), (255, 0, 0)] * 2), PIXELS)
    histogram = ops.cluster_histogram(df)
    lowest = ops.unpacked(F.col("dominant_pixel"))
    row = ops.dominant_clusters(histogram).select(*[lowest[c].alias(c) for c in "rgb"]).first()
    assert tuple(row) == (255, 0, 0)
    row = ops.dominant_clusters(histogram, first_seen=True).select(*[lowest[c].alias(c) for c in "rgb"]).first()
    assert tuple(row) == (0, 0, 255)


def test_histogram_uses_hash_aggregation(spark):
    df = spark.createDataFrame(pixel_rows(1, [(1, 2, 3)]), PIXELS)
    plan = ops.image_totals(ops.cluster_histogram(df))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_thumbnail_edges(spark):
    sizes = [(512, 512), (513, 10), (10, 5130), (100, 100), (1000, 1)]
    df = spark.createDataFrame(sizes, "w bigint, h bigint")
    got = [tuple(r) for r in df.select(*ops.thumbnail_size(F.col("w"), F.col("h"))).collect()]
    assert got == [(512, 512), (512, 9), (0, 512), (100, 100), (512, 0)]


def test_top_clusters_need_five(spark):
    many = pixel_rows(1, [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0), (0, 0, 0)])
    df = spark.createDataFrame(many + pixel_rows(2, [(255, 0, 0)]), PIXELS)
    rows = ops.top_clusters(ops.cluster_histogram(df)).orderBy("image_id", "rank").collect()
    assert [r["image_id"] for r in rows] == [1] * 5 and rows[0]["cnt"] == 2
    rows = ops.top_clusters(ops.cluster_histogram(df), require_full=False).collect()
    assert len(rows) == 6


def test_hex_comparison(spark):
    cases = [
        ("#ff0000", "#fe0000", 1 / 255, 1),
        ("FF0000", "#ff0000", 0.0, 0),
        ("#12345", "#123456", 1.0, 6),
        ("#gg0000", "#000000", 1.0, 2),
        (None, "#000000", 1.0, 6),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    for r in df.select(
        "i",
        F.coalesce(fn.hex_distance(F.col("a"), F.col("b")), F.lit(1.0)).alias("d"),
        F.coalesce(fn.hex_digit_difference(F.col("a"), F.col("b")), F.lit(6)).alias("n"),
    ).collect():
        assert (r["d"], r["n"]) == pytest.approx(cases[r["i"]][2:])


def test_sortable_scientific(spark):
    values = [0.0, 0.00392, 1.0, 9.9996, 123456.0, 1e-7, 1 / 255]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fn.sortable_scientific(F.col("v"))).collect()]
    assert got == [
        "0.000E+000", "3.920E-003", "1.000E+000", "1.000E+001", "1.235E+005", "1.000E-007", "3.922E-003",
    ]


COLOR = "color_data struct<avg_color:struct<rgb:array<double>,hex:string>,dominant_color:struct<rgb:array<double>,hex:string>>"


def test_run_comparison(spark):
    def data(avg, dom):
        return (([avg] * 3, "#000000"), ([dom] * 3, "#000000"))

    left = [(1, data(0.5, 0.5)), (2, data(0.5, 0.5)), (3, data(0.5, 0.5)), (4, None), (5, None)]
    right = [(1, data(0.525, 0.54)), (2, data(0.54, 0.5)), (3, data(0.5, 0.56)), (4, data(0.1, 0.1)), (6, data(0.1, 0.1))]
    schema = f"k int, {COLOR}"
    rows = qa.compare_runs(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]
    ).collect()
    got = {r["k"]: (r["passed"], r["avg_match"], r["dom_match"], r["side_error"]) for r in rows}
    assert got[1] == (True, True, True, None)
    assert got[2][:2] == (False, False)
    assert got[3][:3] == (True, True, False)
    assert got[4][0] is False and "left has no colors" in got[4][3]
    assert got[5][0] is True
    assert got[6][0] is False


def test_ranking_shares_ranks(spark):
    rows = [(1, 0.5, 3), (2, 0.5, 3), (3, 0.5, 4), (4, 0.1, 6)]
    df = spark.createDataFrame(rows, "k int, hex_diff double, hex_digits int")
    got = [(r["k"], r["rank"]) for r in qa.ranked_by_distance(df, "k").collect()]
    assert got == [(3, 1), (1, 2), (2, 2), (4, 4)]


def test_packed_histogram_equals_the_long_form(spark):
    rng = np.random.default_rng(8)
    rows, long = [], []
    for image, channels in ((1, 4), (2, 3), (3, 1), (4, 4)):
        pixels = rng.integers(0, 256, (23 * 17, channels)).astype(np.uint8)
        if image == 4:
            pixels[:, 3] = 0
        rows.append((image, 23, 17, channels, pixels.tobytes()))
        colors = pixels[:, :3] if channels >= 3 else np.repeat(pixels, 3, axis=1)
        alpha = pixels[:, 3] if channels == 4 else np.full(len(pixels), 255)
        long += [(image, i, *map(int, color), int(a)) for i, (color, a) in enumerate(zip(colors, alpha))]
    packed = spark.createDataFrame(rows, "image_id int, w bigint, h bigint, channels int, data binary")

    def table(df):
        return {(r["image_id"], r["key"]): r for r in df.collect()}

    got = table(ops.packed_histogram(packed))
    want = table(ops.cluster_histogram(spark.createDataFrame(long, PIXELS)))
    assert set(got) == set(want) and not any(image == 4 for image, _ in got)
    for key, row in want.items():
        assert got[key]["cnt"] == row["cnt"] and got[key]["first_pixel"] == row["first_pixel"]
        for name in row.asDict():
            if name.startswith(("sum_", "log_")):
                assert got[key][name] == pytest.approx(row[name], rel=1e-12)


def test_key_ranks_never_broadcasts_the_histogram(spark):
    rows = pixel_rows(1, [(255, 0, 0)] * 2 + [(0, 0, 255)]) + pixel_rows(2, [(0, 255, 0)])
    histogram = ops.cluster_histogram(spark.createDataFrame(rows, PIXELS))
    asked = ops.with_cluster_key(spark.createDataFrame(pixel_rows(1, [(0, 0, 255)]), PIXELS)).select("image_id", "key")
    found = ops.key_ranks(histogram, asked)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["cnt"], r["rank"], r["exists"]) for r in found.collect()] == [(1, 2, True)]


def test_compared_runs_never_broadcast_their_totals(spark, sf_dir):
    from embedspark.plans import color_qa

    for made in (color_qa.compared, color_qa.results_of_both):
        plan = made(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" in plan


def test_spread_gives_more_tasks_to_more_rows(spark):
    from embedspark.plans.fixtures import spread

    few, many = spark.range(10), spark.range(16384 * 20)
    assert spread(few, "id").rdd.getNumPartitions() < spread(many, "id").rdd.getNumPartitions() == 20
    assert spread(few, "id", rows=16384 * 30).rdd.getNumPartitions() == 30
