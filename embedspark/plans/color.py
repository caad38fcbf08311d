"""Registered colour queries on the pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.functions import color as fn
from embedspark.operators import color as ops
from embedspark.plans.binary_fixtures import packed_images
from embedspark.plans.color_sql import CHANNELS_SQL, CLUSTERS_SQL, hex_sql
from embedspark.plans.fixtures import IMAGES_SQL, PIXELS_SQL, images, pixels, table
from embedspark.plans.registry import query, r6, s6

# Sizes of up to some thousands of pixels a side, derived from part.
SIZES_SQL = """sizes AS (SELECT p_partkey AS image_id, (1 + (p_partkey * 37 + p_size) % 2000)::BIGINT AS w,
  (1 + (p_partkey * 101 + p_size * 7) % 1500)::BIGINT AS h FROM part)"""


def sizes(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("image_id"),
        (1 + (key * 37 + size) % 2000).cast("bigint").alias("w"),
        (1 + (key * 101 + size * 7) % 1500).cast("bigint").alias("h"),
    )


@query(
    "c1_thumbnail_target",
    f"""WITH {SIZES_SQL}
SELECT image_id, w, h, CASE WHEN greatest(w, h) <= 512 THEN w WHEN w > h THEN 512 ELSE w * 512 // h END AS new_w,
  CASE WHEN greatest(w, h) <= 512 THEN h WHEN w > h THEN h * 512 // w ELSE 512 END AS new_h FROM sizes""",
)
def thumbnail_target(spark, sf_dir):
    new_w, new_h = ops.thumbnail_size(F.col("w"), F.col("h"))
    return sizes(spark, sf_dir).withColumns({"new_w": new_w, "new_h": new_h})


@query(
    "c3_valid_pixels",
    f"""WITH {CHANNELS_SQL}
SELECT image_id, count(*) AS valid, {s6("sum(rf::DOUBLE)", 4)} AS r, {s6("sum(gf::DOUBLE)", 4)} AS g,
  {s6("sum(bf::DOUBLE)", 4)} AS b, sum(idx)::BIGINT AS positions FROM valid GROUP BY image_id""",
)
def valid_pixels_query(spark, sf_dir):
    """The alpha filter, shown as sums per image."""
    kept = ops.valid_pixels(pixels(spark, sf_dir))
    return kept.groupBy("image_id").agg(
        F.count("*").alias("valid"),
        *[r6(F.sum(fn.unit_channel(F.col(c)).cast("double")), 4).alias(c) for c in ops.CHANNELS],
        F.sum("idx").alias("positions"),
    )


def means_query(spark, sf_dir, method):
    totals = ops.image_totals(ops.cluster_histogram(pixels(spark, sf_dir)))
    means = ops.channel_means(method)
    return totals.select("image_id", *[r6(means[c]).alias(c) for c in ops.CHANNELS])


@query(
    "c4_arithmetic_mean",
    f"""WITH {CLUSTERS_SQL} SELECT image_id, {s6("ar")} AS r, {s6("ag")} AS g, {s6("ab")} AS b FROM means""",
)
def arithmetic_mean(spark, sf_dir):
    return means_query(spark, sf_dir, "arithmetic")


@query(
    "c5_geometric_mean",
    f"""WITH {CLUSTERS_SQL} SELECT image_id, {s6("gr")} AS r, {s6("gg")} AS g, {s6("gb")} AS b FROM means""",
)
def geometric_mean(spark, sf_dir):
    return means_query(spark, sf_dir, "geometric")


@query(
    "c5_geometric_mean_byte_scale",
    f"""WITH {PIXELS_SQL}
SELECT image_id, {", ".join(f"{s6(f'exp(avg(ln(greatest({c}::DOUBLE, 1e-8)))) / 255')} AS {c}" for c in "rgb")}
FROM pixels WHERE a >= 128 GROUP BY image_id""",
)
def geometric_mean_byte_scale(spark, sf_dir):
    """The other clamping scale: small values are raised on 0..255, not on 0..1."""
    histogram = ops.cluster_histogram(pixels(spark, sf_dir), twin=True, eps_scale=255.0)
    means = ops.channel_means("geometric", 255.0)
    return ops.image_totals(histogram).select(
        "image_id", *[r6(means[c]).alias(c) for c in ops.CHANNELS]
    )


METHODS_SQL = """CASE image_id % 4 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'geometric' END"""


def requested_method():
    """Requested averaging method: half of the images leave it to the default."""
    return F.when(F.col("image_id") % 4 == 0, "arithmetic").when(F.col("image_id") % 4 == 1, "geometric")


@query(
    "c6_method_dispatch",
    f"""WITH {CLUSTERS_SQL}, m AS (SELECT *, coalesce({METHODS_SQL}, 'geometric') AS method FROM means)
SELECT image_id, method, {s6("CASE WHEN method = 'geometric' THEN gr ELSE ar END")} AS r,
  {s6("CASE WHEN method = 'geometric' THEN gg ELSE ag END")} AS g,
  {s6("CASE WHEN method = 'geometric' THEN gb ELSE ab END")} AS b FROM m""",
)
def method_dispatch(spark, sf_dir):
    totals = ops.image_totals(ops.cluster_histogram(pixels(spark, sf_dir))).withColumn(
        "method", F.coalesce(requested_method(), F.lit("geometric"))
    )
    means = ops.channel_means(F.col("method"))
    return totals.select("image_id", "method", *[r6(means[c]).alias(c) for c in ops.CHANNELS])


@query(
    "c7_rgb_to_hex",
    f"""SELECT vec_id, {hex_sql("least(1, abs(embedding[1]))", "least(1, abs(embedding[2]))", "((vec_id % 256)::DOUBLE / 255)::FLOAT")} AS hex,
  {hex_sql("((vec_id % 255)::DOUBLE + 0.5) / 255", "0.5", "1")} AS half FROM embeddings""",
)
def rgb_to_hex_query(spark, sf_dir):
    vec = F.col("vec_id")
    one = F.lit(1.0).cast("float")
    a, b = (F.least(one, F.abs(F.element_at("embedding", i))) for i in (1, 2))
    exact = ((vec % 256).cast("double") / 255).cast("float")
    half = ((vec % 255).cast("double") + 0.5) / 255
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        fn.rgb_to_hex(a, b, exact).alias("hex"),
        fn.rgb_to_hex(half, F.lit(0.5), F.lit(1.0)).alias("half"),
    )


@query(
    "c8_rgb_to_hsv",
    f"""WITH {CHANNELS_SQL}
SELECT image_id, {", ".join(f"{s6(f'sum(hsv_{c}::DOUBLE)', 3)} AS {c}_total, {s6(f'max(hsv_{c}::DOUBLE)')} AS {c}_max" for c in "hsv")}
FROM hsv GROUP BY image_id""",
)
def rgb_to_hsv_query(spark, sf_dir):
    rows = ops.with_hsv(ops.valid_pixels(pixels(spark, sf_dir)))
    parts = []
    for c in "hsv":
        parts.append(r6(F.sum(F.col(f"hsv_{c}").cast("double")), 3).alias(f"{c}_total"))
        parts.append(r6(F.max(F.col(f"hsv_{c}").cast("double"))).alias(f"{c}_max"))
    return rows.groupBy("image_id").agg(*parts)


HISTOGRAM_SQL = f"""WITH {CLUSTERS_SQL}
SELECT c.image_id, c.key::INT AS key, c.cnt, c.first_idx, p.r, p.g, p.b FROM clusters c
JOIN pixels p ON p.image_id = c.image_id AND p.idx = c.first_idx"""


@query("c9_c11_cluster_histogram", HISTOGRAM_SQL)
def cluster_histogram_query(spark, sf_dir):
    """Every cluster of every image with its count and first pixel."""
    rows = ops.cluster_histogram(pixels(spark, sf_dir))
    parts = ops.unpacked(F.col("first_pixel"))
    return rows.select(
        "image_id",
        "key",
        "cnt",
        parts["idx"].alias("first_idx"),
        *[parts[c].alias(c) for c in ops.CHANNELS],
    )


@query("c10_packed_histogram", HISTOGRAM_SQL)
def packed_histogram_query(spark, sf_dir):
    """The same clusters straight from picture bytes, without pixel rows."""
    rows = ops.packed_histogram(packed_images(spark, sf_dir))
    parts = ops.unpacked(F.col("first_pixel"))
    return rows.select(
        "image_id",
        "key",
        "cnt",
        parts["idx"].alias("first_idx"),
        *[parts[c].alias(c) for c in ops.CHANNELS],
    )


@query(
    "c12_dominant_color",
    f"""WITH {CLUSTERS_SQL}
SELECT image_id, key::INT AS key, cnt, idx, {hex_sql("rf", "gf", "bf")} AS hex FROM best""",
)
def dominant_color_query(spark, sf_dir):
    rows = ops.dominant_clusters(ops.cluster_histogram(pixels(spark, sf_dir)))
    parts = ops.unpacked(F.col("dominant_pixel"))
    return rows.select(
        "image_id",
        F.col("dominant_key").alias("key"),
        F.col("dominant_count").alias("cnt"),
        parts["idx"].alias("idx"),
        ops.dominant_color()["hex"].alias("hex"),
    )


@query(
    "c12_dominant_first_seen",
    f"""WITH {CLUSTERS_SQL}
SELECT image_id, key::INT AS key, cnt FROM clusters
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first_idx) = 1""",
)
def dominant_first_seen(spark, sf_dir):
    rows = ops.dominant_clusters(ops.cluster_histogram(pixels(spark, sf_dir)), first_seen=True)
    return rows.select(
        "image_id", F.col("dominant_key").alias("key"), F.col("dominant_count").alias("cnt")
    )


@query(
    "c13_top_clusters",
    f"""WITH {CLUSTERS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, key) AS rank,
    count(*) OVER (PARTITION BY image_id) AS found FROM clusters)
SELECT image_id, rank::INT AS rank, key::INT AS key, cnt FROM ranked WHERE rank <= 5 AND found >= 5""",
)
def top_clusters_query(spark, sf_dir):
    rows = ops.top_clusters(ops.cluster_histogram(pixels(spark, sf_dir)))
    return rows.select("image_id", "rank", "key", "cnt")


@query(
    "c14_c16_image_color_stats",
    f"""WITH {CLUSTERS_SQL}, j AS (
  SELECT i.image_id, i.w, i.h, coalesce({METHODS_SQL.replace("image_id", "i.image_id")}, 'geometric') AS method, m.*
    EXCLUDE (image_id), b.rf, b.gf, b.bf
  FROM images i LEFT JOIN means m ON m.image_id = i.image_id LEFT JOIN best b ON b.image_id = i.image_id),
c AS (SELECT *, CASE WHEN method = 'geometric' THEN gr ELSE ar END AS r, CASE WHEN method = 'geometric' THEN gg ELSE ag END AS g,
  CASE WHEN method = 'geometric' THEN gb ELSE ab END AS b FROM j)
SELECT image_id, w, h, w AS processed_w, h AS processed_h, method, coalesce(valid_pixels, 0) AS valid_pixels,
  {s6("r::FLOAT", 5)} AS avg_r, {s6("g::FLOAT", 5)} AS avg_g, {s6("b::FLOAT", 5)} AS avg_b, {hex_sql("r", "g", "b")} AS avg_hex,
  {s6("rf", 5)} AS dominant_r, {hex_sql("rf", "gf", "bf")} AS dominant_hex, rf IS NULL AS no_colors FROM c""",
)
def image_color_stats(spark, sf_dir):
    """The whole statistics row: sizes, method, valid pixels, average and dominant colour."""
    rows = ops.image_statistics(images(spark, sf_dir), pixels(spark, sf_dir), requested_method())
    average, dominant = F.col("color_data.avg_color"), F.col("color_data.dominant_color")
    return rows.select(
        "image_id",
        "w",
        "h",
        "processed_w",
        "processed_h",
        "method",
        "valid_pixels",
        *[
            r6(average["rgb"][i], 5).alias(f"avg_{c}")
            for i, c in enumerate(ops.CHANNELS)
        ],
        average["hex"].alias("avg_hex"),
        r6(dominant["rgb"][0], 5).alias("dominant_r"),
        dominant["hex"].alias("dominant_hex"),
        F.col("color_data").isNull().alias("no_colors"),
    )


@query(
    "c20_cluster_rank",
    f"""WITH {CLUSTERS_SQL}, given AS (SELECT image_id, key FROM keyed WHERE idx = 40
  UNION ALL SELECT image_id, 9999 FROM images WHERE image_id % 3 = 0),
ranked AS (SELECT image_id, key, cnt, rank() OVER (PARTITION BY image_id ORDER BY cnt DESC) AS rank FROM clusters)
SELECT g.image_id, g.key::INT AS key, r.cnt, r.rank::INT AS rank, r.cnt IS NOT NULL AS "exists"
FROM given g LEFT JOIN ranked r USING (image_id, key)""",
)
def cluster_rank(spark, sf_dir):
    """Rank of the cluster of pixel 40 of every image, and of a key no image has."""
    source = pixels(spark, sf_dir)
    histogram = ops.cluster_histogram(source)
    given = ops.with_cluster_key(ops.valid_pixels(source).where("idx = 40")).select("image_id", "key")
    absent = images(spark, sf_dir).where("image_id % 3 = 0").select("image_id", F.lit(9999).alias("key"))
    return ops.key_ranks(histogram, given.unionByName(absent)).select(
        "image_id", "key", "cnt", "rank", "exists"
    )


@query(
    "c21_nearest_pixel",
    f"""WITH {CHANNELS_SQL}, scored AS (
  SELECT *, sqrt(pow(r / 255e0 - 0.5, 2) + pow(g / 255e0 - 0.25, 2) + pow(b / 255e0 - (image_id % 10) / 10e0, 2)) AS d FROM keyed)
SELECT image_id, {s6("d")} AS distance, idx, key::INT AS key FROM scored
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(d, 12), idx) = 1""",
)
def nearest_pixel(spark, sf_dir):
    targets = images(spark, sf_dir).select(
        "image_id",
        F.lit(0.5).alias("target_r"),
        F.lit(0.25).alias("target_g"),
        ((F.col("image_id") % 10) / 10.0).alias("target_b"),
    )
    rows = ops.nearest_pixels(pixels(spark, sf_dir), targets)
    return rows.select("image_id", r6("distance").alias("distance"), "idx", "key")
