"""Tables derived from the given ones, stated once for Spark and once as SQL text.

They stand in for inputs the given tables do not contain (images, model variants, request logs).
All are computed inside each query from whole tables, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embedspark.functions.text import prefixed

# --------------------------------------------------------------------------------------------------
# Given tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table for work that is heavy per row.

    A table of one small file arrives as one partition and would keep all but one core idle; it is
    spread first. Tables that already have a partition per core are left as they are.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task lets grow.
_ROWS_PER_TASK = 16384


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Small rows spread by key before they grow (to pixels, to pictures).

    The number of partitions is given, because adaptive execution would otherwise see how small the
    rows are, merge them into one partition and leave the growing to one task. It grows with the number of ``rows``
    (counted here if not given), so that what a task holds does not.
    """
    spark = df.sparkSession
    needed = -(-(df.count() if rows is None else rows) // _ROWS_PER_TASK)
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), needed)
    return df.repartition(count, key)


# --------------------------------------------------------------------------------------------------
# Images and pixels from part: small pictures with a fixed colour formula

IMAGES_SQL = """images AS (
  SELECT p_partkey AS image_id, (8 + p_size % 24)::BIGINT AS w, (8 + p_partkey % 24)::BIGINT AS h
  FROM part)"""

PIXELS_SQL = f"""{IMAGES_SQL},
pixel_index AS (SELECT image_id, w, h, unnest(range(w * h)) AS idx FROM images),
pixels AS (
  SELECT image_id, w, h, idx, idx % w AS x, idx // w AS y,
    (20 + 4 * (idx % w // 3) + 37 * image_id) % 256 AS r,
    (90 + 2 * (idx // w) + 5 * (image_id % 17)) % 256 AS g,
    ((idx % w) * (idx // w) // 6 + 11 * image_id) % 256 AS b,
    CASE WHEN image_id % 50 = 0 THEN 0
         ELSE (7 * (idx % w) + 13 * (idx // w) + image_id) % 256 END AS a
  FROM pixel_index)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (8 + F.pmod(F.col("p_size"), F.lit(24))).cast("bigint").alias("w"),
        (8 + F.pmod(F.col("p_partkey"), F.lit(24))).cast("bigint").alias("h"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel table in raster order.

    The rows are spread by image before they grow to pixels: three small columns move instead of
    all pixels, and later groupings by image find their rows in place.
    """
    x, y, key = F.col("x"), F.col("y"), F.col("image_id")
    return (
        spread(images(spark, sf_dir), "image_id")
        .withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") * F.col("h") - 1)))
        .withColumns({"x": F.col("idx") % F.col("w"), "y": F.floor(F.expr("idx div w"))})
        .withColumns(
            {
                "r": (20 + 4 * F.floor(x / 3) + 37 * key) % 256,
                "g": (90 + 2 * y + 5 * (key % 17)) % 256,
                "b": (F.floor(x * y / 6) + 11 * key) % 256,
                "a": F.when(key % 50 == 0, F.lit(0)).otherwise((7 * x + 13 * y + key) % 256),
            }
        )
    )


# --------------------------------------------------------------------------------------------------
# Payload strings from documents

CONTENT_SQL = """content AS (
  SELECT doc_id, text,
    CASE doc_id % 5
      WHEN 0 THEN 'data:text/plain;base64,' || to_base64(encode(text))
      WHEN 1 THEN to_base64(encode(text))
      WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'http://' ELSE 'https://' END
                  || 'files.example.com/' || doc_id
      WHEN 3 THEN 'data:nocomma'
      ELSE '!!!not base64' END AS content
  FROM documents)"""


def base64_text(text: Column) -> Column:
    """Base64 without the line breaks Spark puts after every 76 characters."""
    return F.regexp_replace(F.base64(text.cast("binary")), "[\\r\\n]", "")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    kind = doc % 5
    host = F.when(doc % 2 == 0, F.lit("http://")).otherwise(F.lit("https://"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(kind == 0, F.concat(F.lit("data:text/plain;base64,"), base64_text(text)))
        .when(kind == 1, base64_text(text))
        .when(kind == 2, F.concat(host, F.lit("files.example.com/"), doc.cast("string")))
        .when(kind == 3, F.lit("data:nocomma"))
        .otherwise(F.lit("!!!not base64"))
        .alias("content"),
    )


# --------------------------------------------------------------------------------------------------
# Model variants of the embeddings: exact, rounded, quantized alone and quantized in a batch of four

VARIANTS_SQL = """exact AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
    list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS own_peak FROM embeddings),
scaled AS (
  SELECT *, own_peak / 127.0::DOUBLE AS own_step,
    max(own_peak) OVER (PARTITION BY vec_id // 4) / 127.0::DOUBLE AS batch_step FROM exact),
variants AS (
  SELECT vec_id, label, v AS fp32,
    list_transform(v, lambda x: floor(x * 1000 + 0.5) / 1000) AS fp16,
    list_transform(v, lambda x: floor(x / own_step + 0.5) * own_step) AS int8,
    list_transform(v, lambda x: floor(x / batch_step + 0.5) * batch_step) AS int8_batched
  FROM scaled)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector with its forms as columns; the batch peak is a small combined aggregate."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.expr("vec_id div 4").alias("batch_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("fp32"),
    )
    peaked = vectors.withColumn("own_peak", F.array_max(F.transform("fp32", lambda x: F.abs(x))))
    batch_peaks = peaked.groupBy("batch_id").agg(F.max("own_peak").alias("batch_peak"))

    def quantized(step: Column) -> Column:
        return F.transform("fp32", lambda x: F.floor(x / step + 0.5).cast("double") * step)

    return peaked.join(batch_peaks, "batch_id").select(
        "vec_id",
        "label",
        "fp32",
        F.transform("fp32", lambda x: F.floor(x * 1000 + 0.5).cast("double") / 1000).alias("fp16"),
        quantized(F.col("own_peak") / 127.0).alias("int8"),
        quantized(F.col("batch_peak") / 127.0).alias("int8_batched"),
    )


# --------------------------------------------------------------------------------------------------
# Request log from events

REQUEST_LOG_SQL = """request_log AS (
  SELECT event_id AS request_id, event_type AS endpoint, value AS latency_ms, ts AS started_at,
    (json_extract_string(props, '$.k')::BIGINT % 10) <> 0 AS success,
    (1 << (event_id % 8)::INT)::BIGINT AS batch_size,
    3 + event_id % 50 AS tokens,
    CASE user_id % 3 WHEN 0 THEN 'fp32' WHEN 1 THEN 'fp16' ELSE 'int8' END AS variant
  FROM events)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_columns(table(spark, sf_dir, "events"))


def request_columns(events: DataFrame, *more: str) -> DataFrame:
    user = F.col("user_id") % 3
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("started_at"),
        (F.get_json_object("props", "$.k").cast("bigint") % 10 != 0).alias("success"),
        F.expr("shiftleft(1L, cast(event_id % 8 as int))").alias("batch_size"),
        (3 + F.col("event_id") % 50).alias("tokens"),
        F.when(user == 0, F.lit("fp32")).when(user == 1, F.lit("fp16")).otherwise(F.lit("int8")).alias("variant"),
        *more,
    )


# --------------------------------------------------------------------------------------------------
# Hashed text vectors, as the offline encoder makes them


def hashed_sql(source: str, key: str, text: str, width: int, dim: int, name: str, prefix: str) -> str:
    """CTEs ``<name>_tokens`` and ``<name>`` (key, tokens, v DOUBLE[dim]) for a text column."""
    return f"""{name}_words AS (
  SELECT {key} AS k, regexp_extract_all(lower('{prefix}: ' || {text}),
    '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS words FROM {source}),
{name}_tokens AS (
  SELECT k, len(words) + 2 AS tokens, unnest(words) AS token FROM {name}_words),
{name}_slots AS (
  SELECT k, tokens, ('0x' || substr(md5(token), 1, 8))::BIGINT % {width} AS slot,
    CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM {name}_tokens),
{name}_sums AS (
  SELECT k, slot, sum(sign) / any_value(tokens)::DOUBLE AS value FROM {name}_slots GROUP BY k, slot),
{name}_norms AS (SELECT k, sqrt(sum(value * value)) AS n FROM {name}_sums GROUP BY k),
{name}_dense AS (
  SELECT d.k, d.tokens, d.slot, (coalesce(s.value, 0.0::DOUBLE)
      / CASE WHEN coalesce(n.n, 0) > 1e-9 THEN n.n ELSE 1 END)::FLOAT::DOUBLE AS value
  FROM (SELECT k, len(words) + 2 AS tokens, unnest(range({dim})) AS slot FROM {name}_words) d
  LEFT JOIN {name}_sums s ON s.k = d.k AND s.slot = d.slot
  LEFT JOIN {name}_norms n ON n.k = d.k),
{name} AS (
  SELECT k AS {key}, any_value(tokens) AS tokens, list(value ORDER BY slot) AS v
  FROM {name}_dense GROUP BY k)"""


def with_prefix(prefix: str, text: str) -> Column:
    return prefixed(F.lit(prefix), F.col(text))
