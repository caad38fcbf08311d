"""Registered streaming queries: each runs a stream over a given table until its input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.operators.encoders import HashingTextEncoder
from embedspark.plans.fixtures import REQUEST_LOG_SQL, hashed_sql, request_columns, table
from embedspark.plans.registry import query, r6, s6
from embedspark.session import shared_folder
from embedspark.streaming import streams

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def stream_of(spark, sf_dir, name):
    """A given table as a stream, be it one file or a folder of files: a pattern may match either, a plain path only a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def log_stream(spark, sf_dir):
    log = request_columns(stream_of(spark, sf_dir, "events"))
    return log.withColumn("ts", F.col("started_at").cast("timestamp"))


def finished(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception():
        raise query_handle.exception()


@query(
    "x1_stream_embedding",
    f"""WITH {hashed_sql("documents", "doc_id", "text", 64, 16, "docs", "search_document")}
SELECT doc_id, tokens, {s6("list_sum(v)", 5)} AS total, {s6("v[1]")} AS first_value FROM docs""",
)
def stream_embedding(spark, sf_dir):
    """Documents arriving as a stream, embedded and appended to Parquet."""
    folder = shared_folder(spark)
    embedded = streams.embedded_stream(
        stream_of(spark, sf_dir, "documents"),
        "text",
        encoder=HashingTextEncoder(64),
        prefix=F.lit("search_document"),
        dim=16,
    ).select("doc_id", "tokens", "embedding")
    finished(streams.append_to_parquet(embedded, f"{folder}/out", f"{folder}/checkpoint"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id",
        F.col("tokens").cast("bigint").alias("tokens"),
        r6(total, 5).alias("total"),
        r6(F.element_at("embedding", 1)).alias("first_value"),
    )


@query(
    "x2_stream_dedup",
    "SELECT DISTINCT event_type || '/' || user_id AS content FROM events",
)
def stream_dedup(spark, sf_dir):
    """Requests with equal content reach the encoder once; all input is one micro-batch here."""
    folder = shared_folder(spark)
    rows = stream_of(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("content"),
    )
    unique = streams.deduplicated_stream(rows, "content").select("content")
    finished(streams.append_to_parquet(unique, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


def window_sql(size: str) -> str:
    start = f"time_bucket(INTERVAL '{size}', started_at, TIMESTAMP '1970-01-01')"
    return f"""WITH {REQUEST_LOG_SQL}
SELECT strftime({start}, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS total,
  sum(success::INT)::BIGINT AS successful, {s6("avg(latency_ms)", 9)} AS mean_ms, {s6("max(latency_ms)", 4)} AS max_ms
FROM request_log GROUP BY {start}, endpoint"""


def shown(rows):
    return rows.select(
        F.date_format("window_start", TEXT_FORMAT).alias("window_start"),
        "endpoint",
        "total",
        "successful",
        r6("mean_ms", 9).alias("mean_ms"),
        r6("max_ms", 4).alias("max_ms"),
    )


def log_table(spark, sf_dir):
    log = request_columns(table(spark, sf_dir, "events"))
    return log.withColumn("ts", F.col("started_at").cast("timestamp"))


@query("x3_windowed_tumbling", window_sql("5 minutes"))
def windowed_tumbling(spark, sf_dir):
    return shown(streams.windowed_summary(log_table(spark, sf_dir), lateness=None))


@query("x3_windowed_stream", window_sql("5 minutes"))
def windowed_stream(spark, sf_dir):
    """The same summary kept up to date by a stream."""
    folder = shared_folder(spark)
    rows = streams.windowed_summary(log_stream(spark, sf_dir))
    finished(streams.latest_table(rows, f"{folder}/out", f"{folder}/checkpoint"))
    return shown(spark.read.parquet(f"{folder}/out"))


@query(
    "x3_windowed_sliding",
    f"""WITH {REQUEST_LOG_SQL}, copies AS (
  SELECT time_bucket(INTERVAL '1 hour', started_at, TIMESTAMP '1970-01-01') - to_hours(unnest([0, 1, 2])) AS window_start,
    endpoint, success, latency_ms FROM request_log)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS total, sum(success::INT)::BIGINT AS successful,
  {s6("avg(latency_ms)", 9)} AS mean_ms, {s6("max(latency_ms)", 4)} AS max_ms FROM copies GROUP BY copies.window_start, endpoint""",
)
def windowed_sliding(spark, sf_dir):
    """Three hours, every hour."""
    rows = streams.windowed_summary(
        log_table(spark, sf_dir), "sliding", size="3 hours", slide="1 hour", lateness=None
    )
    return shown(rows)


@query(
    "x3_windowed_session",
    f"""WITH {REQUEST_LOG_SQL}, gaps AS (
  SELECT *, CASE WHEN started_at - lag(started_at) OVER (PARTITION BY endpoint ORDER BY started_at) < INTERVAL '30 minutes'
    THEN 0 ELSE 1 END AS fresh FROM request_log),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY endpoint ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT strftime(min(started_at), '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS total, sum(success::INT)::BIGINT AS successful,
  {s6("avg(latency_ms)", 9)} AS mean_ms, {s6("max(latency_ms)", 4)} AS max_ms FROM sessions GROUP BY endpoint, session""",
)
def windowed_session(spark, sf_dir):
    """Sessions that end after half an hour without requests."""
    rows = streams.windowed_summary(log_table(spark, sf_dir), "session", size="30 minutes", lateness=None)
    return shown(rows)
