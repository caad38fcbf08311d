"""Streams: continuous embedding, deduplication with expiry, windowed summaries.

All transformations are the batch operators or built-in stateful operators; state is keyed,
bounded by watermarks and kept in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from embedspark.operators.text import embed_texts


def parquet_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    files: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of the Parquet files of a folder, by name pattern; the schema is always explicit."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def embedded_stream(stream: DataFrame, text: str, **options) -> DataFrame:
    """Stateless continuous embedding; equal to the batch result row by row."""
    return embed_texts(stream, text, **options)


def deduplicated_stream(stream: DataFrame, content: str, time: str = "ts", expiry: str = "1 hour") -> DataFrame:
    """First row per content hash; a hash is forgotten one expiry after its time.

    Only the hash and its expiry are kept as state, not the content. Rows later than the watermark
    are dropped.
    """
    keyed = stream.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    return keyed.withWatermark(time, expiry).dropDuplicatesWithinWatermark(["content_hash"])


def time_window(kind: str, time: str = "ts", size: str = "5 minutes", slide: str = "1 minute") -> Column:
    """tumbling, sliding or session window of event time."""
    if kind == "tumbling":
        return F.window(time, size)
    if kind == "sliding":
        return F.window(time, size, slide)
    if kind == "session":
        return F.session_window(time, size)
    raise ValueError(f"unknown window kind {kind}")


def windowed_summary(
    log: DataFrame,
    kind: str = "tumbling",
    time: str = "ts",
    size: str = "5 minutes",
    slide: str = "1 minute",
    lateness: str | None = "10 minutes",
) -> DataFrame:
    """Requests, successes, mean and sketched percentiles per endpoint and window.

    Works on streams (with watermark; later rows are dropped) and on tables (``lateness=None``).
    """
    rows = log.withWatermark(time, lateness) if lateness else log
    window = time_window(kind, time, size, slide)
    ranks = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 1000)
    grouped = rows.groupBy(window.alias("window"), "endpoint").agg(
        F.count("*").alias("total"),
        F.sum(F.col("success").cast("bigint")).alias("successful"),
        F.avg("latency_ms").alias("mean_ms"),
        F.max("latency_ms").alias("max_ms"),
        ranks.alias("_r"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "endpoint",
        "total",
        "successful",
        "mean_ms",
        "max_ms",
        *[F.col("_r")[i].alias(name) for i, name in enumerate(("p50", "p95", "p99"))],
    )


def append_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes all available input exactly once into Parquet files."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def latest_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the complete result table under ``path``, replaced after every micro-batch."""

    def replace(table: DataFrame, _batch: int) -> None:
        table.write.mode("overwrite").parquet(path)

    return (
        stream.writeStream.foreachBatch(replace)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_slices(slices: list[DataFrame], folder: str, build, start, read=None) -> DataFrame:
    """Feeds tables to a stream one after the other, a micro-batch each, and returns what it wrote.

    ``build`` makes the stream's result from its source, ``start(result, path, checkpoint)`` starts it. Each
    slice is a run of its own that goes on from the checkpoint, as a daily job would. ``read(spark, path)`` opens what
    was written, if it is not plain Parquet.
    """
    spark = slices[0].sparkSession
    for rows in slices:
        rows.write.mode("append").parquet(f"{folder}/in")
        source = parquet_stream(spark, f"{folder}/in", rows.schema)
        run = start(build(source), f"{folder}/out", f"{folder}/checkpoint")
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    return read(spark, f"{folder}/out") if read else spark.read.parquet(f"{folder}/out")
