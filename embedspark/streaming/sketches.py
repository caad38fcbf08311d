"""Windowed summaries kept as mergeable sketches.

A stream closes tumbling windows in append mode: a window is written once, when the watermark has passed it, with exact
counts and a KLL sketch of its latencies. Hours, days or any longer span are merged from the stored rows; the
requests are never read again. Sketches hold about ``k`` values, so a window with a third of all
requests is as small as any other and combines before the shuffle.

A sketch of up to ``k`` values is exact. Beyond that, with probability 0.99 the rank of a reported value is off by at
most ``RANK_ERROR`` of the count for k = 200, about in inverse proportion to k; merging does not add to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embedspark.operators.latency import QUANTILES

K = 200
#: Fixed value: the sketch family's published error of a single rank for k = 200.
RANK_ERROR = 0.0133


def sketched_windows(log: DataFrame, *groups: str, time: str = "started_at", size: str = "5 minutes", lateness: str | None = "10 minutes", k: int = K) -> DataFrame:
    """window_start, window_end, groups, total, successful, sum_ms, max_ms and ``sketch``; the sketch of no latency is null."""
    rows = log.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", lateness) if lateness else rows
    latency = F.col("latency_ms").cast("double")
    found = rows.groupBy(F.window("_ts", size).alias("_window"), *groups).agg(
        F.count("*").alias("total"),
        F.sum(F.col("success").cast("bigint")).alias("successful"),
        F.count(latency).alias("timed"),
        F.sum(latency).alias("sum_ms"),
        F.max(latency).alias("max_ms"),
        F.kll_sketch_agg_double(latency, k).alias("_sketch"),
    )
    sketch = F.when(F.col("timed") > 0, F.col("_sketch"))
    return found.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *groups,
        "total",
        "successful",
        "timed",
        "sum_ms",
        "max_ms",
        sketch.alias("sketch"),
    )


def merged_windows(windows: DataFrame, *groups: str, unit: str, k: int = K) -> DataFrame:
    """Stored windows merged to longer ones: ``unit`` is a unit of ``date_trunc``, such as hour or day."""
    found = windows.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), *groups).agg(
        *[F.sum(name).alias(name) for name in ("total", "successful", "timed", "sum_ms")],
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch", k).alias("_sketch"),
    )
    return found.withColumn("sketch", F.when(F.col("timed") > 0, F.col("_sketch"))).drop("_sketch")


def quantile_of(sketch: Column, q: float) -> Column:
    """The value at 0-based index floor(n * q) of the sketched values, as the exact percentiles have it.

    The sketch gives the smallest value whose share of values up to it reaches the rank asked for, which it takes as a
    constant; a rank larger by a millionth turns that into the index above.
    """
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q + 1e-6))


def with_quantiles(windows: DataFrame) -> DataFrame:
    """Replaces the sketch by p50, p95 and p99 and the sum by the mean; all are null without a latency."""
    ranks = [quantile_of(F.col("sketch"), q).alias(name) for name, q in QUANTILES.items()]
    kept = [c for c in windows.columns if c not in ("sketch", "sum_ms", "timed")]
    return windows.select(*kept, (F.col("sum_ms") / F.col("timed")).alias("mean_ms"), *ranks)
