"""Latency and throughput analytics over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.operators.ranks import null_safe_join, summary_with_ranks
from embedspark.session import written

# The reported quantiles.
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def micros(moment: Column) -> Column:
    """Microseconds of a timestamp, for differences."""
    return F.unix_micros(moment.cast("timestamp"))


def _endpoint_aggregates() -> list[Column]:
    started = micros(F.col("started_at"))
    ended = started + F.col("latency_ms") * 1000.0
    wall = (F.max(ended) - F.min(started)) / 1e6
    total = F.count("*")
    good = F.sum(F.col("success").cast("bigint"))
    return [
        total.alias("total"),
        good.alias("successful"),
        (total - good).alias("failed"),
        (good * 100.0 / total).alias("success_rate"),
        wall.alias("wall_seconds"),
        (total / wall).alias("rps"),
        F.avg("latency_ms").alias("mean_ms"),
    ]


def endpoint_counts(log: DataFrame, *groups: str) -> DataFrame:
    """Totals, success rate, request rate over the wall time and mean latency of every group.

    Wall time on a log is from the first start to the last end.
    """
    return log.groupBy(*groups).agg(*_endpoint_aggregates())


def endpoint_summary(log: DataFrame, *groups: str) -> DataFrame:
    """``endpoint_counts`` with exact percentiles over all requests; NULL where a group has no latency."""
    return summary_with_ranks(log, list(groups), "latency_ms", QUANTILES, _endpoint_aggregates())


def approximate_summary(log: DataFrame, *groups: str, accuracy: int = 10000) -> DataFrame:
    """One-pass form with sketched percentiles, for when a small rank error is acceptable."""
    ranks = F.percentile_approx("latency_ms", list(QUANTILES.values()), accuracy)
    parts = log.groupBy(*groups).agg(ranks.alias("_r"))
    named = parts.select(*groups, *[F.col("_r")[i].alias(n) for i, n in enumerate(QUANTILES)])
    return null_safe_join(endpoint_counts(log, *groups), named, list(groups), "left")


def batch_size_summary(log: DataFrame, *groups: str) -> DataFrame:
    """Latency and throughput of successful runs per group and batch size, with token throughput."""
    keys = [*groups, "batch_size"]
    good = log.where("success")
    mean = F.avg("latency_ms")
    moments = [
        F.count("*").alias("successful"),
        mean.alias("latency_mean"),
        F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("latency_std"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        (mean / F.col("batch_size")).alias("latency_per_item"),
        (1000.0 / mean).alias("runs_per_second"),
        (F.col("batch_size") * 1000.0 / mean).alias("items_per_second"),
        F.avg("tokens").alias("mean_tokens"),
        F.when(mean > 0, F.avg("tokens") * 1000.0 / mean).otherwise(F.lit(0.0)).alias("tokens_per_second"),
    ]
    return summary_with_ranks(good, keys, "latency_ms", QUANTILES, moments)


def batch_means(log: DataFrame, *groups: str) -> DataFrame:
    """Mean latency and per-item latency of successful runs: the input of the speedup operators."""
    return (
        log.where("success")
        .groupBy(*groups, "batch_size")
        .agg(F.avg("latency_ms").alias("latency_mean"))
        .withColumns(
            {
                "latency_per_item": F.col("latency_mean") / F.col("batch_size"),
                "items_per_second": F.col("batch_size") * 1000.0 / F.col("latency_mean"),
            }
        )
    )


def speedup_vs_single(means: DataFrame, *groups: str) -> DataFrame:
    """Speedup against doing the same items one by one; 1.0 without a baseline or for one item."""
    base = means.where("batch_size = 1").select(*groups, F.col("latency_mean").alias("_base"))
    faster = F.col("_base") * F.col("batch_size") / F.col("latency_mean")
    joined = null_safe_join(means, base, list(groups), "left")
    return joined.withColumn(
        "speedup", F.when(F.col("batch_size") > 1, F.coalesce(faster, F.lit(1.0))).otherwise(F.lit(1.0))
    ).drop("_base")


def speedup_vs_first(means: DataFrame, *groups: str) -> DataFrame:
    """Per-item time of the smallest batch over that of each batch."""
    order = Window.partitionBy(*groups).orderBy("batch_size")
    first = F.first_value("latency_per_item").over(order)
    return means.withColumn("speedup", first / F.col("latency_per_item"))


def extremes(means: DataFrame, *groups: str) -> DataFrame:
    """Best and worst throughput, best per-item latency (smallest batch on ties), improvement."""

    def batch_at(best: Column, score: Column) -> Column:
        return best("batch_size", F.struct(score, -F.col("batch_size")))

    rate, per_item = F.col("items_per_second"), F.col("latency_per_item")
    return means.groupBy(*groups).agg(
        batch_at(F.max_by, rate).alias("best_throughput_batch"),
        F.max(rate).alias("best_throughput"),
        batch_at(F.max_by, -rate).alias("worst_throughput_batch"),
        F.min(rate).alias("worst_throughput"),
        batch_at(F.max_by, -per_item).alias("best_latency_batch"),
        F.min(per_item).alias("best_latency"),
        ((F.max(rate) / F.min(rate) - 1) * 100).alias("improvement_percent"),
    )


def early_stop(means: DataFrame, *groups: str, threshold: float = 0.2) -> DataFrame:
    """Batch sizes a scan would have run: it stops after the first clear degradation.

    The first result never sets the best value, the second always does; from the third on the scan
    stops after a per-item latency above (1 + threshold) times the best before it.
    """
    order = Window.partitionBy(*groups).orderBy("batch_size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*groups)
    numbered = means.withColumn("step", F.row_number().over(order))
    best = F.min(F.when(F.col("step") >= 2, F.col("latency_per_item"))).over(before)
    judged = numbered.withColumn("best_before", best)
    breach = (F.col("step") >= 3) & (
        F.col("latency_per_item") > F.col("best_before") * (1.0 + threshold)
    )
    stopped = judged.withColumn("stop_step", F.min(F.when(breach, F.col("step"))).over(group))
    return stopped.where(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))


def throughput_tier(rps: Column) -> Column:
    return (
        F.when(rps < 10, F.lit("low")).when(rps < 50, F.lit("moderate")).otherwise(F.lit("good"))
    )


def slow_tail(p95: Column) -> Column:
    return p95 > 1000.0


def without_warmup(log: DataFrame, *groups: str, runs: int = 3) -> DataFrame:
    """Drops the first runs of every group by time.

    Only the few earliest rows per group are ranked (cut before the shuffle). Their ids are written,
    so that Spark knows how few they are and the log loses them without being moved.
    """
    order = Window.partitionBy(*groups).orderBy("started_at", "request_id")
    first = (
        log.select("request_id", "started_at", *groups)
        .withColumn("_run", F.row_number().over(order))
        .where(F.col("_run") <= runs)
        .select("request_id")
    )
    return log.join(written(first), "request_id", "left_anti")


def variant_benchmark(log: DataFrame, sizes: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """Per variant and batch size: mean, spread, per-image time, throughput, speedup vs size 1."""
    mean = F.avg("latency_ms")
    rows = (
        log.where(F.col("success") & F.col("batch_size").isin(*sizes))
        .groupBy("variant", "batch_size")
        .agg(
            mean.alias("mean"),
            F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("std"),
            F.min("latency_ms").alias("min"),
            F.max("latency_ms").alias("max"),
            (mean / F.col("batch_size")).alias("per_image"),
            F.when(mean > 0, F.col("batch_size") * 1000.0 / mean).otherwise(F.lit(0.0)).alias("throughput"),
        )
    )
    single = rows.where("batch_size = 1").select("variant", F.col("mean").alias("_single"))
    return null_safe_join(rows, single, ["variant"], "left").withColumn(
        "speedup", F.col("_single") / F.col("per_image")
    ).drop("_single")


def micro_benchmark(log: DataFrame, *groups: str) -> DataFrame:
    """Mean and population spread of batch times, per image and as throughput."""
    mean = F.avg("latency_ms")
    return log.groupBy(*groups, "batch_size").agg(
        mean.alias("mean"),
        F.stddev_pop("latency_ms").alias("std"),
        (mean / F.col("batch_size")).alias("per_image"),
        (1000.0 / mean * F.col("batch_size")).alias("throughput"),
    )


def stage_breakdown(stages: DataFrame, request: str, *stage_columns: str) -> DataFrame:
    """Sum of every stage over the items of a request, their total and the mean per item."""
    sums = [F.sum(c).alias(c) for c in stage_columns]
    rows = stages.groupBy(request).agg(F.count("*").alias("items"), *sums)
    total = sum((F.col(c) for c in stage_columns), F.lit(0.0))
    return rows.withColumn("total", total).withColumn("mean_per_item", F.col("total") / F.col("items"))
