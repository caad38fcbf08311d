"""Registered latency queries on the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.operators import latency as ops
from embedspark.operators.variants import metric_matrix
from embedspark.plans.fixtures import REQUEST_LOG_SQL, request_log
from embedspark.plans.registry import query, r6, s6


def rounded(df, *keep, digits=7):
    """All other columns rounded; integers and booleans stay as they are."""
    kinds = dict(df.dtypes)
    return df.select(
        *keep,
        *[
            r6(c, digits).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
            if c not in keep
        ],
    )


def at_sql(q: float) -> str:
    return f"list_sort(list(latency_ms))[floor(count(*) * {q}::DOUBLE)::BIGINT + 1]"


RANKS_SQL = ", ".join(f"{s6(at_sql(q), 7)} AS {name}" for name, q in ops.QUANTILES.items())
WALL_SQL = "((max(epoch_us(started_at) + latency_ms * 1000e0) - min(epoch_us(started_at))) / 1e6)"
COUNTS_SQL = f"""count(*) AS total, sum(success::INT)::BIGINT AS successful, sum((NOT success)::INT)::BIGINT AS failed,
  {s6("sum(success::INT) * 100e0 / count(*)", 7)} AS success_rate, {s6(WALL_SQL, 3)} AS wall_seconds,
  {s6(f"count(*) / {WALL_SQL}")} AS rps, {s6("avg(latency_ms)", 7)} AS mean_ms"""


@query(
    "b1_endpoint_summary",
    f"""WITH {REQUEST_LOG_SQL} SELECT endpoint, {COUNTS_SQL}, {RANKS_SQL} FROM request_log GROUP BY endpoint""",
)
def endpoint_summary(spark, sf_dir):
    rows = ops.endpoint_summary(request_log(spark, sf_dir), "endpoint")
    return rows.select(
        "endpoint",
        "total",
        "successful",
        "failed",
        r6("success_rate", 7).alias("success_rate"),
        r6("wall_seconds", 3).alias("wall_seconds"),
        r6("rps").alias("rps"),
        r6("mean_ms", 7).alias("mean_ms"),
        *[r6(name, 7).alias(name) for name in ops.QUANTILES],
    )


@query(
    "b2_b3_batch_size_summary",
    f"""WITH {REQUEST_LOG_SQL}
SELECT endpoint, batch_size, count(*) AS successful, {s6("avg(latency_ms)", 7)} AS latency_mean,
  {s6("coalesce(stddev_samp(latency_ms), 0)", 7)} AS latency_std, {s6("min(latency_ms)", 7)} AS latency_min,
  {s6("max(latency_ms)", 7)} AS latency_max, {s6("avg(latency_ms) / batch_size", 7)} AS latency_per_item,
  {s6("1000e0 / avg(latency_ms)", 7)} AS runs_per_second, {s6("batch_size * 1000e0 / avg(latency_ms)", 7)} AS items_per_second,
  {s6("avg(tokens)", 7)} AS mean_tokens, {s6("avg(tokens) * 1000e0 / avg(latency_ms)", 7)} AS tokens_per_second, {RANKS_SQL}
FROM request_log WHERE success GROUP BY endpoint, batch_size""",
)
def batch_size_summary(spark, sf_dir):
    return rounded(ops.batch_size_summary(request_log(spark, sf_dir), "endpoint"), "endpoint", "batch_size")


MEANS_SQL = f"""{REQUEST_LOG_SQL}, means AS (
  SELECT endpoint, batch_size, avg(latency_ms) AS latency_mean, avg(latency_ms) / batch_size AS latency_per_item,
    batch_size * 1000e0 / avg(latency_ms) AS items_per_second
  FROM request_log WHERE success AND NOT (endpoint = 'error' AND batch_size = 1) GROUP BY endpoint, batch_size)"""


def means(spark, sf_dir):
    """Means per endpoint and batch size; one endpoint lacks its baseline."""
    log = request_log(spark, sf_dir).where("not (endpoint = 'error' and batch_size = 1)")
    return ops.batch_means(log, "endpoint")


@query(
    "b4_speedup_vs_single",
    f"""WITH {MEANS_SQL}
SELECT m.endpoint, m.batch_size, CASE WHEN m.batch_size > 1 AND s.latency_mean IS NOT NULL
  THEN {s6("s.latency_mean * m.batch_size / m.latency_mean", 7)} ELSE 1.0::DOUBLE END AS speedup
FROM means m LEFT JOIN means s ON s.endpoint = m.endpoint AND s.batch_size = 1""",
)
def speedup_vs_single(spark, sf_dir):
    rows = ops.speedup_vs_single(means(spark, sf_dir), "endpoint")
    return rows.select("endpoint", "batch_size", r6("speedup", 7).alias("speedup"))


@query(
    "b5_speedup_vs_first",
    f"""WITH {MEANS_SQL}
SELECT endpoint, batch_size, {s6("first_value(latency_per_item) OVER (PARTITION BY endpoint ORDER BY batch_size) / latency_per_item", 7)} AS speedup
FROM means""",
)
def speedup_vs_first(spark, sf_dir):
    rows = ops.speedup_vs_first(means(spark, sf_dir), "endpoint")
    return rows.select("endpoint", "batch_size", r6("speedup", 7).alias("speedup"))


@query(
    "b6_best_and_worst",
    f"""WITH {MEANS_SQL}
SELECT endpoint, arg_max(batch_size, items_per_second) AS best_throughput_batch, {s6("max(items_per_second)", 7)} AS best_throughput,
  arg_min(batch_size, items_per_second) AS worst_throughput_batch, {s6("min(items_per_second)", 7)} AS worst_throughput,
  arg_min(batch_size, latency_per_item) AS best_latency_batch, {s6("min(latency_per_item)", 7)} AS best_latency,
  {s6("(max(items_per_second) / min(items_per_second) - 1) * 100", 3)} AS improvement_percent FROM means GROUP BY endpoint""",
)
def best_and_worst(spark, sf_dir):
    rows = ops.extremes(means(spark, sf_dir), "endpoint")
    return rounded(rows.withColumn("improvement_percent", r6("improvement_percent", 3)), "endpoint")


# A scan per endpoint and user: few runs each, so that some scans degrade early.
SCAN_SQL = f"""{REQUEST_LOG_SQL}, scan AS (
  SELECT endpoint || '/' || variant AS scan, batch_size, avg(latency_ms) AS latency_mean,
    avg(latency_ms) AS latency_per_item FROM request_log WHERE success GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY batch_size) AS step FROM scan),
judged AS (SELECT *, min(CASE WHEN step >= 2 THEN latency_per_item END) OVER
  (PARTITION BY scan ORDER BY batch_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM numbered),
stopped AS (SELECT *, min(CASE WHEN step >= 3 AND latency_per_item > best_before * 1.05::DOUBLE THEN step END)
  OVER (PARTITION BY scan) AS stop_step FROM judged)"""


@query(
    "b7_early_stop",
    f"""WITH {SCAN_SQL}
SELECT scan, batch_size, step::INT AS step, stop_step::INT AS stop_step, {s6("best_before", 7)} AS best_before
FROM stopped WHERE stop_step IS NULL OR step <= stop_step""",
)
def early_stop(spark, sf_dir):
    """Scans over batch sizes per endpoint and variant, stopping at 5 percent degradation."""
    scan = F.concat("endpoint", F.lit("/"), "variant")
    log = request_log(spark, sf_dir).where("success")
    rows = log.groupBy(scan.alias("scan"), "batch_size").agg(F.avg("latency_ms").alias("latency_per_item"))
    stopped = ops.early_stop(rows, "scan", threshold=0.05)
    return stopped.select(
        "scan", "batch_size", "step", "stop_step", r6("best_before", 7).alias("best_before")
    )


@query(
    "b8_advice_tier",
    f"""WITH {REQUEST_LOG_SQL}, scaled AS (SELECT * REPLACE (latency_ms * 40 AS latency_ms) FROM request_log),
s AS (SELECT endpoint, variant, count(*) * 20000e0 / {WALL_SQL} AS rps, {at_sql(0.95)} AS p95 FROM scaled GROUP BY endpoint, variant)
SELECT endpoint, variant, {s6("rps", 3)} AS rps, CASE WHEN rps < 10 THEN 'low' WHEN rps < 50 THEN 'moderate' ELSE 'good' END AS tier,
  p95 > 1000 AS slow_tail FROM s""",
)
def advice_tier(spark, sf_dir):
    """Advice per endpoint and variant, on latencies and rates scaled into the range of the tiers."""
    log = request_log(spark, sf_dir).withColumn("latency_ms", F.col("latency_ms") * 40)
    rows = ops.endpoint_summary(log, "endpoint", "variant").withColumn("rps", F.col("rps") * 20000)
    return rows.select(
        "endpoint",
        "variant",
        r6("rps", 3).alias("rps"),
        ops.throughput_tier(F.col("rps")).alias("tier"),
        ops.slow_tail(F.col("p95")).alias("slow_tail"),
    )


BENCH_SQL = f"""{REQUEST_LOG_SQL}, b AS (
  SELECT variant, batch_size, avg(latency_ms) AS mean, coalesce(stddev_samp(latency_ms), 0) AS std, min(latency_ms) AS min,
    max(latency_ms) AS max, avg(latency_ms) / batch_size AS per_image, batch_size * 1000e0 / avg(latency_ms) AS throughput
  FROM request_log WHERE success AND batch_size IN (1, 4, 8) GROUP BY variant, batch_size),
bench AS (SELECT b.*, s.mean / b.per_image AS speedup FROM b LEFT JOIN b s ON s.variant = b.variant AND s.batch_size = 1)"""


@query(
    "b9_variant_benchmark",
    f"""WITH {BENCH_SQL}
SELECT variant, batch_size, {", ".join(f"{s6(c, 7)} AS {c}" for c in ("mean", "std", "min", "max", "per_image", "throughput", "speedup"))} FROM bench""",
)
def variant_benchmark(spark, sf_dir):
    return rounded(ops.variant_benchmark(request_log(spark, sf_dir)), "variant", "batch_size")


@query(
    "b9_variant_matrix",
    f"""WITH {BENCH_SQL}, u AS (SELECT variant, 'batch_' || batch_size || '_' || unnest(['per_image', 'throughput', 'speedup']) AS metric,
  unnest([per_image, throughput, speedup]) AS value FROM bench)
SELECT metric, {", ".join(f"{s6(f'''max(value) FILTER (variant = '{v}')''', 7)} AS {v}" for v in ("fp32", "fp16", "int8"))},
  {s6("abs(max(value) FILTER (variant = 'fp32') - max(value) FILTER (variant = 'fp16'))", 7)} AS difference FROM u GROUP BY metric""",
)
def variant_matrix(spark, sf_dir):
    """The benchmark as a metric by variant matrix."""
    rows = ops.variant_benchmark(request_log(spark, sf_dir))
    names = ["per_image", "throughput", "speedup"]
    wide = rows.groupBy("variant").pivot("batch_size", [1, 4, 8]).agg(
        *[F.first(name).alias(name) for name in names]
    )
    metrics = {f"{size}_{name}": f"batch_{size}_{name}" for size in (1, 4, 8) for name in names}
    wide = wide.withColumnsRenamed(metrics)
    return rounded(metric_matrix(wide, "variant", list(metrics.values()), ["fp32", "fp16", "int8"]), "metric")


@query(
    "b12_warmup_exclusion",
    f"""WITH {REQUEST_LOG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY endpoint, batch_size ORDER BY started_at, request_id) AS run FROM request_log)
SELECT endpoint, batch_size, count(*) AS runs, min(request_id) AS first_request, {s6("avg(latency_ms)", 7)} AS latency_mean
FROM n WHERE run > 3 GROUP BY endpoint, batch_size""",
)
def warmup_exclusion(spark, sf_dir):
    kept = ops.without_warmup(request_log(spark, sf_dir), "endpoint", "batch_size")
    return kept.groupBy("endpoint", "batch_size").agg(
        F.count("*").alias("runs"),
        F.min("request_id").alias("first_request"),
        r6(F.avg("latency_ms"), 7).alias("latency_mean"),
    )


# Stages of a batch: ten consecutive events are the items of one request.
STAGES_SQL = f"""{REQUEST_LOG_SQL}, stages AS (SELECT request_id // 10 AS batch_id, latency_ms * 0.1::DOUBLE AS tokenize,
  latency_ms * 0.7::DOUBLE AS inference, latency_ms * 0.2::DOUBLE AS postprocess FROM request_log)"""


@query(
    "b13_stage_breakdown",
    f"""WITH {STAGES_SQL}, s AS (SELECT batch_id, count(*) AS items, sum(tokenize) AS tokenize, sum(inference) AS inference,
  sum(postprocess) AS postprocess FROM stages GROUP BY batch_id)
SELECT batch_id, items, {", ".join(f"{s6(c, 7)} AS {c}" for c in ("tokenize", "inference", "postprocess"))},
  {s6("tokenize + inference + postprocess", 7)} AS total, {s6("(tokenize + inference + postprocess) / items", 7)} AS mean_per_item FROM s""",
)
def stage_breakdown(spark, sf_dir):
    ms = F.col("latency_ms")
    stages = request_log(spark, sf_dir).select(
        F.expr("request_id div 10").alias("batch_id"),
        (ms * 0.1).alias("tokenize"),
        (ms * 0.7).alias("inference"),
        (ms * 0.2).alias("postprocess"),
    )
    rows = ops.stage_breakdown(stages, "batch_id", "tokenize", "inference", "postprocess")
    return rounded(rows, "batch_id", "items")


@query(
    "b14_micro_benchmark",
    f"""WITH {REQUEST_LOG_SQL}
SELECT variant, batch_size, {s6("avg(latency_ms)", 7)} AS mean, {s6("stddev_pop(latency_ms)", 7)} AS std,
  {s6("avg(latency_ms) / batch_size", 7)} AS per_image, {s6("1000e0 / avg(latency_ms) * batch_size", 7)} AS throughput
FROM request_log GROUP BY variant, batch_size""",
)
def micro_benchmark(spark, sf_dir):
    return rounded(ops.micro_benchmark(request_log(spark, sf_dir), "variant"), "variant", "batch_size")


@query(
    "b15_fetch_timing",
    f"""WITH {REQUEST_LOG_SQL}, f AS (SELECT request_id, latency_ms * 0.25::DOUBLE AS request_ms, latency_ms * 0.5::DOUBLE AS body_ms FROM request_log)
SELECT request_id, {s6("request_ms", 7)} AS request_ms, {s6("body_ms", 7)} AS body_ms, {s6("request_ms + body_ms", 7)} AS total_ms FROM f""",
)
def fetch_timing(spark, sf_dir):
    rows = request_log(spark, sf_dir).select(
        "request_id",
        (F.col("latency_ms") * 0.25).alias("request_ms"),
        (F.col("latency_ms") * 0.5).alias("body_ms"),
    )
    return rounded(rows.withColumn("total_ms", F.col("request_ms") + F.col("body_ms")), "request_id")
