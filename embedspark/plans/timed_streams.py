"""Registered streaming queries in which time matters: several micro-batches in time order, with late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.plans.fixtures import REQUEST_LOG_SQL, request_columns, table
from embedspark.plans.registry import query, r6, s6
from embedspark.plans.streams import TEXT_FORMAT
from embedspark.session import shared_folder
from embedspark.sources import sinks
from embedspark.streaming import cache, sketches, streams

SLICES = 4
DELAY_S = 600

# The log arrives in four parts by time. Of the first two parts, every 97th request comes with the last one.
ARRIVALS_SQL = f"""spanned AS (SELECT *, min(epoch_us(started_at)) OVER () AS lo, max(epoch_us(started_at)) OVER () AS hi,
    user_id FROM (SELECT r.*, e.user_id FROM request_log r JOIN events e ON e.event_id = r.request_id)),
arrivals AS (SELECT *, {SLICES} * (epoch_us(started_at) - lo) // (hi - lo + 1) AS due FROM spanned),
parted AS (SELECT *, CASE WHEN request_id % 97 = 0 AND due < 2 THEN {SLICES - 1} ELSE due END AS arrival FROM arrivals)"""


def arriving(spark, sf_dir):
    """The request log cut into its arrivals, by one read of it: each arrival is a folder of its own."""
    events = table(spark, sf_dir, "events")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    log = request_columns(events, "user_id")
    at = F.unix_micros("started_at")
    low, high = log.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [log]
    due = F.expr(f"({SLICES} * (unix_micros(started_at) - {low})) div {high - low + 1}")
    late = (F.col("request_id") % 97 == 0) & (due < 2)
    arrival = F.when(late, SLICES - 1).otherwise(due).cast("int")
    parted, folder = log.where(at.isNotNull()).withColumn("arrival", arrival), shared_folder(spark)
    parted.write.partitionBy("arrival").parquet(folder)
    stored = spark.read.schema(parted.schema).parquet(folder)
    return [stored.where(F.col("arrival") == number).drop("arrival") for number in range(SLICES)]


def bucket_end(us: str) -> str:
    return f"(({us}) // {DELAY_S * 1000000} + 1) * {DELAY_S * 1000000}"


ENTRIES_SQL = f"""{REQUEST_LOG_SQL}, {ARRIVALS_SQL},
marks AS (SELECT coalesce(max({bucket_end("epoch_us(started_at)")}) FILTER (arrival < {SLICES - 1}), 0) - {DELAY_S * 1000000} AS late_before,
    max({bucket_end("epoch_us(started_at)")}) - {DELAY_S * 1000000} AS final FROM parted),
kept AS (SELECT endpoint || '/' || user_id AS content, request_id, epoch_us(started_at) AS us, final FROM parted, marks
  WHERE arrival < {SLICES - 1} OR {bucket_end("epoch_us(started_at)")} > late_before),
gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS miss FROM kept
  WINDOW w AS (PARTITION BY content ORDER BY us, request_id)),
numbered AS (SELECT *, sum(miss) OVER (PARTITION BY content ORDER BY us, request_id ROWS UNBOUNDED PRECEDING) AS entry FROM gaps),
entries AS (SELECT content, entry, min(us) AS opened_at, arg_min(request_id, us) AS first_id, max(us) AS last_at,
    arg_max(request_id, us) AS last_id, count(*) AS requests, any_value(final) AS final FROM numbered GROUP BY content, entry)"""


def cache_rows(spark, sf_dir):
    folder = shared_folder(spark)

    def build(source):
        content = F.concat("endpoint", F.lit("/"), F.col("user_id").cast("string"))
        return cache.cache_events(source, content, F.col("started_at"), F.col("request_id"), lateness_s=DELAY_S, bucket_s=DELAY_S)

    with cache.rocksdb_state(spark):
        return streams.run_slices(arriving(spark, sf_dir), folder, build, streams.append_to_parquet)


@query(
    "x2_cache_misses",
    f"WITH {ENTRIES_SQL} SELECT content, opened_at, first_id FROM entries",
)
def cache_misses(spark, sf_dir):
    """The requests that a cache with one hour of expiry lets through, over four micro-batches."""
    rows = cache_rows(spark, sf_dir).where("kind = 'miss'")
    return rows.select(F.col("key").alias("content"), "opened_at", "first_id")


@query(
    "x2_cache_closed",
    f"""WITH {ENTRIES_SQL} SELECT content, opened_at, first_id, last_at, last_id, requests FROM
(SELECT *, lead(entry) OVER (PARTITION BY content ORDER BY entry) IS NOT NULL AS followed FROM entries)
WHERE followed OR (last_at + 3600000000) // 1000 + 1 <= final // 1000""",
)
def cache_closed(spark, sf_dir):
    """Entries that have expired, with their latest request and the number of requests they served."""
    rows = cache_rows(spark, sf_dir).where("kind = 'closed'")
    return rows.select(F.col("key").alias("content"), "opened_at", "first_id", "last_at", "last_id", "requests")


CLOSED_SQL = f"""{REQUEST_LOG_SQL}, {ARRIVALS_SQL},
windows AS (SELECT *, time_bucket(INTERVAL '5 minutes', started_at, TIMESTAMP '1970-01-01') AS start FROM parted),
marks AS (SELECT max(epoch_ms(started_at)) FILTER (arrival < {SLICES - 1}) - {DELAY_S * 1000} AS late_before,
    max(epoch_ms(started_at)) - {DELAY_S * 1000} AS final FROM parted),
closed AS (SELECT windows.* FROM windows, marks WHERE epoch_ms(start) + 300000 <= final
  AND (arrival < {SLICES - 1} OR late_before IS NULL OR epoch_ms(start) + 300000 > late_before))"""


def at_sql(q: float) -> str:
    return f"list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[floor(count(latency_ms) * {q}::DOUBLE)::BIGINT + 1]"


def summary_sql(start: str) -> str:
    ranks = ", ".join(f"{s6(at_sql(q), 7)} AS {name}" for name, q in sketches.QUANTILES.items())
    return f"""SELECT strftime({start}, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS total, sum(success::INT)::BIGINT AS successful,
  {s6("avg(latency_ms)", 9)} AS mean_ms, {s6("max(latency_ms)", 4)} AS max_ms, {ranks} FROM closed GROUP BY {start}, endpoint"""


HOUR_SQL = "date_trunc('hour', start)"


def stored_windows(spark, sf_dir):
    """Closed five-minute windows as the stream has stored them."""
    return streams.run_slices(
        arriving(spark, sf_dir),
        shared_folder(spark),
        lambda source: sketches.sketched_windows(source, "endpoint", lateness=f"{DELAY_S} seconds"),
        streams.append_to_parquet,
    )


def shown(windows):
    rows = sketches.with_quantiles(windows)
    return rows.select(
        F.date_format("window_start", TEXT_FORMAT).alias("window_start"),
        "endpoint",
        "total",
        "successful",
        r6("mean_ms", 9).alias("mean_ms"),
        r6("max_ms", 4).alias("max_ms"),
        *[r6(name, 7).alias(name) for name in sketches.QUANTILES],
    )


@query("x3_sketched_windows", f"WITH {CLOSED_SQL} {summary_sql('start')}")
def sketched_windows(spark, sf_dir):
    """Five-minute windows written once each, when closed; exact percentiles, as windows hold less than 200 requests here."""
    return shown(stored_windows(spark, sf_dir))


@query("x3_sketched_hours", f"WITH {CLOSED_SQL} {summary_sql(HOUR_SQL)}")
def sketched_hours(spark, sf_dir):
    """Hours merged from the stored windows."""
    return shown(sketches.merged_windows(stored_windows(spark, sf_dir), "endpoint", unit="hour"))


RANK_SLACK = 3 * sketches.RANK_ERROR


@query(
    "x3_sketched_days",
    f"""WITH {CLOSED_SQL} SELECT strftime(date_trunc('day', start), '%Y-%m-%d') AS day, endpoint, count(*) AS total,
  sum(success::INT)::BIGINT AS successful, true AS p50_in_bound, true AS p95_in_bound, true AS p99_in_bound
FROM closed GROUP BY date_trunc('day', start), endpoint HAVING count(latency_ms) > 0""",
)
def sketched_days(spark, sf_dir):
    """Days merged from the stored windows; the true ranks of their percentiles lie within the stated bound (three times it)."""
    windows = stored_windows(spark, sf_dir)
    days = sketches.with_quantiles(sketches.merged_windows(windows, "endpoint", unit="day")).where("p50 IS NOT NULL")
    log = request_columns(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    # The requests are read again for this comparison only; requests of windows that were not closed stay out.
    start = F.window("started_at", "5 minutes")["start"]
    spans = windows.select("window_start", F.col("endpoint").alias("of"), F.date_trunc("day", "window_start").alias("day"))
    dropped = (F.col("request_id") % 97 == 0) & F.lit(True)
    rows = log.withColumn("window_start", start).join(spans.withColumnRenamed("of", "endpoint"), ["window_start", "endpoint"])
    joined = rows.join(days.withColumnRenamed("window_start", "day"), ["day", "endpoint"])
    counts = joined.groupBy("day", "endpoint").agg(
        F.first("total").alias("total"),
        F.first("successful").alias("successful"),
        F.count("latency_ms").alias("n"),
        F.count_if(dropped).alias("unsure"),
        *[F.count_if(F.col("latency_ms") < F.col(name)).alias(f"{name}_below") for name in sketches.QUANTILES],
        *[F.count_if(F.col("latency_ms") <= F.col(name)).alias(f"{name}_upto") for name in sketches.QUANTILES],
    )

    def in_bound(name, q):
        wanted, slack = F.floor(F.col("n") * q), F.col("n") * RANK_SLACK + F.col("unsure") + 1
        return ((F.col(f"{name}_below") <= wanted + slack) & (F.col(f"{name}_upto") >= wanted - slack)).alias(f"{name}_in_bound")

    return counts.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "endpoint", "total", "successful", *[in_bound(n, q) for n, q in sketches.QUANTILES.items()]
    )


@query(
    "x1_dated_sink",
    f"""WITH {REQUEST_LOG_SQL} SELECT strftime(started_at, '%Y-%m-%d') AS day, endpoint, count(*) AS total, sum(tokens)::BIGINT AS tokens,
  {s6("sum(latency_ms)", 3)} AS sum_ms FROM request_log GROUP BY ALL""",
)
def dated_sink(spark, sf_dir):
    """The log as a stream into dated folders; every micro-batch is handed to the sink twice and counts once."""

    def start(rows, path, checkpoint):
        def twice(batch, number):
            for _ in range(2):
                sinks.commit_batch(batch, path, number, "day")

        writer = rows.writeStream.foreachBatch(twice).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    rows = streams.run_slices(
        arriving(spark, sf_dir),
        shared_folder(spark),
        lambda source: source.withColumn("day", F.date_format("started_at", "yyyy-MM-dd")),
        start,
        lambda session, path: sinks.committed_rows(session, path, "day"),
    )
    return rows.groupBy(F.col("day").cast("string").alias("day"), "endpoint").agg(
        F.count("*").alias("total"), F.sum("tokens").alias("tokens"), r6(F.sum("latency_ms"), 3).alias("sum_ms")
    )
