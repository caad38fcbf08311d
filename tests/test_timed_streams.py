"""Keyed cache with expiry and sketched windows, over several micro-batches, against plain versions."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspark.streaming import cache, sketches, streams

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def us(moment):
    return int((moment - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def plain_entries(rows):
    """Misses and closed entries by key from (key, time, id) in time order; the last entry of a key stays open."""
    misses, closed, by_key = [], [], defaultdict(list)
    for key, moment, number in rows:
        by_key[key].append((us(moment), number))
    for key, own in by_key.items():
        entry = None
        for at, number in sorted(own):
            if entry is None or at - entry[2] > HOUR:
                if entry:
                    closed.append((key, *entry))
                entry = [at, number, at, number, 1]
                misses.append((key, at, number))
            else:
                entry[2:] = [at, number, entry[4] + 1]
        closed.append((key, *entry))
    return Counter(misses), Counter(closed)


def cache_run(spark, tmp_path, batches, **options):
    schema = "key string, at timestamp, id bigint"
    slices = [spark.createDataFrame(rows, schema).repartition(3) for rows in batches]
    build = lambda source: cache.cache_events(source, F.col("key"), F.col("at"), F.col("id"), **options)
    with cache.rocksdb_state(spark):
        found = streams.run_slices(slices, str(tmp_path), build, streams.append_to_parquet).collect()
    misses = Counter((r["key"], r["opened_at"], r["first_id"]) for r in found if r["kind"] == "miss")
    closed = Counter(tuple(r)[1:] for r in found if r["kind"] == "closed")
    return misses, closed


def test_cache_equals_a_plain_one(spark, tmp_path):
    random = np.random.default_rng(3)
    rows = []
    for number in range(1500):
        # A third of all requests has one key; keys also come as null and as text that looks like a marker.
        key = "hot" if number % 3 == 0 else [None, "-", "=", "a", "b"][int(random.integers(5))] if number % 7 == 0 else f"k{random.integers(300)}"
        rows.append((key, START + dt.timedelta(seconds=int(random.integers(48 * 3600))), number))
    parts = [[r for r in rows if r[1].day == day and (r[1].hour < 12) == early] for day in (1, 2) for early in (True, False)]
    end = [("end", START + dt.timedelta(days=9), 9000)]
    misses, closed = cache_run(spark, tmp_path, [*parts, end])
    expected_misses, expected_closed = plain_entries(rows + end)
    assert misses == expected_misses
    assert closed == Counter({c: n for c, n in expected_closed.items() if c[0] != "end"})


def test_cache_hits_refresh_ties_and_late_rows(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    batches = [
        [("a", at(0), 1), ("a", at(0), 0), ("a", at(50), 2)],
        [("a", at(100), 3), ("a", at(160), 4)],  # each within the hour of the one before; exactly the hour is a hit
        [("a", at(221), 5), ("b", at(1000), 6), ("b", at(1000), 7)],
        [("a", at(30), 8), ("c", at(1003), 9)],  # late, and not late
        [("end", at(3000), 10)],
    ]
    misses, closed = cache_run(spark, tmp_path, batches)
    assert misses == Counter([("a", us(at(0)), 0), ("a", us(at(221)), 5), ("b", us(at(1000)), 6), ("c", us(at(1003)), 9), ("end", us(at(3000)), 10)])
    assert closed == Counter(
        [
            ("a", us(at(0)), 0, us(at(160)), 4, 5),
            ("a", us(at(221)), 5, us(at(221)), 5, 1),
            ("b", us(at(1000)), 6, us(at(1000)), 7, 2),
            ("c", us(at(1003)), 9, us(at(1003)), 9, 1),
        ]
    )


def test_cache_keeps_the_keys_of_a_group_apart(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    batches = [
        [(f"k{i}", at(i), i) for i in range(40)] + [(None, at(5), 40)],
        [(f"k{i}", at(60 + i + i % 2), 100 + i) for i in range(40)],  # every second one is a minute above the hour
        [("end", at(3000), 900)],
    ]
    misses, closed = cache_run(spark, tmp_path, batches, groups=1)
    expected_misses, expected_closed = plain_entries([r for part in batches for r in part])
    assert misses == expected_misses
    assert closed == Counter({c: n for c, n in expected_closed.items() if c[0] != "end"})


def test_cache_refuses_buckets_above_the_expiry(spark):
    rows = spark.createDataFrame([("a", START, 1)], "key string, at timestamp, id bigint")
    with pytest.raises(ValueError):
        cache.cache_events(rows, F.col("key"), F.col("at"), F.col("id"), expiry_s=60)


LOG = "started_at timestamp, endpoint string, latency_ms double, success boolean"


def rank_errors(values, found, q):
    """How far the true ranks of a reported value are from the wanted one, as a share of all."""
    n, values = len(values), np.sort(values)
    below, upto = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
    wanted = int(n * q)
    return max(0, below - wanted, wanted - upto + 1) / n


def test_ranks_of_merged_sketches(spark):
    random = np.random.default_rng(11)
    values = {e: random.lognormal(3, 1.5, n).round(3) for e, n in (("hot", 60_000), ("x", 5_000), ("few", 90))}
    rows = [(START + dt.timedelta(seconds=i * 86_000 // len(v)), e, float(x), True) for e, v in values.items() for i, x in enumerate(v)]
    windows = sketches.sketched_windows(spark.createDataFrame(rows, LOG).repartition(8), "endpoint", lateness=None)
    days = {r["endpoint"]: r for r in sketches.with_quantiles(sketches.merged_windows(windows, "endpoint", unit="day")).collect()}
    for endpoint, own in values.items():
        assert days[endpoint]["total"] == len(own) and days[endpoint]["max_ms"] == own.max()
        for name, q in sketches.QUANTILES.items():
            assert rank_errors(own, days[endpoint][name], q) <= 2 * sketches.RANK_ERROR
    assert [days["few"][name] for name in ("p50", "p95", "p99")] == [sorted(values["few"])[int(90 * q)] for q in (0.5, 0.95, 0.99)]


@pytest.mark.parametrize("n", [1, 2, 10, 20, 100, 200])
def test_small_sketches_are_exact(spark, n):
    rows = [(START, None, float(i * 7 % n), None) for i in range(n)]
    windows = sketches.sketched_windows(spark.createDataFrame(rows, LOG), "endpoint", lateness=None)
    row = sketches.with_quantiles(windows).first()
    assert [row[name] for name in sketches.QUANTILES] == [float(int(n * q)) for q in sketches.QUANTILES.values()]


def test_windows_without_latency_keep_their_row(spark):
    rows = [(START, "x", None, True), (START, None, None, None), (START, "y", 4.0, False), (START + dt.timedelta(hours=2), "x", 8.0, True)]
    windows = sketches.sketched_windows(spark.createDataFrame(rows, LOG), "endpoint", lateness=None)
    days = {r["endpoint"]: r for r in sketches.with_quantiles(sketches.merged_windows(windows, "endpoint", unit="day")).collect()}
    assert (days["x"]["total"], days["x"]["p50"], days["x"]["mean_ms"]) == (2, 8.0, 8.0)
    assert (days[None]["total"], days[None]["p50"], days[None]["mean_ms"]) == (1, None, None)
    assert sketches.merged_windows(windows.where("false"), "endpoint", unit="hour").count() == 0


def test_windows_close_once_and_drop_late_rows(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    batches = [
        [(at(0), "x", 10.0, True), (at(1), "x", 20.0, False)],
        [(at(60), "x", 1.0, True)],
        [(at(2), "x", 99.0, True), (at(52), "x", 5.0, True)],  # the first is late, the second is not
        [(at(400), "x", 1.0, True)],
    ]
    slices = [spark.createDataFrame(rows, LOG) for rows in batches]
    build = lambda source: sketches.sketched_windows(source, "endpoint")
    found = sketches.with_quantiles(streams.run_slices(slices, str(tmp_path), build, streams.append_to_parquet)).collect()
    rows = sorted((r["window_start"], r["total"], r["successful"], r["mean_ms"], r["max_ms"], r["p50"]) for r in found)
    assert rows == [(at(0), 2, 1, 15.0, 20.0, 20.0), (at(50), 1, 1, 5.0, 5.0, 5.0), (at(60), 1, 1, 1.0, 1.0, 1.0)]


def test_arrivals_are_cut_by_one_read(spark, tmp_path):
    """the slices are read from the folder that holds them apart; none scans the whole log again."""
    from embedspark.plans.timed_streams import arriving

    at = dt.datetime(2024, 1, 1)
    rows = [(n, at + dt.timedelta(minutes=n), n % 3, "search", float(n), '{"k": 1}') for n in range(200)]
    rows += [rows[5], (None, at, 1, None, None, None), (7, None, 1, "search", 1.0, "{}")]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    slices = arriving(spark, str(tmp_path))
    found = [sorted(-1 if r["request_id"] is None else r["request_id"] for r in part.collect()) for part in slices]
    assert found == [sorted([-1, 5, *range(1, 50)]), [*range(50, 97), 98, 99], [*range(100, 150)], [0, 97, *range(150, 200)]]
    files = [set(part.inputFiles()) for part in slices]
    assert not any("events.parquet" in name for own in files for name in own)
    assert [part.columns for part in slices] == [slices[0].columns] * 4 and "arrival" not in slices[0].columns
