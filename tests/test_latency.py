import random

import pytest
from pyspark.sql import functions as F

from embedspark.operators import latency as ops
from embedspark.operators import ranks
from embedspark.operators.ranks import rank_values

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def test_rank_values_follow_the_index_rule(spark):
    rng = random.Random(4)
    groups = {
        "hot": [rng.choice([1.0, 1.0000001, 250.5]) for _ in range(3000)],
        "wide": [rng.lognormvariate(3, 4) for _ in range(1500)],
        "signed": [rng.uniform(-5, 5) for _ in range(700)],
        "one": [42.0],
        "same": [7.25] * 400,
        "two": [0.0, -0.5],
    }
    rows = [(name, value) for name, values in groups.items() for value in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in rank_values(df, ["g"], "v", SHARES).collect()}
    for name, values in groups.items():
        ordered = sorted(values)
        for column, share in SHARES.items():
            assert got[name][column] == ordered[int(len(ordered) * share)], (name, column)


def scan(series, threshold=0.2):
    """The scan as a loop: which results are produced before it stops."""
    best, kept = None, []
    for step, value in enumerate(series, 1):
        kept.append(step)
        if step == 1:
            continue
        if best is None or value < best:
            best = value
        elif value > best * (1 + threshold):
            break
    return kept


def test_early_stop_equals_the_loop(spark):
    rng = random.Random(9)
    series = {i: [rng.uniform(1, 3) for _ in range(rng.randint(1, 8))] for i in range(200)}
    rows = [(i, 2**n, v) for i, values in series.items() for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "scan int, batch_size int, latency_per_item double")
    got = {}
    for r in ops.early_stop(df, "scan").collect():
        got.setdefault(r["scan"], []).append(r["step"])
    assert {i: sorted(steps) for i, steps in got.items()} == {i: scan(v) for i, v in series.items()}


def test_tiers_and_speedups(spark):
    df = spark.createDataFrame([(9.9,), (10.0,), (49.9,), (50.0,)], "rps double")
    assert [r[0] for r in df.select(ops.throughput_tier(F.col("rps"))).collect()] == [
        "low", "moderate", "moderate", "good",
    ]
    means = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 4, 20.0), ("b", 2, 5.0)], "e string, batch_size int, latency_mean double"
    )
    got = {(r["e"], r["batch_size"]): r["speedup"] for r in ops.speedup_vs_single(means, "e").collect()}
    assert got == {("a", 1): 1.0, ("a", 4): 2.0, ("b", 2): 1.0}


def test_extremes_prefer_the_smaller_batch(spark):
    means = spark.createDataFrame(
        [("a", 1, 4.0, 10.0), ("a", 2, 2.0, 20.0), ("a", 4, 2.0, 20.0)],
        "e string, batch_size bigint, latency_per_item double, items_per_second double",
    )
    row = ops.extremes(means, "e").first()
    assert (row["best_throughput_batch"], row["best_latency_batch"], row["worst_throughput_batch"]) == (2, 2, 1)
    assert row["improvement_percent"] == pytest.approx(100.0)


def test_approximate_summary_is_close(spark):
    df = spark.range(1000).select(
        F.lit("e").alias("endpoint"),
        F.col("id").cast("double").alias("latency_ms"),
        (F.col("id") % 2 == 0).alias("success"),
        F.timestamp_seconds("id").alias("started_at"),
    )
    row = ops.approximate_summary(df, "endpoint").first()
    assert row["total"] == 1000 and row["successful"] == 500
    assert row["p95"] == pytest.approx(950, abs=2)


def test_null_keys_and_groups_without_values_keep_their_rows(spark):
    rows = [(None, "2024-01-01 00:00:00", 5.0, True, 1), ("a", "2024-01-01 00:00:00", 7.0, False, 1), ("b", "2024-01-01 00:00:00", None, True, 1)]
    log = spark.createDataFrame(rows, "endpoint string, started_at string, latency_ms double, success boolean, batch_size int")
    log = log.withColumns({"started_at": F.col("started_at").cast("timestamp"), "tokens": F.lit(3)})
    got = {r["endpoint"]: (r["total"], r["p50"]) for r in ops.endpoint_summary(log, "endpoint").collect()}
    assert got == {None: (1, 5.0), "a": (1, 7.0), "b": (1, None)}
    sized = {r["endpoint"]: r["p95"] for r in ops.batch_size_summary(log, "endpoint").collect()}
    assert sized == {None: 5.0, "b": None}
    means = spark.createDataFrame([(None, 1, 4.0), (None, 2, 4.0)], "g string, batch_size int, latency_mean double")
    assert sorted(r["speedup"] for r in ops.speedup_vs_single(means, "g").collect()) == [1.0, 2.0]


def plain_ranks(rows):
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)
    expected = {}
    for key, own in groups.items():
        values = sorted(v for v in own if v is not None)
        ranks = tuple(values[int(len(values) * q)] if values else None for q in SHARES.values())
        expected[key] = (len(own), *ranks)
    return expected


def skewed_rows():
    rng = random.Random(5)
    rows = [("hot", round(rng.lognormvariate(3, 1), 2)) for _ in range(20_000)]
    rows += [("same", 7.5)] * 3000 + [(None, float(i % 50)) for i in range(500)] + [("none", None)] * 3
    rows += [("one", 4.0), ("edge", -1.0), ("edge", 0.0), ("edge", None), ("far", 1e300), ("far", -1e300)]
    return rows + [(f"g{i % 40}", rng.choice([None, rng.random(), 0.5])) for i in range(2000)]


@pytest.mark.parametrize("margin", [0.0027, 0.0, 0.6])
def test_summary_with_ranks_is_exact(spark, margin):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = ranks.summary_with_ranks(df, ["g"], "v", SHARES, [F.count("*").alias("total")], margin=margin).collect()
    assert {r["g"]: tuple(r)[1:] for r in found} == plain_ranks(rows)


def test_summary_of_more_groups_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_GROUPS", 10)
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, v double")
    found = ranks.summary_with_ranks(df, ["g"], "v", SHARES, [F.count("*").alias("total")]).collect()
    assert {r["g"]: tuple(r)[1:] for r in found} == plain_ranks(rows)


def test_summary_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.summary_with_ranks(df, ["g"], "v", SHARES, [F.count("*").alias("total")]).count() == 0
