import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspark.functions import vectors
from embedspark.operators import variants as ops


def test_pair_metrics_match_numpy_with_nulls_and_mixed_widths(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, rng.normal(size=w).tolist(), rng.normal(size=w).tolist()) for i, w in enumerate((4, 7, 4, 1, 7))]
    pairs += [(90, [0.0, 0.0], [1.0, 2.0]), (91, None, [1.0]), (92, [1.0], None)]
    df = spark.createDataFrame(pairs, "id int, a array<double>, b array<double>")
    rows = {r["id"]: r for r in df.select("id", vectors.pair_metrics("a", "b").alias("m")).collect()}
    assert rows[91]["m"] is None and rows[92]["m"] is None
    assert rows[90]["m"]["cosine"] == 0.0
    for i, a, b in pairs[:5]:
        a, b, m = np.array(a), np.array(b), rows[i]["m"]
        assert m["cosine"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        assert m["l2_distance"] == pytest.approx(np.linalg.norm(a - b))
        assert m["max_abs_diff"] == pytest.approx(np.abs(a - b).max())
        assert m["mean_abs_diff"] == pytest.approx(np.abs(a - b).mean())
        assert m["dims_over"] == (np.abs(a - b) > 0.001).sum() and m["width"] == len(a)


def test_expressions_agree_with_the_arrow_pass(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    for row in df.select(
        vectors.cosine("a", "b").alias("c"),
        vectors.l2_distance("a", "b").alias("l"),
        vectors.max_abs_diff("a", "b").alias("x"),
        vectors.mean_abs_diff("a", "b").alias("n"),
        vectors.pair_metrics("a", "b").alias("m"),
    ).collect():
        m = row["m"]
        assert (row["c"], row["l"], row["x"], row["n"]) == pytest.approx(
            (m["cosine"], m["l2_distance"], m["max_abs_diff"], m["mean_abs_diff"])
        )


def test_normalize_guard_and_truncation(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 1e-10],)], "v array<float>")
    big, small = df.select(
        vectors.l2_normalize("v").alias("u"), F.size(vectors.truncate("v", 5)).alias("n")
    ).collect()
    assert big["u"] == pytest.approx([0.6, 0.8]) and big["n"] == 2
    assert small["u"] == pytest.approx([0.0, 1e-10], abs=1e-12)


def test_masked_mean(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])],
        "h array<array<float>>, m array<int>",
    )
    got = [r[0] for r in df.select(vectors.masked_mean("h", "m", 2)).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0]]


def test_orderings_need_three_items(spark):
    rows = [(1, p, float(p)) for p in range(3)] + [(2, p, 1.0) for p in range(2)]
    df = spark.createDataFrame(rows, "g int, pos int, d double")
    out = ops.orderings(df, "g", "pos", "d").collect()
    assert {r["ordering"] for r in out} == {"0-1-2", "0-2-1", "1-0-2", "1-2-0", "2-0-1", "2-1-0"}
    assert {r["g"] for r in out} == {1}
    assert [m["d"] for m in next(r for r in out if r["ordering"] == "2-0-1")["members"]] == [2.0, 0.0, 1.0]


def test_verdict_boundaries(spark):
    df = spark.createDataFrame(
        [(0.96,), (0.95,), (0.9,), (0.89,)], "c double"
    ).select(ops.quality_tier(F.col("c")))
    assert [r[0] for r in df.collect()] == ["very similar", "moderate", "moderate", "significant"]
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.5), (0.005, 0.001, 0.5), (0.2, 0.2, 0.5), (0.3, 0.3, 0.5), (0.4, 0.4, None)],
        "s double, d double, q double",
    ).select(ops.interference_verdict(F.col("s"), F.col("d"), F.col("q")))
    assert [r[0] for r in df.collect()] == ["perfect", "minimal", "less", "similar", "less"]


def test_speedup_without_denominator(spark):
    df = spark.range(1).select(ops.ratio(F.lit(3.0), F.lit(0.0)), ops.ratio(F.lit(3.0), F.lit(2.0)))
    assert tuple(df.first()) == (0.0, 1.5)
    assert math.isclose(df.first()[1], 1.5)
