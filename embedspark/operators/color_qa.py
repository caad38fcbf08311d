"""Comparison of two colour runs over the same images: errors, warnings, distances, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.constants import AVERAGE_TOLERANCE, DOMINANT_TOLERANCE
from embedspark.functions import color as fn
from embedspark.session import written

METHODS = ("arithmetic", "geometric")


def method_tasks(images: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One task per image and averaging method; the methods are a short literal list."""
    return images.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def channel_errors(a: Column, b: Column, tolerance: float) -> Column:
    """Channels of two rgb arrays that differ by more than the tolerance: array of (channel, diff).

    A difference in hex text alone is no error; a missing side gives no channels here.
    """
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    indexed = F.transform(gaps, lambda gap, i: F.struct(i.alias("channel"), gap.alias("diff")))
    return F.coalesce(
        F.filter(indexed, lambda e: e["diff"] > tolerance), F.array().cast("array<struct<channel:int,diff:double>>")
    )


def missing_side(left: Column, right: Column) -> Column:
    """Error text if exactly one run has colours, NULL if both or none have."""
    return F.when(left.isNotNull() & right.isNull(), F.lit("right has no colors but left does")).when(
        left.isNull() & right.isNotNull(), F.lit("left has no colors but right does")
    )


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of two runs (keys, color_data) with error and warning columns.

    Average differences fail a comparison, dominant differences only warn, a one-sided result fails. A filter behind it
    may make the join an inner one, which must not broadcast a run either.
    """
    both = left.select(*keys, F.col("color_data").alias("left")).join(
        right.select(*keys, F.col("color_data").alias("right")).hint("merge"), keys, "full"
    )
    a, b = F.col("left"), F.col("right")
    averages = channel_errors(a["avg_color"]["rgb"], b["avg_color"]["rgb"], AVERAGE_TOLERANCE)
    dominants = channel_errors(
        a["dominant_color"]["rgb"], b["dominant_color"]["rgb"], DOMINANT_TOLERANCE
    )
    return both.withColumns(
        {"avg_errors": averages, "dom_warnings": dominants, "side_error": missing_side(a, b)}
    ).withColumns(
        {
            "avg_match": F.size("avg_errors") == 0,
            "dom_match": F.size("dom_warnings") == 0,
            "passed": (F.size("avg_errors") == 0) & F.col("side_error").isNull(),
        }
    )


def with_distances(df: DataFrame, left_hex: Column, right_hex: Column, left_rgb: Column, right_rgb: Column) -> DataFrame:
    """Adds hex distance, number of differing hex digits and channel distance."""
    return df.withColumns(
        {
            "hex_diff": F.coalesce(fn.hex_distance(left_hex, right_hex), F.lit(1.0)),
            "hex_digits": F.coalesce(fn.hex_digit_difference(left_hex, right_hex), F.lit(6)),
            "rgb_diff": fn.channel_distance(left_rgb, right_rgb),
        }
    )


def pass_summary(results: DataFrame, passed: str = "passed", *groups: str) -> DataFrame:
    """Passed, total and whole percent."""
    counts = results.groupBy(*groups).agg(
        F.sum(F.col(passed).cast("bigint")).alias("passed"), F.count("*").alias("total")
    )
    return counts.withColumn("percent", F.floor(F.col("passed") * 100 / F.col("total")))


def both_methods(results: DataFrame, key: str, columns: list[str], method: str = "method") -> DataFrame:
    """One row per image that has a result for both methods, columns suffixed by the method.

    A combined aggregate instead of a join of the two halves, so the results are computed once.
    """
    named = {
        f"{c}_{name}": F.max(F.when(F.col(method) == name, F.col(c))) for name in METHODS for c in columns
    }
    seen = [F.max((F.col(method) == name).cast("int")).alias(f"_has_{name}") for name in METHODS]
    wide = results.groupBy(key).agg(*[value.alias(c) for c, value in named.items()], *seen)
    both = F.col(f"_has_{METHODS[0]}") + F.col(f"_has_{METHODS[1]}") == 2
    return wide.where(both).select(key, *named)


def is_success(avg_a: Column, avg_b: Column, left_hex: Column, right_hex: Column) -> Column:
    """Both averages match and the dominant hex texts do not differ (a missing one never differs)."""
    differs = left_hex.isNotNull() & right_hex.isNotNull() & (F.lower(left_hex) != F.lower(right_hex))
    return avg_a & avg_b & ~differs


def ranked_by_distance(df: DataFrame, key: str) -> DataFrame:
    """Worst first by (hex distance, differing digits), with the rank of that pair of values.

    Rows of equal distance share a rank. There are at most 256 * 7 pairs of values, so ranks come
    from their counts and the rows themselves are only sorted by range, never put in one task. The
    rows are written first: they are needed twice and cost far more to compute than to read.
    """
    df = written(df)
    classes = df.groupBy("hex_diff", "hex_digits").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("hex_diff"), F.desc("hex_digits")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = classes.select(
        "hex_diff", "hex_digits", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("rank")
    )
    return df.join(ranks, ["hex_diff", "hex_digits"]).orderBy("rank", key)
