"""Comparison of model variants: metrics per item, verdicts, sensitivity and summary tables.

All operators take one row per item with both vectors, or two tables joined by the item key, and
compute the pair metrics in one Arrow pass. No operator builds pairs of unrelated items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embedspark.constants import (
    ACCEPTABLE_COSINE,
    IDENTICAL_DIFF,
    MINIMAL_DIFF,
    PERFECT_COSINE,
)
from embedspark.functions.vectors import pair_metrics

METRICS = ("cosine", "l2_distance", "max_abs_diff", "mean_abs_diff")


def with_pair_metrics(df: DataFrame, a: str, b: str, drop: bool = True) -> DataFrame:
    """Adds the metrics of the vectors ``a`` and ``b`` as columns."""
    out = df.withColumn("_m", pair_metrics(a, b)).select(
        *[c for c in df.columns if not drop or c not in (a, b)], "_m.*"
    )
    return out


def compare_variants(
    base: DataFrame, variants: DataFrame, key: str, vector: str, latency: str, *labels: str
) -> DataFrame:
    """Items of both tables with their metrics and the two latencies.

    ``variants`` may hold several rows per item, told apart by the label columns, so that all
    variants meet the base in one join.
    """
    left = base.select(key, F.col(vector).alias("a"), F.col(latency).alias("base_latency"))
    right = variants.select(
        key, *labels, F.col(vector).alias("b"), F.col(latency).alias("variant_latency")
    )
    return with_pair_metrics(left.join(right, key), "a", "b")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def comparison_summary(items: DataFrame, *groups: str) -> DataFrame:
    """Mean, minimum and maximum of every metric plus latency means and speedup."""
    parts = []
    for metric in METRICS:
        parts += [
            F.avg(metric).alias(f"{metric}_mean"),
            F.min(metric).alias(f"{metric}_min"),
            F.max(metric).alias(f"{metric}_max"),
        ]
    return items.groupBy(*groups).agg(
        *parts,
        F.avg("base_latency").alias("base_latency_mean"),
        F.avg("variant_latency").alias("variant_latency_mean"),
        ratio(F.sum("base_latency"), F.sum("variant_latency")).alias("speedup"),
    )


def accuracy_summary(items: DataFrame, *groups: str) -> DataFrame:
    """Mean and maximum of the largest difference, mean and minimum of the cosine."""
    return items.groupBy(*groups).agg(
        F.avg("max_abs_diff").alias("max_diff_mean"),
        F.max("max_abs_diff").alias("max_diff_max"),
        F.avg("cosine").alias("cosine_mean"),
        F.min("cosine").alias("cosine_min"),
    )


def quality_tier(cosine: Column) -> Column:
    """Advice for a mean cosine: above 0.95, from 0.9, below."""
    return (
        F.when(cosine > 0.95, F.lit("very similar"))
        .when(cosine >= 0.9, F.lit("moderate"))
        .otherwise(F.lit("significant"))
    )


def identical(max_diff: Column) -> Column:
    return max_diff < IDENTICAL_DIFF


def batching_verdict(cosine: Column) -> Column:
    """perfect, acceptable or interference, from the lowest or the mean cosine of a batch."""
    return (
        F.when(cosine > PERFECT_COSINE, F.lit("perfect"))
        .when(cosine > ACCEPTABLE_COSINE, F.lit("acceptable"))
        .otherwise(F.lit("interference"))
    )


def by_batch_size(items: DataFrame, pos: str, sizes: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """One row per item and prefix size that contains it; the sizes are a short literal list."""
    options = F.array(*[F.lit(size) for size in sizes])
    return items.withColumn("batch_size", F.explode(F.filter(options, lambda s: s > F.col(pos))))


def by_composition(items: DataFrame, length_class: str, mixes: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per item and place its length class has in a named mix (repeats count again)."""
    entries = []
    for cls in sorted({c for members in mixes.values() for c in members}):
        names = [name for name, members in mixes.items() for c in members if c == cls]
        entries.append((cls, names))
    places = F.create_map(
        *[part for cls, names in entries for part in (F.lit(cls), F.array(*[F.lit(n) for n in names]))]
    )
    return items.withColumn("composition", F.explode(places[F.col(length_class)]))


def orderings(items: DataFrame, group: str, pos: str, *values: str) -> DataFrame:
    """All six orders of every complete group of three: group, ordering, values in that order.

    Positions 0, 1 and 2 become plain columns by a combined hash aggregate, so a group is never
    collected or sorted.
    """

    def at(place: int, value: Column) -> Column:
        return F.max(F.when(F.col(pos) == place, value))

    wide = items.groupBy(group).agg(
        *[at(i, F.lit(1)).alias(f"_seen_{i}") for i in range(3)],
        *[at(i, F.col(v)).alias(f"_{v}_{i}") for i in range(3) for v in values],
    )
    wide = wide.where("_seen_0 + _seen_1 + _seen_2 = 3")

    def member(place: int) -> Column:
        return F.struct(*[F.col(f"_{v}_{place}").alias(v) for v in values])

    # The six orders of three positions.
    orders = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
    rows = [
        F.struct(
            F.lit("-".join(map(str, order))).alias("ordering"),
            F.array(*[member(i) for i in order]).alias("members"),
        )
        for order in orders
    ]
    return wide.select(group, F.explode(F.array(*rows)).alias("o")).select(group, "o.*")


def quantized(vector: Column, step: Column) -> Column:
    """The vector at whole multiples of a step; unchanged where the step is not positive."""
    rounded = F.transform(vector, lambda x: F.floor(x / step + 0.5).cast("double") * step)
    return F.when(step > 0, rounded).otherwise(vector)


def in_batches(vectors: DataFrame, members: DataFrame, key: str, *batch: str, levels: float = 127.0) -> DataFrame:
    """Members of batches with their vector alone (``single``) and as the batch quantizes it (``batched``).

    ``vectors``: the key and ``vector``; ``members``: one row per place of a batch, named by the ``batch`` columns, with
    the key of the item there. An item may stand in many batches, or in one several times. The step alone comes from the
    item's own peak, in a batch from the largest peak of the batch: one combined aggregate over numbers.
    """
    peaked = vectors.select(key, "vector", F.array_max(F.transform("vector", lambda x: F.abs(x))).alias("_peak"))
    rows = members.join(peaked, key)
    steps = members.join(peaked.select(key, "_peak"), key).groupBy(*batch).agg((F.max("_peak") / levels).alias("_step"))
    return rows.join(steps, list(batch)).select(
        *members.columns,
        "vector",
        quantized(F.col("vector"), F.col("_peak") / levels).alias("single"),
        quantized(F.col("vector"), F.col("_step")).alias("batched"),
    )


def cause_verdict(quantized: Column, full: Column) -> Column:
    """Whether quantization explains a difference between single and batched vectors."""
    return (
        F.when(F.abs(quantized - full) < 0.001, F.lit("not the cause"))
        .when(quantized > full * 1.5, F.lit("increases interference"))
        .otherwise(F.lit("mixed"))
    )


def interference_verdict(same_length: Column, different: Column, quantized: Column) -> Column:
    """perfect, minimal, less or similar against the quantized form (1.0 if that is missing)."""
    return (
        F.when((same_length < IDENTICAL_DIFF) & (different < IDENTICAL_DIFF), F.lit("perfect"))
        .when((same_length < MINIMAL_DIFF) & (different < MINIMAL_DIFF), F.lit("minimal"))
        .when(same_length < F.coalesce(quantized, F.lit(1.0)) * 0.5, F.lit("less"))
        .otherwise(F.lit("similar"))
    )


def full_precision_verdict(same_length: Column, different: Column, quantized: Column) -> Column:
    """The same question for the full-precision form, which has no minimal tier."""
    return (
        F.when((same_length < IDENTICAL_DIFF) & (different < IDENTICAL_DIFF), F.lit("perfect"))
        .when(same_length < F.coalesce(quantized, F.lit(1.0)) * 0.5, F.lit("less"))
        .otherwise(F.lit("similar"))
    )


def half_precision_verdict(different: Column) -> Column:
    """One difference, two tiers."""
    return (
        F.when(different < IDENTICAL_DIFF, F.lit("perfect"))
        .when(different < MINIMAL_DIFF, F.lit("minimal"))
        .otherwise(F.lit("significant"))
    )


def metric_matrix(df: DataFrame, variant: str, metrics: list[str], variants: list[str]) -> DataFrame:
    """One row per metric, one column per variant, and the difference of the first two."""
    pairs = ", ".join(f"'{name}', cast({name} as double)" for name in metrics)
    long = df.select(variant, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    wide = long.groupBy("metric").pivot(variant, variants).agg(F.first("value"))
    if len(variants) < 2:
        return wide
    return wide.withColumn("difference", F.abs(F.col(variants[0]) - F.col(variants[1])))
