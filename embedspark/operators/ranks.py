"""Exact order statistics ``sorted[floor(n * q)]`` of groups of any size.

Sorting a group, or collecting its distinct values, would put one endpoint's whole log into one
task. Instead the answer is narrowed down over the data.

``summary_with_ranks`` reads the data twice. The first pass makes all other aggregates of a group and a quantile sketch,
which brackets each wanted value. The second pass counts the values between the brackets as mere numbers and those inside
them (about half a percent of a group for each quantile) by value; a running count over these gives the exact value. Groups come
to the driver, at most ``MAX_GROUPS`` of them and a few numbers each. The counts prove that a value is right; should a bracket
miss, which its width makes next to impossible, that group goes the way of ``rank_values``.

``rank_values`` is for any number of groups: a coarse histogram (logarithmic buckets,
combined before the shuffle) tells which bucket holds the wanted position, a second histogram cuts
that bucket into equal parts, and only the values of one part are put in order. Every pass reads two
columns and shuffles counts; the wanted positions are a small written table that Spark broadcasts
only if its real size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.session import written

_PER_DECADE = 512
_PARTS = 4096
MAX_GROUPS = 10_000
_SKETCH = 4096
#: Three times the rank error (of 99 % confidence) that a sketch of this size has.
_MARGIN = 0.0027


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys in which NULL equals NULL; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{key}" for key in keys])


def _coarse(value: Column) -> Column:
    """Monotone bucket number; a value range of nine decades gives about 10,000 buckets."""
    size = F.floor(F.log1p(F.abs(value)) * (_PER_DECADE / 2.302585))
    return F.when(value < 0, -size - 1).otherwise(size).cast("bigint")


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which of the equal parts of [low, high] a value lies in; monotone in the value."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1)).cast("bigint")


def _containing(histogram: DataFrame, keys: list[str], order: str, position: Column) -> DataFrame:
    """The histogram row per key that holds a 0-based position, and the position inside it."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = histogram.withColumn("_upto", F.sum("n").over(running))
    before = F.col("_upto") - F.col("n")
    return counted.where((before <= position) & (position < F.col("_upto"))).withColumn(
        "position", position - before
    )


def rank_values(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """One row per group with a column per quantile: the value at 0-based index floor(n * q).

    NULL is a group like any other. Groups without a value have no row.
    """
    data = df.select(*groups, F.col(value).cast("double").alias("_v")).where("_v is not null")
    bucketed = data.withColumn("_bucket", _coarse(F.col("_v")))

    coarse = bucketed.groupBy(*groups, "_bucket").agg(
        F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"))
                for name, q in quantiles.items()
            ]
        )
    )
    whole = Window.partitionBy(*groups)
    totals = coarse.withColumn("_total", F.sum("n").over(whole)).withColumn("_q", wanted)
    keys = [*groups, "_q"]
    hit = _containing(totals, keys, "_bucket", F.floor(F.col("_total") * F.col("_q.q")))
    first = written(
        hit.select(*groups, F.col("_q.name").alias("_name"), "_bucket", "_low", "_high", "position")
    )

    keys = [*groups, "_name"]
    parted = null_safe_join(bucketed, first, [*groups, "_bucket"]).withColumn(
        "_place", _part(F.col("_v"), F.col("_low"), F.col("_high"))
    )
    fine = parted.groupBy(*keys, "_bucket", "_low", "_high", "position", "_place").agg(
        F.count("*").alias("n")
    )
    second = written(
        _containing(fine, keys, "_place", F.col("position")).select(
            *keys, "_bucket", "_low", "_high", "_place", "position"
        )
    )

    narrowed = (
        null_safe_join(bucketed, second, [*groups, "_bucket"])
        .where(_part(F.col("_v"), F.col("_low"), F.col("_high")) == F.col("_place"))
        .groupBy(*keys, "position", "_v")
        .agg(F.count("*").alias("n"))
    )
    found = _containing(narrowed, keys, "_v", F.col("position"))
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in quantiles]
    )


def _edges(sketch: Column, quantiles: dict[str, float], margin: float) -> list[Column]:
    """Lower and upper bracket of each quantile; an end of the data needs no bracket."""
    edges = []
    for name, q in quantiles.items():
        low = F.kll_sketch_get_quantile_double(sketch, F.lit(q - margin)) if q > margin else F.lit(float("-inf"))
        high = F.kll_sketch_get_quantile_double(sketch, F.lit(q + margin)) if q + margin < 1 else F.lit(float("inf"))
        edges += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}")]
    return edges


def _exact(data: DataFrame, brackets: DataFrame, groups: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Per group the values at the wanted indices, NULL where a bracket misses. ``brackets`` has at most MAX_GROUPS rows."""
    v, names = F.col("_v"), list(quantiles)
    joined = null_safe_join(data, F.broadcast(brackets), groups)
    # The brackets cut the number line into regions, in ascending order; every region lies inside or outside of each bracket.
    region = sum(((v >= F.col(f"_low_{n}")).cast("int") + (v > F.col(f"_high_{n}")).cast("int") for n in names), F.lit(0))
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"_low_{n}"), F.col(f"_high_{n}")) for n in names])
    counted = joined.groupBy(*groups, "_n", region.alias("_region"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("n"))
    running = Window.partitionBy(*groups).orderBy("_region", "_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("n").over(running))

    def value_at(q: float) -> Column:
        index = F.floor(F.col("_n") * F.lit(float(q)))
        return F.max(F.when((F.col("_upto") > index) & (F.col("_upto") - F.col("n") <= index), v))

    return placed.groupBy(*groups).agg(*[value_at(q).alias(name) for name, q in quantiles.items()])


def summary_with_ranks(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], aggregates: list[Column], margin: float = _MARGIN
) -> DataFrame:
    """One row per group: the aggregates, and per quantile the value at 0-based index floor(n * q) of its n values.

    NULL is a group like any other. Groups without a value have NULL quantiles.
    """
    spark, number = df.sparkSession, F.col(value).cast("double")
    sketched = df.groupBy(*groups).agg(
        *aggregates, F.count(number).alias("_n"), F.kll_sketch_agg_double(number, _SKETCH).alias("_sketch")
    )
    plain = [c for c in sketched.columns if c not in ("_n", "_sketch")]
    sketch = F.when(F.col("_n") > 0, F.col("_sketch"))
    first = sketched.select(*plain, "_n", *_edges(sketch, quantiles, margin))
    rows = first.take(MAX_GROUPS + 1)
    if len(rows) > MAX_GROUPS:
        return null_safe_join(df.groupBy(*groups).agg(*aggregates), rank_values(df, groups, value, quantiles), groups, "left")
    counts = spark.createDataFrame(rows, first.schema)
    data = df.select(*groups, number.alias("_v")).where("_v is not null")
    brackets = counts.where("_n > 0").drop(*[c for c in plain if c not in groups])
    exact = _exact(data, brackets, groups, quantiles)
    found = exact.collect()  # a row per group
    missed = [r for r in found if None in tuple(r)[len(groups) :]]
    if missed:
        keys = spark.createDataFrame([tuple(r)[: len(groups)] for r in missed], exact.select(*groups).schema)
        again = rank_values(null_safe_join(df, F.broadcast(keys), groups, "left_semi"), groups, value, quantiles)
        found = [r for r in found if r not in missed] + again.collect()
    return null_safe_join(counts.select(*plain), spark.createDataFrame(found, exact.schema), groups, "left")
