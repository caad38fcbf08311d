"""Registered queries on vectors, model variants and similarity search."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Window, functions as F

from embedspark.functions import vectors
from embedspark.operators import pivot_search, search, variants as ops
from embedspark.operators.text import embed_texts
from embedspark.operators.encoders import HashingTextEncoder
from embedspark.plans.fixtures import VARIANTS_SQL, hashed_sql, table, variants, wide_table
from embedspark.plans.registry import query, r6, s6

# SQL for the metrics of two DOUBLE[] columns.
GAPS = "list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2]))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def metrics_sql(a: str, b: str) -> dict[str, str]:
    gaps = GAPS.format(a=a, b=b)
    lengths = f"({norm_sql(a)} * {norm_sql(b)})"
    return {
        "cosine": f"CASE WHEN {lengths} = 0 THEN 0 ELSE {dot_sql(a, b)} / {lengths} END",
        "l2_distance": f"sqrt(list_sum(list_transform({gaps}, lambda x: x * x)))",
        "max_abs_diff": f"list_max({gaps})",
        "mean_abs_diff": f"list_sum({gaps}) / len({a})",
        "dims_over": f"len(list_filter({gaps}, lambda x: x > 0.001))",
        "width": f"len({a})",
    }


def metric_columns(a: str, b: str, *names: str) -> str:
    sql = metrics_sql(a, b)
    return ", ".join(f"{sql[name]} AS {name}" for name in names)


FOUR = ("cosine", "l2_distance", "max_abs_diff", "mean_abs_diff")


# Every vector with the next one in id order: pairs of different items without a pair explosion.
NEIGHBOURS_SQL = """neighbours AS (
  SELECT a.vec_id, a.embedding::DOUBLE[] AS a,
    CASE WHEN a.vec_id % 11 = 0 THEN list_transform(b.embedding, lambda x: 0.0::DOUBLE)
      ELSE b.embedding::DOUBLE[] END AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def neighbours(spark, sf_dir):
    """Pairs (item, next item); every eleventh partner is a zero vector to use the guard."""
    a = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a")
    )
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    zero = F.transform("b", lambda x: F.lit(0.0))
    return a.join(b, "vec_id").withColumn(
        "b", F.when(F.col("vec_id") % 11 == 0, zero).otherwise(F.col("b"))
    )


@query(
    "v1_v5_pair_metrics",
    f"""WITH {NEIGHBOURS_SQL}, m AS (SELECT vec_id, {metric_columns("a", "b", *FOUR)} FROM neighbours)
SELECT vec_id, {", ".join(f"{s6(name)} AS {name}" for name in FOUR)} FROM m""",
)
def pair_metrics_query(spark, sf_dir):
    """Cosine, L2, largest and mean difference of the pairs in one Arrow pass."""
    rows = ops.with_pair_metrics(neighbours(spark, sf_dir), "a", "b")
    return rows.select("vec_id", *[r6(name).alias(name) for name in FOUR])


@query(
    "v1_cosine",
    f"""WITH {NEIGHBOURS_SQL}, m AS (SELECT vec_id, {metric_columns("a", "b", "cosine")} FROM neighbours)
SELECT vec_id, {s6("cosine")} AS cosine FROM m""",
)
def cosine_query(spark, sf_dir):
    """The JVM-side expression."""
    return neighbours(spark, sf_dir).select("vec_id", r6(vectors.cosine("a", "b")).alias("cosine"))


@query(
    "v2_dot_as_cosine",
    f"""WITH {NEIGHBOURS_SQL} SELECT vec_id, {s6(dot_sql("a", "b"))} AS dot FROM neighbours""",
)
def dot_query(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", r6(vectors.dot("a", "b")).alias("dot"))


@query(
    "v3_v5_distances",
    f"""WITH {NEIGHBOURS_SQL}, m AS (SELECT vec_id, {metric_columns("a", "b", *FOUR[1:])} FROM neighbours)
SELECT vec_id, {", ".join(f"{s6(name)} AS {name}" for name in FOUR[1:])} FROM m""",
)
def distances_query(spark, sf_dir):
    """The JVM-side expressions."""
    return neighbours(spark, sf_dir).select(
        "vec_id",
        r6(vectors.l2_distance("a", "b")).alias("l2_distance"),
        r6(vectors.max_abs_diff("a", "b")).alias("max_abs_diff"),
        r6(vectors.mean_abs_diff("a", "b")).alias("mean_abs_diff"),
    )


@query(
    "v6_dims_over_threshold",
    f"""WITH {VARIANTS_SQL}, m AS (SELECT vec_id, {metric_columns("fp32", "int8", "dims_over", "width")} FROM variants)
SELECT vec_id, dims_over, {s6("100.0 * dims_over / width", 4)} AS percent FROM m""",
)
def dims_over_query(spark, sf_dir):
    over = vectors.dims_over("fp32", "int8")
    return variants(spark, sf_dir).select(
        "vec_id",
        over.cast("bigint").alias("dims_over"),
        r6(over * 100.0 / F.size("fp32"), 4).alias("percent"),
    )


@query(
    "v7_diff_distribution",
    f"""WITH {VARIANTS_SQL}, d AS (SELECT vec_id, unnest({GAPS.format(a="fp32", b="int8")}) AS d FROM variants)
SELECT vec_id, {s6("min(d)")} AS min, {s6("quantile_cont(d, 0.5)")} AS p50,
  {s6("quantile_cont(d, 0.95)")} AS p95, {s6("quantile_cont(d, 0.99)")} AS p99, {s6("max(d)")} AS max
FROM d GROUP BY vec_id""",
)
def diff_distribution(spark, sf_dir):
    """Linear-interpolated percentiles of the differences of one pair, from its sorted array."""
    gaps = F.array_sort(vectors.abs_diffs("fp32", "int8"))
    rows = variants(spark, sf_dir).select("vec_id", gaps.alias("d"))

    def at(q: float):
        place = (F.size("d") - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a = F.element_at("d", low + 1)
        b = F.element_at("d", F.least(low + 2, F.size("d")))
        return a + (b - a) * (place - low)

    return rows.select(
        "vec_id",
        r6(F.array_min("d")).alias("min"),
        r6(at(0.5)).alias("p50"),
        r6(at(0.95)).alias("p95"),
        r6(at(0.99)).alias("p99"),
        r6(F.array_max("d")).alias("max"),
    )


# Latencies of the variants come from the whole request log: each event belongs to a vector, round and round.
LATENCY_SQL = """latency AS (
  SELECT event_id % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id, avg(value) AS base_latency,
    avg(value * (1 + event_id % 3) / 2) AS variant_latency FROM events GROUP BY 1)"""


def compared(spark, sf_dir, *names):
    """Items with metrics and mean latencies of the named variants against the exact form."""
    rows = variants(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    width = (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    timed = events.groupBy((F.col("event_id") % width).alias("vec_id")).agg(
        F.avg("value").alias("base_latency"),
        F.avg(F.col("value") * (1 + F.col("event_id") % 3) / 2).alias("variant_latency"),
    )
    rows = rows.join(timed, "vec_id")
    base = rows.select("vec_id", F.col("fp32").alias("vector"), F.col("base_latency").alias("latency"))
    forms = F.explode(
        F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("vector")) for n in names])
    )
    slower = F.col("variant_latency").alias("latency")
    others = rows.select("vec_id", slower, forms.alias("f")).select("vec_id", "latency", "f.*")
    return ops.compare_variants(base, others, "vec_id", "vector", "latency", "variant")


def summary_sql(variant: str) -> str:
    parts = []
    for name in FOUR:
        for function, suffix in (("avg", "mean"), ("min", "min"), ("max", "max")):
            parts.append(f"{s6(f'{function}({name})')} AS {name}_{suffix}")
    return f"""SELECT '{variant}' AS variant, {", ".join(parts)},
  {s6("avg(base_latency)", 4)} AS base_latency_mean, {s6("avg(variant_latency)", 4)} AS variant_latency_mean,
  {s6("CASE WHEN sum(variant_latency) > 0 THEN sum(base_latency) / sum(variant_latency) ELSE 0 END")} AS speedup
FROM (SELECT vec_id, {metric_columns("fp32", variant, *FOUR)}, base_latency, variant_latency
      FROM variants JOIN latency USING (vec_id))"""


@query(
    "v8_variant_compare",
    f"""WITH {VARIANTS_SQL}, {LATENCY_SQL}, m AS (
  SELECT vec_id, {metric_columns("fp32", "int8", *FOUR)}, base_latency, variant_latency
  FROM variants JOIN latency USING (vec_id))
SELECT vec_id, {", ".join(f"{s6(name)} AS {name}" for name in FOUR)},
  {s6("base_latency", 7)} AS base_latency, {s6("variant_latency", 7)} AS variant_latency FROM m""",
)
def variant_compare(spark, sf_dir):
    rows = compared(spark, sf_dir, "int8")
    return rows.select(
        "vec_id",
        *[r6(name).alias(name) for name in FOUR],
        r6("base_latency", 7).alias("base_latency"),
        r6("variant_latency", 7).alias("variant_latency"),
    )


@query(
    "v8_v9_variant_summary",
    f"""WITH {VARIANTS_SQL}, {LATENCY_SQL}
{summary_sql("fp16")} UNION ALL {summary_sql("int8")} UNION ALL {summary_sql("int8_batched")}""",
)
def variant_summary(spark, sf_dir):
    """Summary of every variant and its speedup."""
    rows = compared(spark, sf_dir, "fp16", "int8", "int8_batched")
    summary = ops.comparison_summary(rows, "variant")
    latency = {"base_latency_mean", "variant_latency_mean"}
    return summary.select(
        "variant",
        *[r6(c, 4 if c in latency else 6).alias(c) for c in summary.columns if c != "variant"],
    )


@query(
    "v10_quality_tier",
    f"""WITH {NEIGHBOURS_SQL}, {VARIANTS_SQL}, mixed AS (
  SELECT vec_id, v.fp32 AS a, list_transform(list_zip(v.fp32, n.b), lambda p: p[1] + p[2] * (vec_id % 10) / 10) AS b
  FROM variants v JOIN neighbours n USING (vec_id)),
m AS (SELECT vec_id, {metric_columns("a", "b", "cosine")} FROM mixed)
SELECT vec_id, {s6("cosine")} AS cosine, CASE WHEN cosine > 0.95 THEN 'very similar'
  WHEN cosine >= 0.9 THEN 'moderate' ELSE 'significant' END AS tier FROM m""",
)
def quality_tiers(spark, sf_dir):
    """Tiers of vectors mixed with a growing share of their neighbour."""
    share = (F.col("vec_id") % 10) / 10
    mixed = neighbours(spark, sf_dir).withColumn("b", F.zip_with("a", "b", lambda x, y: x + y * share))
    rows = ops.with_pair_metrics(mixed, "a", "b")
    return rows.select(
        "vec_id", r6("cosine").alias("cosine"), ops.quality_tier(F.col("cosine")).alias("tier")
    )


@query(
    "v11_interference",
    f"""WITH {VARIANTS_SQL}, m AS (SELECT vec_id, {metric_columns("int8", "int8_batched", "cosine", "max_abs_diff")} FROM variants)
SELECT vec_id, {s6("max_abs_diff")} AS max_abs_diff, {s6("cosine")} AS cosine,
  max_abs_diff < 1e-4 AS identical FROM m""",
)
def interference(spark, sf_dir):
    """The same item alone and in a batch of four."""
    rows = ops.with_pair_metrics(variants(spark, sf_dir), "int8", "int8_batched")
    return rows.select(
        "vec_id",
        r6("max_abs_diff").alias("max_abs_diff"),
        r6("cosine").alias("cosine"),
        ops.identical(F.col("max_abs_diff")).alias("identical"),
    )


@query(
    "v12_verdict_tiers",
    f"""WITH {VARIANTS_SQL}, m AS (SELECT vec_id // 4 AS batch_id, {metric_columns("int8", "int8_batched", "cosine")} FROM variants),
g AS (SELECT batch_id, min(cosine) AS lowest, avg(cosine) AS mean FROM m GROUP BY batch_id)
SELECT batch_id, {s6("lowest")} AS lowest, {s6("mean")} AS mean,
  CASE WHEN lowest > 0.9999 THEN 'perfect' WHEN lowest > 0.98 THEN 'acceptable' ELSE 'interference' END AS all_items,
  CASE WHEN mean > 0.9999 THEN 'perfect' WHEN mean > 0.98 THEN 'acceptable' ELSE 'interference' END AS on_average
FROM g""",
)
def verdict_tiers(spark, sf_dir):
    rows = ops.with_pair_metrics(variants(spark, sf_dir), "int8", "int8_batched")
    batches = rows.groupBy(F.expr("vec_id div 4").alias("batch_id")).agg(
        F.min("cosine").alias("lowest"), F.avg("cosine").alias("mean")
    )
    return batches.select(
        "batch_id",
        r6("lowest").alias("lowest"),
        r6("mean").alias("mean"),
        ops.batching_verdict(F.col("lowest")).alias("all_items"),
        ops.batching_verdict(F.col("mean")).alias("on_average"),
    )


# Vectors in batches that a relation of members names: an item alone, and with the step of its actual batch.
EXACT_SQL = """exact AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
    list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings)"""


def quantized_sql(vector: str, step: str) -> str:
    return f"CASE WHEN {step} > 0 THEN list_transform({vector}, lambda x: floor(x / {step} + 0.5) * {step}) ELSE {vector} END"


def in_batches_sql(members: str, *batch: str) -> str:
    """``placed``: the rows of a table of members with ``v``, ``single`` and ``batched``."""
    keys = ", ".join(batch)
    return f"""steps AS (SELECT {keys}, max(peak) / 127.0::DOUBLE AS step FROM {members} JOIN exact USING (vec_id) GROUP BY {keys}),
placed AS (SELECT m.*, e.v, {quantized_sql("e.v", "(e.peak / 127.0::DOUBLE)")} AS single, {quantized_sql("e.v", "s.step")} AS batched
  FROM {members} m JOIN exact e USING (vec_id) JOIN steps s USING ({keys}))"""


def exact_vectors(spark, sf_dir):
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vector)


def batch_metrics(spark, sf_dir, members, *batch):
    """Metrics between the vector alone and in its batch."""
    rows = ops.in_batches(exact_vectors(spark, sf_dir).drop("label"), members, "vec_id", *batch)
    return ops.with_pair_metrics(rows, "single", "batched")


@query(
    "v13_batch_size_sensitivity",
    f"""WITH {EXACT_SQL}, members AS (SELECT vec_id, vec_id // 8 AS grp, batch_size FROM exact
  JOIN (SELECT unnest([1, 2, 4, 8]) AS batch_size) s ON vec_id % 8 < batch_size),
{in_batches_sql("members", "grp", "batch_size")},
m AS (SELECT batch_size, {metric_columns("single", "batched", "cosine", "max_abs_diff")} FROM placed)
SELECT batch_size::INT AS batch_size, {s6("max(max_abs_diff)")} AS max_diff, {s6("avg(cosine)")} AS mean_cosine,
  count(*) AS members FROM m GROUP BY batch_size""",
)
def batch_size_sensitivity(spark, sf_dir):
    """Groups of eight by id; size n is the batch of the first n of every group."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 8").alias("grp"), (F.col("vec_id") % 8).alias("pos"))
    members = ops.by_batch_size(items, "pos").drop("pos")
    return batch_metrics(spark, sf_dir, members, "grp", "batch_size").groupBy("batch_size").agg(
        r6(F.max("max_abs_diff")).alias("max_diff"), r6(F.avg("cosine")).alias("mean_cosine"), F.count("*").alias("members")
    )


# Every multiset of three length classes, named by its members.
MIXES = {
    " + ".join(members): members for members in combinations_with_replacement(("short", "medium", "very_long"), 3)
}
MIXES_SQL = ", ".join(
    f"('{name}', '{member}')" for name, members in MIXES.items() for member in members
)


CLASS_SQL = "CASE WHEN label < 3 THEN 'short' WHEN label < 6 THEN 'medium' ELSE 'very_long' END"


@query(
    "v14_composition_sensitivity",
    f"""WITH {EXACT_SQL}, firsts AS (SELECT vec_id // 16 AS grp, {CLASS_SQL} AS length_class, min(vec_id) AS vec_id FROM exact GROUP BY ALL),
possible AS (SELECT grp, composition, vec_id, count(*) OVER (PARTITION BY grp, composition) AS found
  FROM firsts JOIN (VALUES {MIXES_SQL}) AS x(composition, length_class) USING (length_class)),
members AS (SELECT grp, composition, vec_id FROM possible WHERE found = 3),
{in_batches_sql("members", "grp", "composition")},
m AS (SELECT composition, {metric_columns("single", "batched", "cosine", "max_abs_diff")} FROM placed)
SELECT composition, {s6("max(max_abs_diff)")} AS max_diff, {s6("avg(cosine)")} AS mean_cosine, count(*) AS places
FROM m GROUP BY composition""",
)
def composition_sensitivity(spark, sf_dir):
    """Every mix of three length classes as a batch, out of the first items of each class among sixteen."""
    label = F.col("label")
    cls = F.when(label < 3, "short").when(label < 6, "medium").otherwise("very_long")
    firsts = (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.expr("vec_id div 16").alias("grp"), cls.alias("length_class"))
        .agg(F.min("vec_id").alias("vec_id"))
    )
    places = ops.by_composition(firsts, "length_class", MIXES).drop("length_class")
    found = F.count("*").over(Window.partitionBy("grp", "composition"))
    members = places.withColumn("found", found).where("found = 3").drop("found")
    return batch_metrics(spark, sf_dir, members, "grp", "composition").groupBy("composition").agg(
        r6(F.max("max_abs_diff")).alias("max_diff"), r6(F.avg("cosine")).alias("mean_cosine"), F.count("*").alias("places")
    )


@query(
    "v15_ordering_sensitivity",
    f"""WITH {EXACT_SQL}, i AS (SELECT vec_id, vec_id // 3 AS triple, vec_id % 3 AS pos FROM exact),
orders AS (SELECT a.triple, a.pos || '-' || b.pos || '-' || c.pos AS ordering, unnest([a.vec_id, b.vec_id, c.vec_id]) AS vec_id
  FROM i a JOIN i b ON a.triple = b.triple AND a.pos <> b.pos
  JOIN i c ON a.triple = c.triple AND c.pos <> a.pos AND c.pos <> b.pos),
{in_batches_sql("orders", "triple", "ordering")},
m AS (SELECT triple, ordering, {metric_columns("single", "batched", "max_abs_diff")} FROM placed),
o AS (SELECT triple, ordering, max(max_abs_diff) AS max_diff FROM m GROUP BY triple, ordering)
SELECT triple, count(*) AS orderings, {s6("max(max_diff)")} AS max_diff,
  {s6("var_pop(max_diff)", 10)} AS variance, var_pop(max_diff) < 1e-10 AS unaffected FROM o GROUP BY triple""",
)
def ordering_sensitivity(spark, sf_dir):
    """Every three items in all six orders as batches: the step does not depend on the order, so nothing varies."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("triple"), (F.col("vec_id") % 3).alias("pos"))
    orders = ops.orderings(items, "triple", "pos", "vec_id")
    members = orders.select("triple", "ordering", F.explode("members.vec_id").alias("vec_id"))
    worst = batch_metrics(spark, sf_dir, members, "triple", "ordering").groupBy("triple", "ordering").agg(F.max("max_abs_diff").alias("max_diff"))
    return worst.groupBy("triple").agg(
        F.count("*").alias("orderings"),
        r6(F.max("max_diff")).alias("max_diff"),
        r6(F.var_pop("max_diff"), 10).alias("variance"),
        (F.var_pop("max_diff") < 1e-10).alias("unaffected"),
    )


@query(
    "v16_unit_norm_check",
    f"""WITH n AS (SELECT vec_id, {norm_sql("list_transform(embedding, lambda x: x::DOUBLE * (1 + (vec_id % 4) * 0.002::DOUBLE))")} AS norm FROM embeddings)
SELECT vec_id, {s6("norm")} AS norm, abs(norm - 1) < 1e-4 AS strict, abs(norm - 1) < 1e-2 AS lenient FROM n""",
)
def unit_norm_check(spark, sf_dir):
    """Lengths after stretching by up to 0.6 percent, under both tolerances."""
    stretch = 1 + (F.col("vec_id") % 4) * F.lit(0.002)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        vectors.norm(F.transform("embedding", lambda x: x.cast("double") * stretch)).alias("norm"),
    )
    gap = F.abs(F.col("norm") - 1)
    return rows.select(
        "vec_id",
        r6("norm").alias("norm"),
        (gap < 1e-4).alias("strict"),
        (gap < 1e-2).alias("lenient"),
    )


@query(
    "v17_distinctness",
    """WITH b AS (SELECT vec_id // 8 AS batch_id, vec_id % 8 AS pos,
    CASE WHEN vec_id // 8 % 5 = 0 THEN list_transform(embedding, lambda x: 0.125::DOUBLE)
      ELSE embedding::DOUBLE[] END AS v FROM embeddings)
SELECT o.batch_id, bool_or(list_sum(list_transform(list_zip(f.v, o.v), lambda p: abs(p[1] - p[2]))) > 0.01) AS distinct_vectors
FROM b o JOIN b f ON f.batch_id = o.batch_id AND f.pos = 0 GROUP BY o.batch_id""",
)
def distinctness(spark, sf_dir):
    """Per batch of eight: does any vector differ from the first one? Every fifth batch is constant."""
    constant = F.transform("embedding", lambda x: F.lit(0.125))
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 8").alias("batch_id"),
        (F.col("vec_id") % 8).alias("pos"),
        F.when(F.expr("vec_id div 8 % 5 = 0"), constant)
        .otherwise(F.transform("embedding", lambda x: x.cast("double")))
        .alias("v"),
    )
    firsts = rows.where("pos = 0").select("batch_id", F.col("v").alias("first"))
    compared_rows = ops.with_pair_metrics(rows.join(firsts, "batch_id"), "first", "v")
    return compared_rows.groupBy("batch_id").agg(
        F.bool_or(F.col("l1_distance") > 0.01).alias("distinct_vectors")
    )


@query(
    "v18_unrelated_baseline",
    f"""WITH {NEIGHBOURS_SQL}, m AS (SELECT {metric_columns("a", "b", *FOUR, "dims_over")} FROM neighbours)
SELECT count(*) AS pairs, {", ".join(f"{s6(f'avg({name})')} AS {name}" for name in FOUR)},
  {s6("avg(dims_over)", 4)} AS dims_over FROM m""",
)
def unrelated_baseline(spark, sf_dir):
    """Mean metrics between different items: each with the next one."""
    rows = ops.with_pair_metrics(neighbours(spark, sf_dir), "a", "b")
    return rows.agg(
        F.count("*").alias("pairs"),
        *[r6(F.avg(name)).alias(name) for name in FOUR],
        r6(F.avg("dims_over"), 4).alias("dims_over"),
    )


SEARCH_WIDTH = 256
SEARCH_SQL = f"""{hashed_sql("documents", "doc_id", "text", SEARCH_WIDTH, SEARCH_WIDTH, "docs", "search_document")},
{hashed_sql("benchmark", "item_id", "text", SEARCH_WIDTH, SEARCH_WIDTH, "q", "search_query")},
scores AS (
  SELECT q.item_id AS query_id, d.doc_id AS item_id,
    round(list_inner_product(q.v, d.v), 6) + 0.0 AS score FROM q, docs d)"""


def search_vectors(spark, sf_dir, dim=None):
    encoder = HashingTextEncoder(SEARCH_WIDTH)
    queries = embed_texts(table(spark, sf_dir, "benchmark"), "text", encoder=encoder, dim=dim)
    corpus = embed_texts(
        wide_table(spark, sf_dir, "documents"),
        "text",
        encoder=encoder,
        prefix=F.lit("search_document"),
        dim=dim,
    )
    return queries, corpus


@query(
    "v20_topk_neighbors",
    f"""WITH {SEARCH_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores)
SELECT query_id, rank::INT AS rank, item_id, score FROM ranked WHERE rank <= 5""",
)
def topk_neighbors(spark, sf_dir):
    """The five documents most similar to every benchmark text."""
    queries, corpus = search_vectors(spark, sf_dir)
    return search.top_k_neighbors(queries, corpus, 5, "item_id", "doc_id")


@query(
    "v20_rank_agreement",
    f"""WITH {SEARCH_SQL}, short AS (
  SELECT q.item_id AS query_id, d.doc_id AS item_id,
    round(list_inner_product(q.v[1:64], d.v[1:64]), 6) + 0.0 AS score FROM q, docs d),
full_top AS (SELECT query_id, item_id FROM scores
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10),
short_top AS (SELECT query_id, item_id FROM short
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10)
SELECT f.query_id, {s6("count(s.item_id) / 10.0")} AS overlap
FROM full_top f LEFT JOIN short_top s USING (query_id, item_id) GROUP BY f.query_id""",
)
def rank_agreement(spark, sf_dir):
    """Share of common documents among the ten best, full width against 64 dimensions."""
    full = search.top_k_neighbors(*search_vectors(spark, sf_dir), 10, "item_id", "doc_id")
    short = search.top_k_neighbors(*search_vectors(spark, sf_dir, 64), 10, "item_id", "doc_id")
    return search.overlap_at_k(full, short, 10).select("query_id", r6("overlap").alias("overlap"))


NEAREST_SQL = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id,
    round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings c)"""


def pruned_neighbors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return pivot_search.pruned_top_k(rows, rows, 5, "vec_id", "vec_id", cell_rows=256)


@query(
    "v20_pruned_topk",
    f"""WITH {NEAREST_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, item_id, score FROM ranked WHERE rank <= 5""",
)
def pruned_topk(spark, sf_dir):
    """The five vectors nearest to each vector, visiting only cells that can hold one of them."""
    return pruned_neighbors(spark, sf_dir)[0]


@query("v20_pruned_visits")
def pruned_visits(spark, sf_dir):
    """How many of the cells that search visited for each vector."""
    return pruned_neighbors(spark, sf_dir)[1]


@query(
    "v19_cross_modal_pairs",
    f"""WITH {hashed_sql("documents", "doc_id", "text", 64, 64, "docs", "search_query")}
SELECT d.doc_id, e.vec_id, {s6("list_inner_product(d.v, e.embedding::DOUBLE[])")} AS similarity
FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT max(vec_id) + 1 FROM embeddings)""",
)
def cross_modal_pairs(spark, sf_dir):
    """Every text vector times its image vector in one 64-wide space; the embeddings play the images, round and round."""
    image = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("image_vector"))
    width = (image.agg(F.max("vec_id")).first()[0] or 0) + 1
    docs = wide_table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % width).alias("vec_id"))
    # Only texts with an image are encoded; the join moves ids and vectors, or nothing if the images are few.
    texts = embed_texts(docs.join(image, "vec_id"), "text", encoder=HashingTextEncoder(64))
    return texts.select("doc_id", "vec_id", r6(vectors.dot("embedding", "image_vector")).alias("similarity"))


@query(
    "v19_cross_modal_topk",
    f"""WITH {hashed_sql("benchmark", "item_id", "text", 64, 64, "q", "search_query")},
scores AS (SELECT q.item_id AS query_id, e.vec_id AS item_id,
  round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, embeddings e)
SELECT query_id, rank::INT AS rank, item_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scores)
WHERE rank <= 3""",
)
def cross_modal_topk(spark, sf_dir):
    """The three images nearest to every text."""
    texts = embed_texts(table(spark, sf_dir, "benchmark"), "text", encoder=HashingTextEncoder(64))
    image = table(spark, sf_dir, "embeddings")
    return search.top_k_neighbors(texts, image, 3, "item_id", "vec_id")


# Single against batched for each precision; only the quantized form changes in a batch.
LONG_SQL = f"""{VARIANTS_SQL}, long AS (
  SELECT vec_id, 'fp32' AS variant, fp32 AS a, fp32 AS b FROM variants
  UNION ALL SELECT vec_id, 'fp16', fp16, fp16 FROM variants
  UNION ALL SELECT vec_id, 'int8', int8, int8_batched FROM variants),
m AS (SELECT vec_id, variant, {metric_columns("a", "b", *FOUR)} FROM long)"""


def single_and_batched(spark, sf_dir):
    """vec_id, variant and the metrics between the single and the batched vector."""
    forms = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("variant"), F.col(a).alias("a"), F.col(b).alias("b"))
                for name, a, b in (
                    ("fp32", "fp32", "fp32"),
                    ("fp16", "fp16", "fp16"),
                    ("int8", "int8", "int8_batched"),
                )
            ]
        )
    )
    rows = variants(spark, sf_dir).select("vec_id", forms.alias("f")).select("vec_id", "f.*")
    return ops.with_pair_metrics(rows, "a", "b")


@query(
    "v21_cause_verdict",
    f"""WITH {LONG_SQL}
SELECT q.vec_id, {s6("q.max_abs_diff")} AS quantized, {s6("f.max_abs_diff")} AS full_precision,
  CASE WHEN abs(q.max_abs_diff - f.max_abs_diff) < 0.001 THEN 'not the cause'
    WHEN q.max_abs_diff > f.max_abs_diff * 1.5 THEN 'increases interference' ELSE 'mixed' END AS verdict
FROM m q JOIN m f ON f.vec_id = q.vec_id AND f.variant = 'fp32' WHERE q.variant = 'int8'""",
)
def cause_verdict_query(spark, sf_dir):
    rows = single_and_batched(spark, sf_dir)
    wide = rows.groupBy("vec_id").agg(
        F.max(F.when(F.col("variant") == "int8", F.col("max_abs_diff"))).alias("q"),
        F.max(F.when(F.col("variant") == "fp32", F.col("max_abs_diff"))).alias("f"),
    )
    return wide.select(
        "vec_id",
        r6("q").alias("quantized"),
        r6("f").alias("full_precision"),
        ops.cause_verdict(F.col("q"), F.col("f")).alias("verdict"),
    )


@query(
    "v22_variant_interference_table",
    f"""WITH {LONG_SQL}
SELECT vec_id // 2 AS pair_id, variant,
  {s6("max(CASE WHEN vec_id % 2 = 0 THEN max_abs_diff END)")} AS diff_1,
  {s6("max(CASE WHEN vec_id % 2 = 1 THEN max_abs_diff END)")} AS diff_2,
  {s6("max(CASE WHEN vec_id % 2 = 0 THEN cosine END)")} AS cosine_1,
  {s6("max(CASE WHEN vec_id % 2 = 1 THEN cosine END)")} AS cosine_2
FROM m GROUP BY pair_id, variant""",
)
def variant_interference_table(spark, sf_dir):
    """Per pair of items and variant: difference and cosine of item 1 and 2 as columns."""
    rows = single_and_batched(spark, sf_dir).withColumns(
        {"pair_id": F.expr("vec_id div 2"), "item": (F.col("vec_id") % 2 + 1).cast("string")}
    )
    wide = (
        rows.groupBy("pair_id", "variant")
        .pivot("item", ["1", "2"])
        .agg(F.max("max_abs_diff").alias("diff"), F.max("cosine").alias("cosine"))
    )
    return wide.select(
        "pair_id",
        "variant",
        *[r6(f"{i}_{name}").alias(f"{name}_{i}") for name in ("diff", "cosine") for i in (1, 2)],
    )


@query(
    "v23_precision_comparison",
    f"""WITH {EXACT_SQL}, kinds AS (SELECT unnest(['same', 'same', 'different', 'different', 'large', 'large', 'large', 'large']) AS kind,
    unnest([0, 1, 0, 1, 0, 1, 2, 3]) AS place, unnest([0, 0, 0, 1, 0, 1, 2, 3]) AS pos),
members AS (SELECT vec_id, vec_id // 4 AS grp, kind, place FROM exact JOIN kinds ON vec_id % 4 = pos),
{in_batches_sql("members", "grp", "kind")},
long AS (SELECT grp, kind, place, 'fp32' AS variant, v AS a, v AS b FROM placed
  UNION ALL SELECT grp, kind, place, 'fp16', list_transform(v, lambda x: floor(x * 1000 + 0.5) / 1000), list_transform(v, lambda x: floor(x * 1000 + 0.5) / 1000) FROM placed
  UNION ALL SELECT grp, kind, place, 'int8', single, batched FROM placed),
m AS (SELECT grp, kind, place, variant, b, {metric_columns("a", "b", "cosine", "max_abs_diff")} FROM long),
twins AS (SELECT variant, max(list_max(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2])))) AS between
  FROM m x JOIN m y USING (grp, variant) WHERE x.kind = 'same' AND y.kind = 'same' AND x.place = 0 AND y.place = 1 GROUP BY variant)
SELECT variant AS precision, {s6("max(max_abs_diff) FILTER (kind = 'same' AND place = 0)")} AS same_text_diff_1,
  {s6("max(max_abs_diff) FILTER (kind = 'same' AND place = 1)")} AS same_text_diff_2, {s6("any_value(between)")} AS same_text_between,
  max(max_abs_diff) FILTER (kind = 'same') < 1e-4 AND any_value(between) < 1e-4 AS same_text_identical,
  {s6("max(max_abs_diff) FILTER (kind = 'different' AND place = 0)")} AS different_text_diff_1,
  {s6("max(max_abs_diff) FILTER (kind = 'different' AND place = 1)")} AS different_text_diff_2,
  {s6("avg(cosine) FILTER (kind = 'different' AND place = 0)")} AS different_text_cos_1,
  {s6("avg(cosine) FILTER (kind = 'different' AND place = 1)")} AS different_text_cos_2,
  {s6("max(max_abs_diff) FILTER (kind = 'large')")} AS large_batch_diff, {s6("avg(cosine) FILTER (kind = 'large')")} AS large_batch_cos,
  CASE WHEN max(max_abs_diff) FILTER (kind = 'different') < 1e-4 THEN 'perfect'
    WHEN max(max_abs_diff) FILTER (kind = 'different') < 0.01 THEN 'minimal' ELSE 'significant' END AS verdict
FROM m JOIN twins USING (variant) GROUP BY variant""",
)
def precision_comparison(spark, sf_dir):
    """Each precision alone against batches of the same item twice, of two items and of four."""
    places = (("same", ((0, 0), (1, 0))), ("different", ((0, 0), (1, 1))), ("large", tuple((i, i) for i in range(4))))
    at = {pos: [(kind, place) for kind, own in places for place, p in own if p == pos] for pos in range(4)}
    slots = F.create_map(
        *[x for pos, own in at.items() for x in (F.lit(pos).cast("bigint"), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("place")) for k, p in own]))]
    )
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("grp"), F.explode(slots[F.col("vec_id") % 4]).alias("slot"))
    members = items.select("vec_id", "grp", "slot.*")
    rows = ops.in_batches(exact_vectors(spark, sf_dir).drop("label"), members, "vec_id", "grp", "kind")
    half = F.transform("vector", lambda x: F.floor(x * 1000 + 0.5).cast("double") / 1000)
    pairs = (("fp32", F.col("vector"), F.col("vector")), ("fp16", half, half), ("int8", F.col("single"), F.col("batched")))
    forms = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), a.alias("a"), b.alias("b")) for n, a, b in pairs]))
    long = rows.select("grp", "kind", "place", forms.alias("f")).select("grp", "kind", "place", "f.*")
    measured = ops.with_pair_metrics(long.withColumn("form", F.col("b")), "a", "b")
    # The two copies of one item in their batch, side by side.
    same = measured.where("kind = 'same'").groupBy("grp", "variant").agg(
        *[F.max(F.when(F.col("place") == p, F.col("form"))).alias(f"form_{p}") for p in (0, 1)]
    )
    between = ops.with_pair_metrics(same, "form_0", "form_1").groupBy("variant").agg(F.max("max_abs_diff").alias("between"))

    def at_place(function, name, kind, place=None):
        own = (F.col("kind") == kind) if place is None else (F.col("kind") == kind) & (F.col("place") == place)
        return function(F.when(own, F.col(name)))

    diff, cos = "max_abs_diff", "cosine"
    summary = measured.groupBy("variant").agg(
        at_place(F.max, diff, "same", 0).alias("same_text_diff_1"),
        at_place(F.max, diff, "same", 1).alias("same_text_diff_2"),
        at_place(F.max, diff, "different", 0).alias("different_text_diff_1"),
        at_place(F.max, diff, "different", 1).alias("different_text_diff_2"),
        at_place(F.avg, cos, "different", 0).alias("different_text_cos_1"),
        at_place(F.avg, cos, "different", 1).alias("different_text_cos_2"),
        at_place(F.max, diff, "large").alias("large_batch_diff"),
        at_place(F.avg, cos, "large").alias("large_batch_cos"),
    )
    joined = summary.join(between, "variant")
    different = F.greatest("different_text_diff_1", "different_text_diff_2")
    same_text = F.greatest("same_text_diff_1", "same_text_diff_2", "between")
    return joined.select(
        F.col("variant").alias("precision"),
        *[r6(c).alias(c) for c in summary.columns if c != "variant"],
        r6("between").alias("same_text_between"),
        ops.identical(same_text).alias("same_text_identical"),
        ops.half_precision_verdict(different).alias("verdict"),
    )


@query(
    "v24_direct_accuracy",
    f"""WITH {VARIANTS_SQL}, m AS (
  SELECT 'fp16' AS variant, label, {metric_columns("fp32", "fp16", "cosine", "max_abs_diff")} FROM variants
  UNION ALL SELECT 'int8', label, {metric_columns("fp32", "int8", "cosine", "max_abs_diff")} FROM variants)
SELECT variant, label, {s6("avg(max_abs_diff)")} AS max_diff_mean, {s6("max(max_abs_diff)")} AS max_diff_max,
  {s6("avg(cosine)")} AS cosine_mean, {s6("min(cosine)")} AS cosine_min FROM m GROUP BY variant, label""",
)
def direct_accuracy(spark, sf_dir):
    forms = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("variant"), F.col(name).alias("b"))
                for name in ("fp16", "int8")
            ]
        )
    )
    rows = variants(spark, sf_dir).select("label", F.col("fp32").alias("a"), forms.alias("f"))
    rows = ops.with_pair_metrics(rows.select("label", "a", "f.*"), "a", "b")
    summary = ops.accuracy_summary(rows, "variant", "label")
    return summary.select("variant", "label", *[r6(c).alias(c) for c in summary.columns[2:]])


VERDICT_SQL = f"""{LONG_SQL}, d AS (
  SELECT vec_id // 4 AS batch_id, variant, max(CASE WHEN vec_id % 4 = 0 THEN max_abs_diff END) AS same_length,
    max(CASE WHEN vec_id % 4 = 1 THEN max_abs_diff END) AS different FROM m GROUP BY ALL)"""


def interference_rows(spark, sf_dir):
    """Per batch and variant: the difference of its first and of its second item."""
    rows = single_and_batched(spark, sf_dir)
    return rows.groupBy(F.expr("vec_id div 4").alias("batch_id"), "variant").agg(
        F.max(F.when(F.col("vec_id") % 4 == 0, F.col("max_abs_diff"))).alias("same_length"),
        F.max(F.when(F.col("vec_id") % 4 == 1, F.col("max_abs_diff"))).alias("different"),
    )


@query(
    "v25_interference_verdict",
    f"""WITH {VERDICT_SQL}
SELECT d.batch_id, d.variant, CASE WHEN d.same_length < 1e-4 AND d.different < 1e-4 THEN 'perfect'
    WHEN d.same_length < 0.01 AND d.different < 0.01 THEN 'minimal'
    WHEN d.same_length < coalesce(q.same_length, 1.0) * 0.5 THEN 'less' ELSE 'similar' END AS verdict,
  CASE WHEN d.same_length < 1e-4 AND d.different < 1e-4 THEN 'perfect'
    WHEN d.same_length < coalesce(q.same_length, 1.0) * 0.5 THEN 'less' ELSE 'similar' END AS full_precision_verdict
FROM d LEFT JOIN d q ON q.batch_id = d.batch_id AND q.variant = 'int8' AND d.batch_id % 2 = 0""",
)
def interference_verdicts(spark, sf_dir):
    """Verdicts against the quantized form, which is missing for every second batch."""
    rows = interference_rows(spark, sf_dir)
    quantized = rows.where("variant = 'int8' AND batch_id % 2 = 0").select(
        "batch_id", F.col("same_length").alias("quantized")
    )
    columns = [F.col(c) for c in ("same_length", "different", "quantized")]
    return rows.join(quantized, "batch_id", "left").select(
        "batch_id",
        "variant",
        ops.interference_verdict(*columns).alias("verdict"),
        ops.full_precision_verdict(*columns).alias("full_precision_verdict"),
    )


@query(
    "v26_metric_variant_matrix",
    f"""WITH {LONG_SQL}, s AS (
  SELECT variant, max(max_abs_diff) AS max_diff, avg(mean_abs_diff) AS mean_diff,
    avg(cosine) AS cosine, avg(l2_distance) AS l2 FROM m GROUP BY variant),
u AS (SELECT variant, unnest(['max_diff', 'mean_diff', 'cosine', 'l2']) AS metric,
  unnest([max_diff, mean_diff, cosine, l2]) AS value FROM s)
SELECT metric, {s6("max(value) FILTER (variant = 'int8')")} AS int8, {s6("max(value) FILTER (variant = 'fp32')")} AS fp32,
  {s6("max(value) FILTER (variant = 'fp16')")} AS fp16,
  {s6("abs(max(value) FILTER (variant = 'int8') - max(value) FILTER (variant = 'fp32'))")} AS difference
FROM u GROUP BY metric""",
)
def metric_variant_matrix(spark, sf_dir):
    summary = single_and_batched(spark, sf_dir).groupBy("variant").agg(
        F.max("max_abs_diff").alias("max_diff"),
        F.avg("mean_abs_diff").alias("mean_diff"),
        F.avg("cosine").alias("cosine"),
        F.avg("l2_distance").alias("l2"),
    )
    names = ["int8", "fp32", "fp16"]
    matrix = ops.metric_matrix(summary, "variant", ["max_diff", "mean_diff", "cosine", "l2"], names)
    return matrix.select("metric", *[r6(c).alias(c) for c in (*names, "difference")])
