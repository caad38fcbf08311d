"""Registered queries that compare two colour runs over the same images."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.functions import color as fn
from embedspark.functions import vectors
from embedspark.operators import color as stats
from embedspark.operators import color_qa as ops
from embedspark.plans.color_sql import CLUSTERS_SQL, TWIN_SQL, hex_sql, twin_hex_sql
from embedspark.plans.fixtures import IMAGES_SQL, images, pixels, table
from embedspark.plans.registry import query, r6, s6



def gap_sql(channel: str) -> str:
    """Difference of a channel between the runs; both store colours in single precision."""
    return f"abs(l_{channel}::DOUBLE - r_{channel}::FLOAT::DOUBLE)"


# Two runs: the single-precision rules and the double-precision rules. The first lacks every 19th
# image, the second every 17th, and its geometric results lack every 23rd.
PAIRS_SQL = f"""{CLUSTERS_SQL}, {TWIN_SQL},
methods AS (SELECT unnest(['arithmetic', 'geometric']) AS method),
left_run AS (SELECT m.image_id, method,
    CASE WHEN method = 'geometric' THEN gr ELSE ar END::FLOAT AS l_r, CASE WHEN method = 'geometric' THEN gg ELSE ag END::FLOAT AS l_g,
    CASE WHEN method = 'geometric' THEN gb ELSE ab END::FLOAT AS l_b, b.rf AS l_dr, b.gf AS l_dg, b.bf AS l_db
  FROM means m JOIN best b USING (image_id), methods WHERE m.image_id % 19 <> 0),
right_run AS (SELECT m.image_id, method,
    CASE WHEN method = 'geometric' THEN gr ELSE ar END AS r_r, CASE WHEN method = 'geometric' THEN gg ELSE ag END AS r_g,
    CASE WHEN method = 'geometric' THEN gb ELSE ab END AS r_b, b.rd AS r_dr, b.gd AS r_dg, b.bd AS r_db
  FROM twin_means m JOIN twin_best b USING (image_id), methods
  WHERE m.image_id % 17 <> 0 AND NOT (method = 'geometric' AND m.image_id % 23 = 0)),
pairs AS (SELECT i.image_id, t.method, l.* EXCLUDE (image_id, method), r.* EXCLUDE (image_id, method),
    {hex_sql("l_r", "l_g", "l_b")} AS l_hex, {hex_sql("l_dr", "l_dg", "l_db")} AS l_dhex,
    {twin_hex_sql("r_r", "r_g", "r_b")} AS r_hex, {twin_hex_sql("r_dr", "r_dg", "r_db")} AS r_dhex,
    {gap_sql("r")} AS d0, {gap_sql("g")} AS d1, {gap_sql("b")} AS d2,
    {gap_sql("dr")} AS e0, {gap_sql("dg")} AS e1, {gap_sql("db")} AS e2
  FROM images i CROSS JOIN methods t LEFT JOIN left_run l ON l.image_id = i.image_id AND l.method = t.method
  LEFT JOIN right_run r ON r.image_id = i.image_id AND r.method = t.method),
judged AS (SELECT *, coalesce((d0 > 0.03)::INT + (d1 > 0.03)::INT + (d2 > 0.03)::INT, 0) AS avg_errors,
    coalesce((e0 > 0.05)::INT + (e1 > 0.05)::INT + (e2 > 0.05)::INT, 0) AS dom_warnings,
    CASE WHEN l_r IS NOT NULL AND r_r IS NULL THEN 'right has no colors but left does'
         WHEN l_r IS NULL AND r_r IS NOT NULL THEN 'left has no colors but right does' END AS side_error FROM pairs)"""


def runs(spark, sf_dir):
    """The two runs: every image times every method, colours NULL where the run lacks them."""
    source = pixels(spark, sf_dir)
    tasks = ops.method_tasks(images(spark, sf_dir))
    image, method = F.col("image_id"), F.col("method")

    def run(twin, lacking):
        scale = 255.0 if twin else 1.0
        totals = stats.image_totals(stats.cluster_histogram(source, twin, scale), first_seen=twin)
        colors = F.struct(
            stats.average_color(method, scale, twin).alias("avg_color"),
            stats.dominant_color(twin).alias("dominant_color"),
        )
        present = F.col("valid").isNotNull() & ~lacking
        # A row per image: too much to broadcast, whatever the size of the table they are counted from.
        return tasks.join(totals.hint("merge"), "image_id", "left").select(
            "image_id", "method", F.when(present, colors).alias("color_data")
        )

    return (
        run(False, image % 19 == 0),
        run(True, (image % 17 == 0) | ((method == "geometric") & (image % 23 == 0))),
    )


def compared(spark, sf_dir):
    return ops.compare_runs(*runs(spark, sf_dir), ["image_id", "method"])


def distances(spark, sf_dir, df=None):
    rows = compared(spark, sf_dir) if df is None else df
    a, b = F.col("left.dominant_color"), F.col("right.dominant_color")
    return ops.with_distances(rows, a["hex"], b["hex"], a["rgb"], b["rgb"])


@query(
    "d1_color_compare",
    f"""WITH {PAIRS_SQL}
SELECT image_id, method, avg_errors, dom_warnings, {s6("greatest(d0, d1, d2)", 5)} AS avg_diff,
  {s6("greatest(e0, e1, e2)", 5)} AS dom_diff FROM judged""",
)
def color_compare(spark, sf_dir):
    rows = compared(spark, sf_dir)

    def worst(field):
        a, b = F.col(f"left.{field}.rgb"), F.col(f"right.{field}.rgb")
        gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
        return r6(F.array_max(gaps), 5)

    return rows.select(
        "image_id",
        "method",
        F.size("avg_errors").alias("avg_errors"),
        F.size("dom_warnings").alias("dom_warnings"),
        worst("avg_color").alias("avg_diff"),
        worst("dominant_color").alias("dom_diff"),
    )


@query(
    "d2_d3_pass_warn",
    f"""WITH {PAIRS_SQL}
SELECT image_id, method, side_error, avg_errors = 0 AS avg_match, dom_warnings = 0 AS dom_match,
  avg_errors = 0 AND side_error IS NULL AS passed FROM judged""",
)
def pass_warn(spark, sf_dir):
    """Averages and one-sided results fail, dominant colours only warn."""
    return compared(spark, sf_dir).select(
        "image_id", "method", "side_error", "avg_match", "dom_match", "passed"
    )


DISTANCES_SQL = f"""{PAIRS_SQL},
dist AS (SELECT image_id, method, side_error, avg_errors, l_dhex, r_dhex, CASE WHEN l_dhex IS NULL OR r_dhex IS NULL THEN 1.0::DOUBLE ELSE greatest(
    abs(('0x' || substr(l_dhex, 2, 2))::INT - ('0x' || substr(r_dhex, 2, 2))::INT),
    abs(('0x' || substr(l_dhex, 4, 2))::INT - ('0x' || substr(r_dhex, 4, 2))::INT),
    abs(('0x' || substr(l_dhex, 6, 2))::INT - ('0x' || substr(r_dhex, 6, 2))::INT)) / 255e0 END AS hex_diff,
  CASE WHEN l_dhex IS NULL OR r_dhex IS NULL THEN 6 ELSE
    {" + ".join(f"(substr(l_dhex, {i}, 1) <> substr(r_dhex, {i}, 1))::INT" for i in range(2, 8))} END AS hex_digits,
  coalesce(greatest(e0, e1, e2), 1.0::DOUBLE) AS rgb_diff FROM judged)"""


@query(
    "d4_d7_color_distances",
    f"""WITH {DISTANCES_SQL}
SELECT image_id, method, {s6("hex_diff")} AS hex_diff, hex_digits, {s6("rgb_diff", 5)} AS rgb_diff FROM dist""",
)
def color_distances(spark, sf_dir):
    return distances(spark, sf_dir).select(
        "image_id",
        "method",
        r6("hex_diff").alias("hex_diff"),
        "hex_digits",
        r6("rgb_diff", 5).alias("rgb_diff"),
    )


HEX_TEXT_SQL = """hex_texts AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '#' || substr(md5(text), 1, 6)
  WHEN 1 THEN '##' || upper(substr(md5(text), 1, 6)) WHEN 2 THEN substr(md5(text), 1, 5)
  WHEN 3 THEN substr(text, 1, 6) ELSE substr(md5(text), 1, 6) END AS hex FROM documents)"""


@query(
    "d5_hex_parse",
    f"""WITH {HEX_TEXT_SQL}, digits AS (SELECT doc_id, lower(ltrim(hex, '#')) AS d FROM hex_texts)
SELECT doc_id, {", ".join(f"CASE WHEN regexp_full_match(d, '[0-9a-f]{{6}}') THEN ('0x' || substr(d, {1 + 2 * i}, 2))::INT END AS {c}" for i, c in enumerate("rgb"))}
FROM digits""",
)
def hex_parse(spark, sf_dir):
    doc, text = F.col("doc_id") % 5, F.col("text")
    digest = F.substring(F.md5(text.cast("binary")), 1, 6)
    given = (
        F.when(doc == 0, F.concat(F.lit("#"), digest))
        .when(doc == 1, F.concat(F.lit("##"), F.upper(digest)))
        .when(doc == 2, F.substring(digest, 1, 5))
        .when(doc == 3, F.substring(text, 1, 6))
        .otherwise(digest)
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", given.alias("hex"))
    return rows.select(
        "doc_id", *[fn.hex_channel(F.col("hex"), i).alias(c) for i, c in enumerate("rgb")]
    )


@query(
    "d8_sortable_scientific",
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0e0 ELSE value / pow(10e0, event_id % 9) END AS x FROM events),
t AS (SELECT event_id, x, printf('%.3e', x) AS f FROM v)
SELECT event_id, CASE WHEN x = 0 THEN '0.000E+000' ELSE split_part(f, 'e', 1) || 'E' || substr(split_part(f, 'e', 2), 1, 1)
  || lpad(substr(split_part(f, 'e', 2), 2), 3, '0') END AS text FROM t""",
)
def sortable_scientific(spark, sf_dir):
    event = F.col("event_id")
    value = F.when(event % 50 == 0, F.lit(0.0)).otherwise(
        F.col("value") / F.pow(F.lit(10.0), (event % 9).cast("double"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", fn.sortable_scientific(value).alias("text")
    )


@query(
    "d9_worst_first",
    f"""WITH {DISTANCES_SQL}
SELECT image_id, {s6("hex_diff")} AS hex_diff, hex_digits,
  rank() OVER (ORDER BY hex_diff DESC, hex_digits DESC) AS rank FROM dist WHERE method = 'arithmetic'""",
)
def worst_first(spark, sf_dir):
    rows = distances(spark, sf_dir).where("method = 'arithmetic'")
    ranked = ops.ranked_by_distance(rows.select("image_id", "hex_diff", "hex_digits"), "image_id")
    return ranked.select("image_id", r6("hex_diff").alias("hex_diff"), "hex_digits", "rank")


@query(
    "d10_pass_summary",
    f"""WITH {PAIRS_SQL}
SELECT method, sum((avg_errors = 0 AND side_error IS NULL)::INT)::BIGINT AS passed, count(*) AS total,
  sum((avg_errors = 0 AND side_error IS NULL)::INT)::BIGINT * 100 // count(*) AS percent FROM judged GROUP BY method""",
)
def pass_summary_query(spark, sf_dir):
    return ops.pass_summary(compared(spark, sf_dir), "passed", "method")


BOTH_SQL = f"""{DISTANCES_SQL},
both_methods AS (SELECT a.image_id, a.avg_errors AS a_errors, g.avg_errors AS g_errors, a.l_dhex, a.r_dhex, a.hex_diff, a.hex_digits
  FROM dist a JOIN dist g ON g.image_id = a.image_id AND g.method = 'geometric'
  WHERE a.method = 'arithmetic' AND a.l_dhex IS NOT NULL AND a.r_dhex IS NOT NULL AND g.l_dhex IS NOT NULL AND g.r_dhex IS NOT NULL)"""


def results_of_both(spark, sf_dir):
    """Images whose two methods both have both runs, with averages and dominant hex texts."""
    rows = distances(spark, sf_dir).where(F.col("left").isNotNull() & F.col("right").isNotNull())
    rows = rows.select(
        "image_id",
        "method",
        "avg_match",
        "hex_diff",
        "hex_digits",
        F.col("left.dominant_color.hex").alias("left_hex"),
        F.col("right.dominant_color.hex").alias("right_hex"),
    )
    columns = ["avg_match", "left_hex", "right_hex", "hex_diff", "hex_digits"]
    return ops.both_methods(rows, "image_id", columns)


@query(
    "d11_d15_success_review",
    f"""WITH {BOTH_SQL}
SELECT image_id, CASE WHEN a_errors = 0 AND g_errors = 0 AND l_dhex = r_dhex THEN 'success' ELSE 'review' END AS outcome,
  l_dhex AS left_hex, r_dhex AS right_hex FROM both_methods""",
)
def success_review(spark, sf_dir):
    """Images that have both results, split into successes and those to review."""
    rows = results_of_both(spark, sf_dir)
    good = ops.is_success(
        F.col("avg_match_arithmetic"),
        F.col("avg_match_geometric"),
        F.col("left_hex_arithmetic"),
        F.col("right_hex_arithmetic"),
    )
    return rows.select(
        "image_id",
        F.when(good, "success").otherwise("review").alias("outcome"),
        F.col("left_hex_arithmetic").alias("left_hex"),
        F.col("right_hex_arithmetic").alias("right_hex"),
    )


@query(
    "d12_method_tasks",
    f"""WITH {IMAGES_SQL} SELECT image_id, w, h, method FROM images, (SELECT unnest(['arithmetic', 'geometric']) AS method)""",
)
def method_tasks_query(spark, sf_dir):
    return ops.method_tasks(images(spark, sf_dir))


@query(
    "d13_warning_list",
    f"""WITH {BOTH_SQL}
SELECT image_id, l_dhex AS left_hex, r_dhex AS right_hex, {s6("hex_diff")} AS hex_diff, hex_digits,
  rank() OVER (ORDER BY hex_diff DESC, hex_digits DESC) AS rank FROM both_methods WHERE l_dhex <> r_dhex""",
)
def warning_list(spark, sf_dir):
    """Images whose dominant colours differ, worst first."""
    rows = results_of_both(spark, sf_dir).where("left_hex_arithmetic <> right_hex_arithmetic")
    named = rows.select(
        "image_id",
        *[
            F.col(f"{c}_arithmetic").alias(c)
            for c in ("left_hex", "right_hex", "hex_diff", "hex_digits")
        ],
    )
    ranked = ops.ranked_by_distance(named, "image_id")
    return ranked.select(
        "image_id", "left_hex", "right_hex", r6("hex_diff").alias("hex_diff"), "hex_digits", "rank"
    )


@query(
    "d14_l2_color_match",
    f"""WITH {PAIRS_SQL}
SELECT image_id, {s6("sqrt(e0 * e0 + e1 * e1 + e2 * e2)", 5)} AS distance,
  coalesce(sqrt(e0 * e0 + e1 * e1 + e2 * e2) < 0.05, false) AS matches FROM judged WHERE method = 'arithmetic'""",
)
def l2_color_match(spark, sf_dir):
    rows = compared(spark, sf_dir).where("method = 'arithmetic'")
    gap = vectors.l2_distance(F.col("left.dominant_color.rgb"), F.col("right.dominant_color.rgb"))
    return rows.select(
        "image_id",
        r6(gap, 5).alias("distance"),
        F.coalesce(gap < 0.05, F.lit(False)).alias("matches"),
    )
