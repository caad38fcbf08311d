"""SQL for the colour rules, shared by the colour queries."""

from __future__ import annotations

from embedspark.plans.fixtures import PIXELS_SQL

# Single-precision rule: every step cast to FLOAT.
CHANNELS_SQL = f"""{PIXELS_SQL},
valid AS (SELECT *, (r / 255e0)::FLOAT AS rf, (g / 255e0)::FLOAT AS gf, (b / 255e0)::FLOAT AS bf
  FROM pixels WHERE a >= 128),
extremes AS (SELECT *, greatest(rf, gf, bf) AS hi, (greatest(rf, gf, bf) - least(rf, gf, bf))::FLOAT AS delta FROM valid),
turned AS (SELECT *, CASE WHEN delta < 1e-6::FLOAT THEN 0::FLOAT
    WHEN abs(hi - rf) < 1e-6::FLOAT THEN ((gf - bf)::FLOAT::DOUBLE / delta)::FLOAT
    WHEN abs(hi - gf) < 1e-6::FLOAT THEN ((((bf - rf)::FLOAT::DOUBLE / delta)::FLOAT + 2::FLOAT)::FLOAT::DOUBLE / 6)::FLOAT
    ELSE ((((rf - gf)::FLOAT::DOUBLE / delta)::FLOAT + 4::FLOAT)::FLOAT::DOUBLE / 6)::FLOAT END AS part,
    (delta >= 1e-6::FLOAT AND abs(hi - rf) < 1e-6::FLOAT) AS red FROM extremes),
hsv AS (SELECT *, CASE WHEN red THEN ((CASE WHEN part < 0 THEN (part + 6::FLOAT)::FLOAT ELSE part END)::DOUBLE / 6)::FLOAT
    ELSE part END AS hsv_h,
    CASE WHEN hi > 0 THEN (delta::DOUBLE / hi)::FLOAT ELSE 0::FLOAT END AS hsv_s, hi AS hsv_v FROM turned),
keyed AS (SELECT *, trunc((hsv_h * 10::FLOAT)::FLOAT)::BIGINT * 1000 + trunc((hsv_s * 10::FLOAT)::FLOAT)::BIGINT * 10
    + trunc((hsv_v * 10::FLOAT)::FLOAT)::BIGINT AS key FROM hsv)"""

CLUSTERS_SQL = f"""{CHANNELS_SQL},
clusters AS (SELECT image_id, key, count(*) AS cnt, min(idx) AS first_idx FROM keyed GROUP BY image_id, key),
best AS (SELECT c.image_id, c.key, c.cnt, p.r, p.g, p.b, p.idx, p.rf, p.gf, p.bf FROM (
    SELECT * FROM clusters QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, key) = 1) c
  JOIN valid p ON p.image_id = c.image_id AND p.idx = c.first_idx),
means AS (SELECT image_id, count(*) AS valid_pixels,
    avg(rf::DOUBLE) AS ar, avg(gf::DOUBLE) AS ag, avg(bf::DOUBLE) AS ab,
    exp(avg(ln(greatest(rf::DOUBLE, 1e-8)))) AS gr, exp(avg(ln(greatest(gf::DOUBLE, 1e-8)))) AS gg,
    exp(avg(ln(greatest(bf::DOUBLE, 1e-8)))) AS gb FROM valid GROUP BY image_id)"""

# Double-precision rule of the comparison runs.
TWIN_SQL = """twin_valid AS (SELECT *, r / 255e0 AS rd, g / 255e0 AS gd, b / 255e0 AS bd FROM pixels WHERE a >= 128),
twin_extremes AS (SELECT *, greatest(rd, gd, bd) AS hi, greatest(rd, gd, bd) - least(rd, gd, bd) AS delta FROM twin_valid),
twin_turned AS (SELECT *, CASE WHEN delta = 0 THEN 0e0
    WHEN rd = hi THEN (hi - bd) / delta - (hi - gd) / delta
    WHEN gd = hi THEN 2e0 + (hi - rd) / delta - (hi - bd) / delta
    ELSE 4e0 + (hi - gd) / delta - (hi - rd) / delta END / 6e0 AS turn FROM twin_extremes),
twin_keyed AS (SELECT *, trunc((CASE WHEN turn < 0 THEN turn + 1e0 ELSE turn END) * 10)::BIGINT * 1000
    + trunc((CASE WHEN delta = 0 THEN 0e0 ELSE delta / hi END) * 10)::BIGINT * 10 + trunc(hi * 10)::BIGINT AS key
  FROM twin_turned),
twin_clusters AS (SELECT image_id, key, count(*) AS cnt, min(idx) AS first_idx FROM twin_keyed GROUP BY image_id, key),
twin_best AS (SELECT c.image_id, c.key, c.cnt, p.rd, p.gd, p.bd, p.r, p.g, p.b FROM (
    SELECT * FROM twin_clusters QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first_idx) = 1) c
  JOIN twin_valid p ON p.image_id = c.image_id AND p.idx = c.first_idx),
twin_means AS (SELECT image_id, avg(rd) AS ar, avg(gd) AS ag, avg(bd) AS ab,
    exp(avg(ln(greatest(rd * 255, 1e-8)))) / 255 AS gr, exp(avg(ln(greatest(gd * 255, 1e-8)))) / 255 AS gg,
    exp(avg(ln(greatest(bd * 255, 1e-8)))) / 255 AS gb FROM twin_valid GROUP BY image_id)"""


def hex_sql(r: str, g: str, b: str) -> str:
    """Single-precision hex text, halves away from zero."""
    parts = [f"lpad(to_hex(round(({c})::FLOAT * 255::FLOAT)::BIGINT), 2, '0')" for c in (r, g, b)]
    return "'#' || lower(" + " || ".join(parts) + ")"


def twin_hex_sql(r: str, g: str, b: str) -> str:
    """Double-precision hex text, halves to even."""
    parts = [f"lpad(to_hex(round_even(({c}) * 255, 0)::BIGINT), 2, '0')" for c in (r, g, b)]
    return "'#' || lower(" + " || ".join(parts) + ")"
