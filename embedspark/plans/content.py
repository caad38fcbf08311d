"""Registered queries on payloads, images as bytes, metadata and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedspark.functions import payload as fn
from embedspark.operators.color import packed_statistics
from embedspark.operators.text import embed_texts
from embedspark.plans.binary_fixtures import metadata_payloads, packed_images, png_payloads
from embedspark.plans.color_sql import CLUSTERS_SQL, hex_sql
from embedspark.plans.fixtures import (
    CONTENT_SQL,
    PIXELS_SQL,
    REQUEST_LOG_SQL,
    base64_text,
    content,
    hashed_sql,
    images,
    request_log,
    table,
    wide_table,
)
from embedspark.plans.registry import query, r6, s6
from embedspark.session import shared_folder
from embedspark.sources import exif, folder, logs, payloads, sinks
from embedspark.sources.images import decode_png, decoded_in_turn, explode_pixels


@query(
    "s4_content_kind",
    f"""WITH {CONTENT_SQL} SELECT doc_id, CASE WHEN starts_with(content, 'http://') OR starts_with(content, 'https://') THEN 'url'
  WHEN starts_with(content, 'data:') THEN 'data_url' ELSE 'base64' END AS kind FROM content""",
)
def content_kind(spark, sf_dir):
    return content(spark, sf_dir).select("doc_id", fn.content_kind(F.col("content")).alias("kind"))


@query(
    "s5_data_url_split",
    f"""WITH {CONTENT_SQL}, t AS (SELECT doc_id, 'data:' || text AS content FROM content)
SELECT doc_id, md5(CASE WHEN strpos(content, ',') > 0 THEN substr(content, strpos(content, ',') + 1) END) AS part_md5,
  strpos(content, ',') = 0 AS invalid FROM t""",
)
def data_url_split(spark, sf_dir):
    """Split at the first comma; texts after ``data:`` hold any number of commas."""
    rows = content(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("data:"), "text").alias("content")
    )
    part = fn.encoded_part(F.col("content"))
    return rows.select(
        "doc_id", F.md5(part.cast("binary")).alias("part_md5"), part.isNull().alias("invalid")
    )


@query(
    "s6_base64_decode",
    f"""WITH {CONTENT_SQL}
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 400 WHEN 4 THEN 400 ELSE 200 END AS code,
  CASE doc_id % 5 WHEN 3 THEN 'Invalid data URL format' WHEN 4 THEN 'Invalid base64' END AS message,
  CASE WHEN doc_id % 5 < 2 THEN md5(text) END AS payload_md5,
  CASE WHEN doc_id % 5 < 2 THEN octet_length(encode(text)) END AS payload_length FROM content""",
)
def base64_decode(spark, sf_dir):
    rows = payloads.resolve_inline(content(spark, sf_dir))
    return rows.select(
        "doc_id",
        "status.code",
        "status.message",
        F.md5("payload").alias("payload_md5"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
    )


# Pages are the fetched answers; requests name every page and, for each, one unknown URL.
FETCHED_SQL = """answers AS (SELECT page_id, url, CASE page_id % 7 WHEN 5 THEN 404 WHEN 6 THEN 503 ELSE 200 END AS http_status,
  CASE WHEN page_id % 11 = 0 THEN NULL ELSE html END AS body FROM pages),
asked AS (SELECT page_id, url FROM pages UNION ALL SELECT -1 - page_id, url || '/missing' FROM pages)"""


@query(
    "s7_url_resolve",
    f"""WITH {FETCHED_SQL}
SELECT a.page_id, CASE WHEN f.url IS NULL OR http_status <> 200 OR body IS NULL THEN 400 ELSE 200 END AS code,
  CASE WHEN f.url IS NULL THEN 'Failed to fetch URL' WHEN http_status <> 200 THEN 'URL returned status ' || http_status
    WHEN body IS NULL THEN 'Failed to read image data' END AS message,
  CASE WHEN http_status = 200 THEN octet_length(encode(body)) END AS payload_length
FROM asked a LEFT JOIN answers f ON f.url = a.url""",
)
def url_resolve(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 7
    fetched = pages.select(
        "url",
        F.when(kind == 5, 404).when(kind == 6, 503).otherwise(200).alias("http_status"),
        F.when(F.col("page_id") % 11 != 0, F.col("html").cast("binary")).alias("bytes"),
    )
    asked = pages.select("page_id", "url").unionByName(
        pages.select((-1 - F.col("page_id")).alias("page_id"), F.concat("url", F.lit("/missing")).alias("url"))
    )
    rows = payloads.resolve_urls(asked, fetched, "url")
    return rows.select(
        "page_id",
        "status.code",
        "status.message",
        F.octet_length("payload").cast("bigint").alias("payload_length"),
    )


@query(
    "s8_size_limit",
    """SELECT doc_id, octet_length(encode(text)) AS payload_length,
  CASE WHEN octet_length(encode(text)) > 2048 THEN 400 ELSE 200 END AS code,
  CASE WHEN octet_length(encode(text)) > 2048
    THEN 'Image too large: ' || octet_length(encode(text)) || ' bytes (max 0 MB)' END AS message FROM documents""",
)
def size_limit(spark, sf_dir):
    """The limit rule, with a limit that texts can exceed."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("payload"), fn.status(fn.OK).alias("status")
    )
    return payloads.with_size_limit(rows, limit=2048).select(
        "doc_id",
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        "status.code",
        "status.message",
    )


@query(
    "s9_format_sniff",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif'
  WHEN 4 THEN 'webp' END AS format FROM documents""",
)
def format_sniff(spark, sf_dir):
    """Known leading bytes in front of every text; kinds 5 to 7 are bitmap, TIFF and plain text."""
    # Leading bytes of the formats.
    heads = (
        "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "474946383761",
        "524946460000000057454250", "424D", "49492A00", "",
    )
    kind = (F.col("doc_id") % 8 + 1).cast("int")
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), kind))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(head, F.col("text").cast("binary")).alias("payload")
    )
    return rows.select("doc_id", fn.image_format(F.col("payload")).alias("format"))


@query(
    "s10_s11_decode_pixels",
    f"""WITH {PIXELS_SQL}
SELECT image_id, any_value(w) AS w, any_value(h) AS h, count(*) AS pixels, max(idx) AS last_idx,
  sum(r * (1 + x))::BIGINT AS r, sum(g * (1 + y))::BIGINT AS g, sum(b * (1 + idx % 97))::BIGINT AS b,
  sum(CASE WHEN image_id % 2 = 1 THEN a ELSE 255 END * (1 + idx % 89))::BIGINT AS a FROM pixels GROUP BY image_id""",
)
def decode_pixels(spark, sf_dir):
    """PNG payloads as data URLs, resolved, decoded and exploded; weighted sums per image."""
    urls = png_payloads(spark, sf_dir).select(
        "image_id", F.concat(F.lit("data:image/png;base64,"), base64_text(F.col("payload"))).alias("content")
    )
    rows = payloads.resolve_inline(urls).where("status.code = 200")
    packed = rows.select("image_id", decode_png("payload").alias("p")).select("image_id", "p.*")
    idx = F.col("idx")
    return explode_pixels(packed).groupBy("image_id").agg(
        F.first("w").alias("w"),
        F.first("h").alias("h"),
        F.count("*").alias("pixels"),
        F.max("idx").alias("last_idx"),
        F.sum(F.col("r") * (1 + F.col("x"))).alias("r"),
        F.sum(F.col("g") * (1 + F.col("y"))).alias("g"),
        F.sum(F.col("b") * (1 + idx % 97)).alias("b"),
        F.sum(F.col("a") * (1 + idx % 89)).alias("a"),
    )


#: Files that the image source lists at once.
FILES_PER_FOLDER = 1 << 15


@query(
    "s10_decode_files",
    f"""WITH {PIXELS_SQL}
SELECT image_id, any_value(w) AS w, any_value(h) AS h, count(*) AS pixels,
  sum(r * (1 + x))::BIGINT AS r, sum(g * (1 + y))::BIGINT AS g, sum(b * (1 + idx % 97))::BIGINT AS b FROM pixels GROUP BY image_id""",
)
def decode_files(spark, sf_dir):
    """PNG files in folders, decoded by Spark's image source a folder at a time; weighted sums per image."""
    path = f"{shared_folder(spark)}/pictures"
    names = F.concat(F.col("image_id").cast("string"), F.lit(".png"))
    folders = max(1, -(-images(spark, sf_dir).count() // FILES_PER_FOLDER))
    placed = folder.in_folders(names, folders).alias("name")
    folder.write_folder(png_payloads(spark, sf_dir).select(placed, "payload"), path)

    def sums(files):
        packed = files.withColumn("image_id", F.regexp_extract("path", "(-?[0-9]+)\\.png$", 1).cast("bigint")).drop("path")
        return explode_pixels(packed).groupBy("image_id").agg(
            F.first("w").alias("w"),
            F.first("h").alias("h"),
            F.count("*").alias("pixels"),
            F.sum(F.col("r") * (1 + F.col("x"))).alias("r"),
            F.sum(F.col("g") * (1 + F.col("y"))).alias("g"),
            F.sum(F.col("b") * (1 + F.col("idx") % 97)).alias("b"),
        )

    return decoded_in_turn(spark, path, sums)


FILE_LIMIT = 4096


@query(
    "s8_folder_files",
    f"""SELECT doc_id, strlen(text) AS length, CASE WHEN strlen(text) > {FILE_LIMIT} THEN 400 ELSE 200 END AS code,
  CASE WHEN strlen(text) > {FILE_LIMIT} THEN 'Image too large: ' || strlen(text) || ' bytes (max 0 MB)' END AS message,
  CASE WHEN strlen(text) <= {FILE_LIMIT} THEN md5(text) END AS digest FROM documents WHERE text IS NOT NULL""",
)
def folder_files(spark, sf_dir):
    """Every text as a file of a folder, read back; files above the limit keep their row and are not opened."""
    path = f"{shared_folder(spark)}/texts"
    docs = wide_table(spark, sf_dir, "documents")
    names = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    folder.write_folder(docs.select(names.alias("name"), F.col("text").cast("binary").alias("payload")), path)
    files = folder.read_folder(spark, path, limit=FILE_LIMIT)
    return files.select(
        F.regexp_extract("path", "(-?[0-9]+)\\.txt$", 1).cast("bigint").alias("doc_id"),
        "length",
        "status.code",
        "status.message",
        F.md5("payload").alias("digest"),
    )


# Image requests from events: a user asks for one of its images in one of three sizes.
ASKED_SQL = """asked AS (SELECT event_id, ts, 'image_' || user_id || '_' || (150 + 50 * (event_id % 3)) || 'x' || 300 AS key FROM events)"""


def asked(spark, sf_dir):
    width = 150 + 50 * (F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", payloads.cache_key(F.col("user_id"), width, F.lit(300)).alias("key")
    )


@query(
    "s15_cache_latest",
    f"""WITH {ASKED_SQL} SELECT key, event_id FROM asked
QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1""",
)
def cache_latest(spark, sf_dir):
    """One entry per key, the later request overwrites."""
    return payloads.latest_by_key(asked(spark, sf_dir), "key", ["ts", "event_id"]).select("key", "event_id")


@query(
    "s15_cache_misses",
    f"""WITH {ASKED_SQL} SELECT DISTINCT key FROM asked WHERE key NOT IN (SELECT key FROM asked WHERE substr(md5(event_id::VARCHAR), 1, 1) IN ('0', '1'))""",
)
def cache_misses(spark, sf_dir):
    """Keys still to be fetched when an eighth of all requests, drawn by hash, filled the cache."""
    rows = asked(spark, sf_dir)
    return payloads.to_fetch(rows, rows.where("substr(md5(cast(event_id as string)), 1, 1) in ('0', '1')"), "key")


@query(
    "s17_result_sink",
    f"""WITH {hashed_sql("benchmark", "item_id", "text", 768, 16, "q", "search_query")}
SELECT item_id, tokens, {s6("list_sum(v)", 5)} AS total, 'batch_' || item_id % 4 AS batch FROM q""",
)
def result_sink(spark, sf_dir):
    """Embeddings written to partitioned Parquet and read back."""
    rows = embed_texts(table(spark, sf_dir, "benchmark"), "text", dim=16).select(
        "item_id",
        "tokens",
        "embedding",
        F.concat(F.lit("batch_"), (F.col("item_id") % 4).cast("string")).alias("batch"),
    )
    folder = f"{shared_folder(spark)}/embeddings"
    sinks.write_embeddings(rows, folder, "batch")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(folder).select(
        "item_id", F.col("tokens").cast("bigint").alias("tokens"), r6(total, 5).alias("total"), "batch"
    )


def timing_line():
    """The line that a handler would have written for a request."""
    kind = F.col("request_id") % 3
    part = F.format_string("%.4f", F.col("latency_ms") / 4)
    total = F.format_string("%.2f", F.col("latency_ms"))
    return (
        F.when(kind == 0, F.format_string("Text embed timing - tokenize: %sms, ONNX: 1.00ms, total: %sms", part, total))
        .when(
            kind == 1,
            F.format_string(
                "Text batch timing - count: %s, tokenize: %sms, ONNX: 1.00ms, total: %sms, avg: 1.00ms",
                F.col("batch_size").cast("string"), part, total,
            ),
        )
        .otherwise(F.format_string("Image embed timing - preprocess: %sms, ONNX: 1.00ms, total: %sms", part, total))
    )


@query(
    "s19_log_lines",
    f"""WITH {REQUEST_LOG_SQL}
SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'text embed' WHEN 1 THEN 'text batch' ELSE 'image embed' END AS kind,
  CASE WHEN request_id % 3 = 1 THEN batch_size END AS items,
  CASE WHEN request_id % 3 < 2 THEN {s6("latency_ms / 4", 4)} END AS tokenize_ms,
  CASE WHEN request_id % 3 = 2 THEN {s6("latency_ms / 4", 4)} END AS preprocess_ms, {s6("latency_ms", 2)} AS total_ms
FROM request_log""",
)
def log_lines(spark, sf_dir):
    """Timing lines of three handlers, made from the request log and read back from their text."""
    line = timing_line()
    log = request_log(spark, sf_dir).select("request_id", line.alias("line"))
    rows = logs.stage_timings(log)
    return rows.select(
        "request_id",
        "kind",
        "items",
        r6("tokenize_ms", 4).alias("tokenize_ms"),
        r6("preprocess_ms", 4).alias("preprocess_ms"),
        r6("total_ms", 2).alias("total_ms"),
    )


@query(
    "s19_log_scan",
    f"""WITH {REQUEST_LOG_SQL}, lines AS (SELECT CASE request_id % 3 WHEN 0 THEN 'text embed' WHEN 1 THEN 'text batch' ELSE 'image embed' END AS kind,
  CASE WHEN request_id % 3 = 1 THEN batch_size END AS items, round(latency_ms, 2) AS total_ms FROM request_log WHERE latency_ms IS NOT NULL)
SELECT kind, items, count(*) AS lines, {s6("sum(total_ms)", 2)} AS total_ms, {s6("max(total_ms)", 2)} AS slowest_ms FROM lines GROUP BY kind, items""",
)
def log_scan(spark, sf_dir):
    """The same lines as text files among lines of other kinds, scanned and summed by handler and batch size."""
    path = f"{shared_folder(spark)}/log"
    log = request_log(spark, sf_dir).where("latency_ms IS NOT NULL")
    other = F.format_string("request %s took long - total: 99999.00ms", F.col("request_id").cast("string"))
    log.select(F.explode(F.array(timing_line(), other)).alias("value")).write.text(path)
    rows = logs.stage_timings(logs.log_lines(spark, path))
    return rows.groupBy("kind", "items").agg(
        F.count("*").alias("lines"), r6(F.sum("total_ms"), 2).alias("total_ms"), r6(F.max("total_ms"), 2).alias("slowest_ms")
    )


# --------------------------------------------------------------------------------------------------
# Metadata

EXIF_SQL = """meta AS (SELECT p_partkey AS k, p_size::BIGINT AS z, p_brand AS brand, p_name AS name FROM part
  WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0),
hexed AS (SELECT k, string_agg(printf('%02x', n), '' ORDER BY n) AS digits FROM (
  SELECT k, unnest(range(20 + k % 20)) AS n FROM meta) GROUP BY k),
tags AS (
  SELECT k, 'Make' AS tag, CASE WHEN k % 5 = 0 THEN '"Dup"' ELSE '"' || brand || '"' END AS value FROM meta
  UNION ALL SELECT k, 'Model', CASE WHEN k % 4 = 0 THEN '["' || name || '","' || brand || '"]' ELSE '"' || name || '"' END FROM meta
  UNION ALL SELECT k, 'Orientation', (1 + z % 8)::VARCHAR FROM meta
  UNION ALL SELECT k, 'BitsPerSample', '[8,8,' || (k % 256) || ']' FROM meta
  UNION ALL SELECT k, 'XResolution', (72e0 * (1 + k % 3))::VARCHAR FROM meta
  UNION ALL SELECT k, 'ExposureTime', CASE WHEN k % 13 = 0 THEN '"inf"' ELSE (1e0 / (k % 13))::VARCHAR END FROM meta
  UNION ALL SELECT k, 'ExposureBiasValue', ((z - 25) / 2e0)::VARCHAR FROM meta
  UNION ALL SELECT k, 'UserComment', CASE WHEN 20 + k % 20 <= 32 THEN '"' || digits || '"'
    ELSE '"<' || (20 + k % 20) || ' bytes>"' END FROM meta JOIN hexed USING (k)
  UNION ALL SELECT k, 'GPSLatitudeRef', '"N"' FROM meta
  UNION ALL SELECT k, 'GPSLatitude', '[' || (k % 90)::DOUBLE || ',' || z::DOUBLE || ',0.0]' FROM meta)"""


@query("c17_exif_extract", f"WITH {EXIF_SQL} SELECT k AS image_id, tag, value FROM tags")
def exif_extract(spark, sf_dir):
    """Fields read from image bytes, shaped, last of equal tags; one row per field."""
    rows = exif.with_exif(metadata_payloads(spark, sf_dir))
    return rows.select("image_id", F.explode("exif").alias("tag", "value"))


@query(
    "c15_stats_rows",
    f"""WITH {CLUSTERS_SQL}, {EXIF_SQL}, fields AS (
  SELECT k, count(*) AS n, max(CASE WHEN tag = 'Make' THEN value END) AS make FROM tags GROUP BY k)
SELECT i.image_id, coalesce(f.n, 0) AS exif_fields, f.make, m.valid_pixels, {hex_sql("m.gr", "m.gg", "m.gb")} AS avg_hex,
  {s6("m.gr::FLOAT", 5)} AS avg_r, {hex_sql("b.rf", "b.gf", "b.bf")} AS dominant_hex
FROM images i LEFT JOIN fields f ON f.k = i.image_id LEFT JOIN means m ON m.image_id = i.image_id
LEFT JOIN best b ON b.image_id = i.image_id""",
)
def stats_rows(spark, sf_dir):
    """The full answer per image from bytes: metadata and colours, clusters made inside the tasks.

    Fields of metadata are far larger than the rows of part they are read from, by whose size Spark would broadcast them:
    only what is asked of them leaves the task, and the join asks for a merge.
    """
    packed = packed_images(spark, sf_dir)
    meta = exif.with_exif(metadata_payloads(spark, sf_dir)).select(
        "image_id",
        F.size("exif").alias("fields"),
        F.try_element_at("exif", F.lit("Make")).alias("make"),
    )
    colors = packed_statistics(packed)
    rows = colors.join(meta.hint("merge"), "image_id", "left")
    average, dominant = F.col("color_data.avg_color"), F.col("color_data.dominant_color")
    return rows.select(
        "image_id",
        F.coalesce("fields", F.lit(0)).cast("bigint").alias("exif_fields"),
        "make",
        F.when(F.col("valid_pixels") > 0, F.col("valid_pixels")).alias("valid_pixels"),
        average["hex"].alias("avg_hex"),
        r6(average["rgb"][0], 5).alias("avg_r"),
        dominant["hex"].alias("dominant_hex"),
    )


@query(
    "c18_exif_value_shaping",
    """SELECT p_partkey AS image_id, CASE p_partkey % 8 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN '["' || p_name || '","' || p_brand || '"]'
  WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN '[' || p_size || ',' || p_partkey || ']' WHEN 4 THEN '"NaN"' WHEN 5 THEN '[-0.5,"inf"]'
  WHEN 6 THEN '"' || repeat('ab', 32) || '"' ELSE '"<33 bytes>"' END AS value FROM part""",
)
def exif_value_shaping(spark, sf_dir):
    name, brand = F.concat("p_name", F.lit("\0\0")), F.col("p_brand")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")

    def field(kind, *values):
        return F.struct(F.lit("tag").alias("tag"), F.lit(kind).alias("type"), F.array(*values).alias("values"))

    options = (
        field("ascii", name),
        field("ascii", name, brand),
        field("short", size),
        field("long", size, key),
        field("rational", F.lit("NaN")),
        field("srational", F.lit("-0.5"), F.lit("inf")),
        field("undefined", F.lit("ab" * 32)),
        field("undefined", F.lit("ab" * 33)),
    )
    entry = F.element_at(F.array(*options), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"), exif.shaped_value(entry).alias("value")
    )


# GPS values of all kinds with the expected verdicts of both rules.
GPS_CASES = (
    ('"(0.0, 0.0, 0.0)"', False, False),
    ("\"{29: '1970:01:01'}\"", False, False),
    ('"(40.0, 26.0, 46.0)"', True, False),
    ('"(40.5, 26.1, 46.3)"', True, True),
    ('{"GPSLatitude":[0.0,0.0,0.00005]}', False, False),
    ('{"GPSLatitude":[40.0,26.0,46.0]}', True, False),
    ('{"2":[40.0,26.0,46.0]}', True, True),
    ("12", True, False),
)


@query(
    "c19_gps_filter",
    "WITH cases AS (SELECT * FROM (VALUES "
    + ", ".join(
        "({}, '{}', {}, {})".format(i, value.replace("'", "''"), kept, twin)
        for i, (value, kept, twin) in enumerate(GPS_CASES)
    )
    + """) AS v(i, value, kept, twin_kept))
SELECT p_partkey AS image_id, value, kept, twin_kept FROM part JOIN cases ON i = p_partkey % 8""",
)
def gps_filter(spark, sf_dir):
    values = F.array(*[F.lit(value) for value, _, _ in GPS_CASES])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        F.element_at(values, (F.col("p_partkey") % 8 + 1).cast("int")).alias("value"),
    )
    return rows.withColumns(
        {
            "kept": exif.valid_gps(F.col("value")),
            "twin_kept": exif.valid_gps_twin(F.col("value")),
        }
    )
