"""Payload resolution: inline payloads, fetched payloads, size limits and the fetch cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embedspark.constants import MAX_IMAGE_BYTES
from embedspark.functions import payload as fn


def resolve_inline(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds kind, payload and status of data-URL and base64 contents; URLs stay unresolved."""
    column = F.col(content)
    decoded = df.withColumns(
        {"kind": fn.content_kind(column), "payload": fn.decoded_bytes(fn.encoded_part(column))}
    )
    return decoded.withColumn("status", fn.decode_status(column, F.col("payload")))


def resolve_urls(df: DataFrame, fetched: DataFrame, url: str = "content") -> DataFrame:
    """Adds payload and status from a table of fetched bytes (url, http_status, bytes).

    Fetching itself is not done here. An unknown URL, a status other than 2xx and a body that was
    not read are row errors.
    """
    answers = fetched.select(F.col("url").alias(url), "http_status", F.col("bytes").alias("payload"))
    joined = df.join(answers, url, "left")
    code = F.col("http_status")
    status = (
        F.when(code.isNull(), fn.status(fn.BAD_REQUEST, "Failed to fetch URL"))
        .when(
            ~code.between(200, 299),
            fn.status(fn.BAD_REQUEST, F.concat(F.lit("URL returned status "), code.cast("string"))),
        )
        .when(F.col("payload").isNull(), fn.status(fn.BAD_REQUEST, "Failed to read image data"))
        .otherwise(fn.status(fn.OK))
    )
    readable = F.when(code.between(200, 299), F.col("payload"))
    return joined.withColumns({"status": status, "payload": readable}).drop("http_status")


def with_size_limit(df: DataFrame, payload: str = "payload", limit: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Replaces the status of payloads above the limit; statistics jobs leave this step out."""
    length = F.octet_length(payload)
    too_large = F.coalesce(length > limit, F.lit(False)) & (F.col("status.code") == fn.OK)
    return df.withColumn(
        "status", F.when(too_large, fn.size_status(length, limit)).otherwise(F.col("status"))
    )


def cache_key(image: Column, w: Column, h: Column) -> Column:
    return F.concat(F.lit("image_"), image.cast("string"), F.lit("_"), w.cast("string"), F.lit("x"), h.cast("string"))


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; copies combine before the shuffle."""
    columns = [c for c in df.columns if c != key]
    rows = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return rows.select(key, "_last.*")


def to_fetch(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache does not hold."""
    return requests.select(key).distinct().join(cache.select(key), key, "left_anti")
