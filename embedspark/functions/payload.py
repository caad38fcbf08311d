"""Payload expressions: what kind of content a string is, and how to get its bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embedspark.constants import MAX_IMAGE_BYTES

OK = 200
BAD_REQUEST = 400


def status(code: int | Column, message: Column | str | None = None) -> Column:
    """Row-level outcome: STRUCT<code INT, message STRING>."""
    text = F.lit(None).cast("string") if message is None else message
    return F.struct(
        (F.lit(code) if isinstance(code, int) else code).cast("int").alias("code"),
        (F.lit(text) if isinstance(text, str) else text).alias("message"),
    )


def content_kind(content: Column) -> Column:
    """url, data_url or base64, by a case-sensitive prefix test."""
    return (
        F.when(content.startswith("http://") | content.startswith("https://"), F.lit("url"))
        .when(content.startswith("data:"), F.lit("data_url"))
        .when(content.isNotNull(), F.lit("base64"))
    )


def encoded_part(content: Column) -> Column:
    """Base64 text of a payload: after the first comma for data URLs, all of it otherwise.

    NULL for URLs and for data URLs without a comma.
    """
    comma = F.instr(content, ",")
    kind = content_kind(content)
    return F.when(
        (kind == "data_url") & (comma > 0), F.substring(content, comma + 1, F.length(content))
    ).when(kind == "base64", content)


def decoded_bytes(encoded: Column) -> Column:
    """Bytes of base64 text, NULL when the text is not valid base64."""
    return F.try_to_binary(encoded, F.lit("base64"))


def decode_status(content: Column, payload: Column) -> Column:
    """Outcome of resolving an inline payload whose decoded bytes are ``payload``."""
    kind = content_kind(content)
    no_comma = (kind == "data_url") & (F.instr(content, ",") == 0)
    return (
        F.when(no_comma, status(BAD_REQUEST, "Invalid data URL format"))
        .when((kind == "data_url") & payload.isNull(), status(BAD_REQUEST, "Invalid base64 in data URL"))
        .when((kind == "base64") & payload.isNull(), status(BAD_REQUEST, "Invalid base64"))
        .otherwise(status(OK))
    )


def size_status(length: Column, limit: int = MAX_IMAGE_BYTES) -> Column:
    """Rejects payloads longer than the limit; exactly the limit passes."""
    message = F.concat(
        F.lit("Image too large: "),
        length.cast("string"),
        F.lit(f" bytes (max {limit // (1024 * 1024)} MB)"),
    )
    return F.when(length > limit, status(BAD_REQUEST, message)).otherwise(status(OK))


def image_format(payload: Column) -> Column:
    """jpeg, png, gif or webp from the leading bytes, NULL for anything else."""
    head = F.hex(F.substring(payload, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
        .when(
            head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp")
        )
    )
