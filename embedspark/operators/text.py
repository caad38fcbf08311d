"""Text operators: request defaults, batches, validation, admission, embedding, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.constants import DEFAULT_DIM, DEFAULT_PREFIX, MAX_TEXT_BATCH
from embedspark.functions.payload import BAD_REQUEST, OK, status
from embedspark.functions.text import prefixed, token_hash, tokens
from embedspark.operators.encoders import HashingTextEncoder


def text_requests(df: DataFrame) -> DataFrame:
    """Request rows with the default dimension and prefix filled in."""
    return df.withColumns(
        {
            "dim": F.coalesce("dim", F.lit(DEFAULT_DIM)),
            "prefix": F.coalesce("prefix", F.lit(DEFAULT_PREFIX)),
        }
    )


def dim_status(dim: Column, width: int = DEFAULT_DIM) -> Column:
    """Outcome of checking a requested dimension against 1..width."""
    message = F.concat(F.lit(f"dim must be between 1 and {width}, got "), dim.cast("string"))
    return F.when(dim.between(1, width), status(OK)).otherwise(status(BAD_REQUEST, message))


def aliased(df: DataFrame, target: str, *names: str) -> DataFrame:
    """One column from several equivalent input names; the first non-null one is taken."""
    present = [name for name in names if name in df.columns]
    rest = [c for c in df.columns if c not in present]
    return df.select(*rest, F.coalesce(*present).alias(target))


def unnest_batches(df: DataFrame, items: str, item: str = "input") -> DataFrame:
    """One row per list element with its position from 0; empty lists give no rows."""
    others = [c for c in df.columns if c != items]
    return df.select(*others, F.posexplode(items).alias("pos", item))


def assemble_batches(
    df: DataFrame, key: str, pos: str, columns: list[str], max_batch: int = MAX_TEXT_BATCH
) -> DataFrame:
    """Ordered lists per batch key, with ``batch_size``; oversized batches have NULL lists.

    A batch may hold any number of rows, so the rows beyond ``max_batch + 1`` are cut before the
    shuffle (window group limit) and never collected: such a batch is rejected as a whole, and its
    true size comes from a separately combined count.
    """
    ordered = Window.partitionBy(key).orderBy(pos)
    listed = (
        df.select(key, pos, *columns)
        .withColumn("_rank", F.row_number().over(ordered))
        .where(F.col("_rank") <= max_batch + 1)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("_items"))
    )
    sizes = df.groupBy(key).agg(F.count("*").alias("batch_size"))
    fits = F.col("batch_size") <= max_batch
    return sizes.join(listed, key).select(
        key,
        "batch_size",
        *[F.when(fits, F.col(f"_items.{name}")).alias(name) for name in columns],
    )


def admission_status(batch_size: Column, quantized: Column, max_batch: int) -> Column:
    """Batch rules in order: no batching for quantized text models, then the size limit."""
    too_big = F.concat(
        F.lit("Batch size "),
        batch_size.cast("string"),
        F.lit(f" exceeds maximum allowed batch size of {max_batch}"),
    )
    return (
        F.when(
            quantized & (batch_size > 1),
            status(BAD_REQUEST, "Batching is not supported for quantized text models"),
        )
        .when(batch_size > max_batch, status(BAD_REQUEST, too_big))
        .otherwise(status(OK))
    )


def model_variant(path: Column) -> Column:
    """Quantized if the lower-cased file name names a quantized form, else Full."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.rlike("quantized|int8|uint8"), F.lit("Quantized")).otherwise(F.lit("Full"))


def embed_texts(
    df: DataFrame,
    text: str = "input",
    encoder=None,
    prefix: Column | None = None,
    dim: int | Column | None = None,
) -> DataFrame:
    """Adds ``tokens`` and ``embedding``: prefix, encode, mean-pool, unit length, truncate.

    No shuffle: every step works on the row. Filter before calling, because Spark does not push
    filters below Python stages.
    """
    encoder = encoder or HashingTextEncoder()
    fixed = dim if isinstance(dim, int) else None
    source = prefixed(F.lit(DEFAULT_PREFIX) if prefix is None else prefix, F.col(text))
    out = df.withColumn("_encoded", encoder.encode(source, dim=fixed))
    vector = F.col("_encoded.embedding")
    if isinstance(dim, Column):
        vector = F.slice(vector, 1, dim)
    return out.withColumns({"tokens": F.col("_encoded.tokens"), "embedding": vector}).drop("_encoded")


def embed_distinct_texts(df: DataFrame, text: str = "input", **options) -> DataFrame:
    """``embed_texts`` that encodes every distinct text once; pays off for costly encoders.

    Copies collapse before the shuffle (the key determines the text, so both group by hash); the join back sends only the rows without their text, and
    a text shared by very many rows is split by adaptive skew handling.
    """
    keyed = df.withColumn("_text_key", F.sha2(F.col(text).cast("binary"), 256))
    unique = keyed.select("_text_key", text).distinct()
    encoded = embed_texts(unique, text, **options).drop(text)
    return keyed.join(encoded, "_text_key", "left").drop("_text_key")


def hashed_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Long form of the offline encoder's input: one row per token with position and hash.

    The outer form with a filter behind it keeps the optimizer from inferring a filter on the token
    array, which would tokenise every text twice.
    """
    exploded = df.select(*keys, F.posexplode_outer(tokens(F.col(text))).alias("token_idx", "token"))
    return exploded.where(F.col("token").isNotNull()).withColumn("hash", token_hash(F.col("token")))


def token_ids(text: Column, vocabulary: int = 30522) -> Column:
    """Stand-in token ids (first hash modulo a vocabulary size) framed by the two special ids."""
    ids = F.transform(tokens(text), lambda t: F.pmod(token_hash(t), F.lit(vocabulary)))
    return F.concat(F.array(F.lit(101).cast("bigint")), ids, F.array(F.lit(102).cast("bigint")))


def pad_batches(df: DataFrame, batch: str, ids: str = "ids") -> DataFrame:
    """Pads ids, type ids and masks with zeros to the longest member of the batch.

    The longest length is a combined aggregate joined back, so one huge batch is neither sorted
    nor held in a single window.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("padded_length"))
    joined = df.join(longest, batch)
    missing = F.col("padded_length") - F.size(ids)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), missing)
    own = F.array_repeat(F.lit(1).cast("bigint"), F.size(ids))
    return joined.withColumns(
        {
            "padded_ids": F.concat(F.col(ids), zeros),
            "type_ids": F.array_repeat(F.lit(0).cast("bigint"), F.col("padded_length")),
            "mask": F.concat(own, zeros),
        }
    )


def pool_tokens(df: DataFrame, keys: list[str], tokens_counted: str = "token_count") -> DataFrame:
    """Masked mean of hashed tokens in long form: one row per (key, slot) that is not empty.

    ``df`` has slot, sign, mask and the number of positions with a positive mask. Tokens of one row
    combine before the shuffle to at most one row per slot.
    """
    return (
        df.where(F.col("mask") > 0)
        .groupBy(*keys, tokens_counted, "slot")
        .agg(F.sum("sign").alias("total"))
        .select(*keys, "slot", (F.col("total") / F.col(tokens_counted)).alias("value"))
    )
