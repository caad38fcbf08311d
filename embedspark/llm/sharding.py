"""Shards of bounded size by extendible hashing.

A row's address is a string of bits. The directory starts with one bucket, the empty prefix. A bucket
whose rows take more bytes than the limit is split on the next bit, others stay; so a shard is the
shortest prefix whose rows fit while those of the prefix before it do not.

The first 60 bits come from the key's md5, the next 60 from the text's, the last 60 from a recorded
row number, so that even copies of one row (a hot key) are split. A single row above the limit stands alone
in a shard of the full depth and is the only case that does not fit. Null keys hash as the empty
string. An empty table gives no rows.

What a row weighs is up to the caller: ``assign_shards`` alone counts the text's bytes (null texts have
0), ``write_shards`` counts ``row_bytes``, all columns before compression and a fixed weight per row.

Sizes are summed per prefix of a few bits more than needed on average, before anything moves; only
rows in leaves that are still too large go through another, deeper round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from embedspark.llm.common import discard, recording, written


_WORD = 60
_ROW_BYTES = 8


def row_bytes(docs: DataFrame) -> Column:
    """Bytes of all columns before compression, nested ones as JSON, and 8 for the row itself."""
    total = F.lit(_ROW_BYTES).cast("bigint")
    for field in docs.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
            total += F.coalesce(F.octet_length(column), F.lit(0)) + 4
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total += 16 if isinstance(field.dataType, (T.DecimalType, T.CalendarIntervalType)) else 8
    return total


def _address(value: Column) -> Column:
    """60 bits as a string."""
    number = F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.lpad(F.bin(number), _WORD, "0")


def _prefix(depth: int) -> Column:
    parts = [F.substring(f"bits{i}", 1, max(0, min(_WORD, depth - i * _WORD))) for i in range(3) if depth > i * _WORD]
    return F.concat(*parts) if parts else F.lit("")


def _buckets(leaves: DataFrame, limit: int, above: int, depth: int) -> DataFrame:
    """Every leaf with its shard; null where the leaf itself is too large.

    ``leaves`` has leaf, bytes, n; all leaves lie below prefixes of ``above`` bits that are too large.
    """
    depths = F.sequence(F.lit(above + (above > 0)), F.lit(depth))
    nodes = leaves.select("leaf", "bytes", "n", F.explode(depths).alias("depth"))
    nodes = nodes.withColumn("shard", F.expr("substring(leaf, 1, depth)"))
    sizes = nodes.groupBy("shard", "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = written(sizes.where(F.col("shard_bytes") <= limit))
    found = nodes.select("leaf", "shard").join(fits, "shard")
    # The shortest prefix that fits.
    best = found.groupBy("leaf").agg(F.min("depth").alias("depth"))
    return best.withColumn("shard", F.expr("substring(leaf, 1, depth)")).join(fits, ["shard", "depth"])


def assign_shards(
    docs: DataFrame,
    limit: int,
    key: str = "doc_id",
    text: str = "text",
    weight: Column | None = None,
    row: Column | None = None,
) -> DataFrame:
    """doc_id, row (recorded number), shard (prefix bits), depth, shard_bytes, shard_rows.

    ``weight`` is a row's bytes, by default the text's. ``row`` is a number that the table has already.
    """
    weight = F.coalesce(F.octet_length(text), F.lit(0)) if weight is None else weight
    rows = docs.select(
        F.col(key).alias("doc_id"),
        weight.cast("bigint").alias("bytes"),
        _address(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("bits0"),
        _address(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("bits1"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    rows = written(rows.withColumn("bits2", _address(F.col("row").cast("string"))))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, above = max(0, math.ceil(math.log2(max(1, total) / limit))) + 4, 0
    result = None
    while True:
        depth = min(depth, 3 * _WORD)
        placed = rows.withColumn("leaf", _prefix(depth))
        leaves = written(placed.groupBy("leaf").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
        shards = _buckets(leaves, limit, above, depth)
        if depth == 3 * _WORD:  # rows above the limit, each alone
            alone = leaves.where(F.col("bytes") > limit).select(
                F.col("leaf").alias("shard"),
                F.lit(depth).alias("depth"),
                "leaf",
                F.col("bytes").alias("shard_bytes"),
                F.col("n").alias("shard_rows"),
            )
            shards = shards.unionByName(alone)
        shards = written(shards)
        done = placed.join(shards, "leaf").select("doc_id", "row", "shard", "depth", "shard_bytes", "shard_rows")
        result = done if result is None else result.unionByName(done)
        large = leaves.where(F.col("bytes") > limit)
        if depth == 3 * _WORD or large.isEmpty():
            return result
        rows = written(placed.join(large.select("leaf"), "leaf", "left_semi").drop("leaf"))
        above, depth = depth, depth + 12


def write_shards(docs: DataFrame, folder: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """The rows of every shard as Parquet in a folder of its own; no task writes more than one shard at once.

    Rows find their shard by a written number, so keys may be null or repeated. The limit holds for ``row_bytes``.
    """
    with recording() as folders:
        numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), codec="zstd")
        found = assign_shards(numbered, limit, key, text, row_bytes(docs), F.col("_row"))
        found = found.select(F.col("row").alias("_row"), F.concat(F.lit("b"), "shard").alias("shard"))
        placed = numbered.join(found, "_row").select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns], "shard")
        placed.repartition("shard").write.partitionBy("shard").parquet(folder)
    discard(docs.sparkSession, folders)
