"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from embedspark.constants import DEFAULT_DIM
from embedspark.functions import vectors
from embedspark.functions.text import hash_sign, hash_slot, prefixed, token_count, tokens
from embedspark.operators import text as ops
from embedspark.operators.encoders import (
    HashingTextEncoder,
    embedding_from_output,
    shape_message,
)
from embedspark.plans.fixtures import hashed_sql, table, wide_table
from embedspark.plans.registry import query, r6, s6

TOKENS_SQL = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(text=text)


# Requests derived from documents: every third has no dimension, every fourth no prefix.
REQUESTS_SQL = """requests AS (
  SELECT doc_id AS request_id, text AS input,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 7 % 1000 END AS dim,
    CASE doc_id % 4 WHEN 1 THEN 'search_document' WHEN 2 THEN 'classification'
      WHEN 3 THEN 'clustering' END AS prefix
  FROM documents)"""


def requests(spark, sf_dir):
    doc = F.col("doc_id")
    return wide_table(spark, sf_dir, "documents").select(
        doc.alias("request_id"),
        F.col("text").alias("input"),
        F.when(doc % 3 != 0, doc * 7 % 1000).alias("dim"),
        F.when(doc % 4 == 1, "search_document")
        .when(doc % 4 == 2, "classification")
        .when(doc % 4 == 3, "clustering")
        .alias("prefix"),
    )


@query(
    "s1_text_request_scan",
    f"""WITH {REQUESTS_SQL}
SELECT request_id, md5(input) AS input_md5, coalesce(dim, 768) AS dim,
  coalesce(prefix, 'search_query') AS prefix FROM requests""",
)
def text_request_scan(spark, sf_dir):
    return ops.text_requests(requests(spark, sf_dir)).select(
        "request_id", F.md5(F.col("input").cast("binary")).alias("input_md5"), "dim", "prefix"
    )


@query(
    "t1_prefix",
    f"""WITH {REQUESTS_SQL}
SELECT request_id, md5(coalesce(prefix, 'search_query') || ': ' || input) AS text_md5,
  length(coalesce(prefix, 'search_query') || ': ' || input) AS text_length FROM requests""",
)
def prefix_query(spark, sf_dir):
    rows = ops.text_requests(requests(spark, sf_dir))
    text = prefixed("prefix", "input")
    return rows.select(
        "request_id",
        F.md5(text.cast("binary")).alias("text_md5"),
        F.length(text).cast("bigint").alias("text_length"),
    )


@query(
    "t2_dim_validation",
    f"""WITH {REQUESTS_SQL}, filled AS (SELECT request_id, coalesce(dim, 768) AS dim FROM requests)
SELECT request_id, CASE WHEN dim BETWEEN 1 AND 768 THEN 200 ELSE 400 END AS code,
  CASE WHEN dim NOT BETWEEN 1 AND 768
    THEN 'dim must be between 1 and 768, got ' || dim END AS message FROM filled""",
)
def dim_validation(spark, sf_dir):
    rows = ops.text_requests(requests(spark, sf_dir))
    return rows.withColumn("status", ops.dim_status(F.col("dim"))).select(
        "request_id", "status.code", "status.message"
    )


@query(
    "t3_token_count",
    f"""SELECT doc_id, len({tokens_sql("text")}) + 2 AS tokens,
  md5(array_to_string({tokens_sql("text")}, ' ')) AS tokens_md5 FROM documents""",
)
def token_count_query(spark, sf_dir):
    words = tokens(F.col("text"))
    return wide_table(spark, sf_dir, "documents").select(
        "doc_id",
        token_count(words).cast("bigint").alias("tokens"),
        F.md5(F.array_join(words, " ").cast("binary")).alias("tokens_md5"),
    )


@query(
    "t4_text_encode",
    f"""WITH {hashed_sql("documents", "doc_id", "text", 256, 256, "docs", "search_document")},
entries AS (SELECT k, slot, value FROM docs_dense)
SELECT k AS doc_id, slot::INT AS slot, {s6("value")} AS value FROM entries WHERE value <> 0""",
)
def text_encode(spark, sf_dir):
    """Unit vectors of all documents through the Arrow encoder, shown as non-zero entries."""
    embedded = ops.embed_texts(
        wide_table(spark, sf_dir, "documents"),
        "text",
        encoder=HashingTextEncoder(256),
        prefix=F.lit("search_document"),
    )
    return (
        embedded.select("doc_id", F.posexplode("embedding").alias("slot", "value"))
        .where(F.col("value") != 0)
        .select("doc_id", "slot", r6("value").alias("value"))
    )


@query(
    "t6_masked_mean_pool",
    f"""WITH words AS (SELECT doc_id, {tokens_sql("text")} AS words FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS token_idx FROM words),
kept AS (SELECT * FROM tokens WHERE token_idx % 3 <> 2),
counts AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT k.doc_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INT AS slot,
  {s6("sum(CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE / any_value(n)")} AS value
FROM kept k JOIN counts c USING (doc_id) GROUP BY k.doc_id, slot""",
)
def masked_mean_pool(spark, sf_dir):
    """Long form of the pool: every third token is masked out."""
    documents = wide_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    words = ops.hashed_tokens(documents, ["doc_id"], "text").select(
        "doc_id",
        hash_slot(F.col("hash"), 64).alias("slot"),
        hash_sign(F.col("hash")).alias("sign"),
        F.when(F.col("token_idx") % 3 == 2, 0).otherwise(1).alias("mask"),
    )
    sums = words.where("mask > 0").groupBy("doc_id", "slot").agg(
        F.sum("sign").alias("total"), F.count("*").alias("n")
    )
    # A document has at most 64 rows by now. Joining their sum back would hash all tokens a second time.
    token_count = F.sum("n").over(Window.partitionBy("doc_id"))
    return sums.select("doc_id", "slot", r6(F.col("total") / token_count).alias("value"))


# Model outputs of five shapes, made from the embeddings: one vector, two forms of one row, four
# tokens per row, and a batch of two that must be refused.
OUTPUTS_SQL = """outputs AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, CASE vec_id % 5 WHEN 0 THEN [64] WHEN 1 THEN [1, 64]
    WHEN 2 THEN [1, 4, 64] WHEN 3 THEN [4, 64] ELSE [2, 4, 64] END AS shape,
    CASE WHEN vec_id % 5 < 2 THEN 1 ELSE 4 END AS t FROM embeddings)"""


def outputs(spark, sf_dir):
    kind = F.col("vec_id") % 5
    vector = F.transform("embedding", lambda x: x.cast("double"))

    def scaled(factor):
        return F.transform(vector, lambda x: x * factor)

    four = F.concat(*[scaled(i + 1) for i in range(4)])

    def shape(*dims):
        return F.array(*[F.lit(d) for d in dims])

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(kind < 2, vector).otherwise(four).alias("flat"),
        F.when(kind == 0, shape(64))
        .when(kind == 1, shape(1, 64))
        .when(kind == 2, shape(1, 4, 64))
        .when(kind == 3, shape(4, 64))
        .otherwise(shape(2, 4, 64))
        .alias("shape"),
        # Positions 0, 1 and 3 count; position 2 is padding.
        shape(1, 1, 0, 1).alias("mask"),
    )


@query(
    "t5_shape_dispatch",
    f"""WITH {OUTPUTS_SQL}
SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN 'Unexpected embedding shape: [2, 4, 64]' END AS error,
  CASE WHEN vec_id % 5 < 4 THEN {s6("(CASE WHEN t = 1 THEN v[1] ELSE (v[1] + v[1] * 2 + v[1] * 4) / 3 END)::FLOAT")} END AS first_value,
  CASE WHEN vec_id % 5 < 4 THEN {s6("list_sum(v) * CASE WHEN t = 1 THEN 1 ELSE 7.0/3 END", 4)} END AS total
FROM outputs""",
)
def shape_dispatch(spark, sf_dir):
    rows = outputs(spark, sf_dir).withColumn(
        "pooled", embedding_from_output(F.col("flat"), F.col("shape"), F.col("mask"), 64)
    )
    total = F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(
        "vec_id",
        F.when(F.col("pooled").isNull(), shape_message(F.col("shape"))).alias("error"),
        r6(F.element_at("pooled", 1)).alias("first_value"),
        r6(total, 4).alias("total"),
    )


@query(
    "t7_l2_normalise",
    f"""WITH scaled AS (SELECT vec_id, list_transform(embedding,
    lambda x: x::DOUBLE * CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 + vec_id % 7 END) AS v FROM embeddings),
measured AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM scaled)
SELECT vec_id, {s6("n", 5)} AS norm_before,
  {s6("CASE WHEN n > 1e-9 THEN 1 ELSE n END")} AS norm_after,
  {s6("(CASE WHEN n > 1e-9 THEN v[1] / n ELSE v[1] END)::FLOAT")} AS first_value,
  {s6("(CASE WHEN n > 1e-9 THEN v[64] / n ELSE v[64] END)::FLOAT")} AS last_value FROM measured""",
)
def l2_normalise(spark, sf_dir):
    """Vectors scaled by 0 to 7 first, so that the zero-length guard is used."""
    factor = F.when(F.col("vec_id") % 10 == 0, 0).otherwise(1 + F.col("vec_id") % 7)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * factor).alias("v")
    )
    unit = rows.withColumn("unit", vectors.l2_normalize("v"))
    return unit.select(
        "vec_id",
        r6(vectors.norm("v"), 5).alias("norm_before"),
        r6(vectors.norm("unit")).alias("norm_after"),
        r6(F.element_at("unit", 1)).alias("first_value"),
        r6(F.element_at("unit", 64)).alias("last_value"),
    )


@query(
    "t8_truncate",
    f"""WITH dims AS (SELECT vec_id, embedding AS v, 1 + vec_id % 80 AS dim FROM embeddings)
SELECT vec_id, dim, least(dim, 64) AS width, {s6("v[least(dim, 64)]")} AS last_value,
  {s6("sqrt(list_sum(list_transform(v[1:dim], lambda x: x::DOUBLE * x)))")} AS norm FROM dims""",
)
def truncate_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("dim", 1 + F.col("vec_id") % 80)
    cut = rows.withColumn("cut", vectors.truncate("embedding", F.col("dim").cast("int")))
    return cut.select(
        "vec_id",
        "dim",
        F.size("cut").cast("bigint").alias("width"),
        r6(F.element_at("cut", -1)).alias("last_value"),
        r6(vectors.norm("cut")).alias("norm"),
    )


@query(
    "t9_truncate_renormalise",
    f"""WITH dims AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest([64, 32, 16, 8]) AS dim FROM embeddings),
cut AS (SELECT vec_id, dim, v[1:dim] AS v,
  sqrt(list_sum(list_transform(v[1:dim], lambda x: x * x))) AS n FROM dims)
SELECT vec_id, dim::INT AS dim, {s6("n")} AS norm_before, {s6("(v[1] / n)::FLOAT")} AS first_value,
  {s6("(v[2] / n)::FLOAT")} AS second_value, {s6("(v[3] / n)::FLOAT")} AS third_value FROM cut""",
)
def truncate_renormalise(spark, sf_dir):
    widths = F.array(*[F.lit(d) for d in (64, 32, 16, 8)])
    cut = (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", F.explode(widths).alias("dim"))
        .withColumn("cut", vectors.truncate("embedding", F.col("dim")))
        .withColumn("unit", vectors.l2_normalize("cut"))
    )
    return cut.select(
        "vec_id",
        "dim",
        r6(vectors.norm("cut")).alias("norm_before"),
        *[
            r6(F.element_at("unit", i + 1)).alias(name)
            for i, name in enumerate(("first_value", "second_value", "third_value"))
        ],
    )


@query(
    "s2_batch_unnest",
    """SELECT conv_id, turn AS pos, length(text) AS input_length,
  count(*) OVER (PARTITION BY conv_id) AS batch_size FROM conversations""",
)
def batch_unnest(spark, sf_dir):
    """Ordered lists per 16 turns of a conversation, taken apart again with their positions.

    A conversation of any length loses nothing, and no list grows with it.
    """
    turns = wide_table(spark, sf_dir, "conversations")
    part = F.expr("turn div 16")
    chunks = turns.withColumn("chunk", F.struct("conv_id", part.alias("part")))
    lists = ops.assemble_batches(chunks, "chunk", "turn", ["text"], max_batch=2**31 - 2)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("batch_size"))
    rows = ops.unnest_batches(lists.drop("batch_size"), "text").select(
        F.col("chunk.conv_id").alias("conv_id"),
        (F.col("chunk.part") * 16 + F.col("pos")).cast("bigint").alias("pos"),
        F.length("input").cast("bigint").alias("input_length"),
    )
    return rows.join(sizes, "conv_id").select("conv_id", "pos", "input_length", "batch_size")


@query(
    "s3_field_aliases",
    """SELECT doc_id, md5(text) AS input_md5,
  CASE doc_id % 3 WHEN 0 THEN 'inputs' WHEN 1 THEN 'contents' ELSE 'input' END AS given_as
FROM documents""",
)
def field_aliases(spark, sf_dir):
    doc = F.col("doc_id") % 3
    given = wide_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc == 0, F.col("text")).alias("inputs"),
        F.when(doc == 1, F.col("text")).alias("contents"),
        F.when(doc == 2, F.col("text")).alias("input"),
        F.when(doc == 0, "inputs").when(doc == 1, "contents").otherwise("input").alias("given_as"),
    )
    merged = ops.aliased(given, "value", "inputs", "contents", "input")
    return merged.select("doc_id", F.md5(F.col("value").cast("binary")).alias("input_md5"), "given_as")


@query(
    "t10_batch_embed",
    f"""WITH turns AS (SELECT conv_id * 100 + turn AS turn_id, text FROM conversations),
{hashed_sql("turns", "turn_id", "text", DEFAULT_DIM, 32, "emb", "search_document")}
SELECT c.conv_id, count(*) AS items, list(e.tokens ORDER BY c.turn)::VARCHAR AS tokens,
  {s6("sum(list_sum(e.v) * (1 + c.turn))", 4)} AS weighted_total
FROM conversations c JOIN emb e ON e.turn_id = c.conv_id * 100 + c.turn GROUP BY c.conv_id""",
)
def batch_embed(spark, sf_dir):
    """Every turn embedded on its own, then regrouped in order per conversation.

    A conversation may have any number of turns: vectors become numbers before they move, and only
    token counts are listed.
    """
    embedded = ops.embed_texts(
        wide_table(spark, sf_dir, "conversations"), "text", prefix=F.lit("search_document"), dim=32
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    turns = embedded.select(
        "conv_id",
        F.struct("turn", "tokens").alias("item"),
        (F.coalesce(total, F.lit(0.0)) * (1 + F.col("turn"))).alias("weighted"),
    )
    batches = turns.groupBy("conv_id").agg(
        F.count("*").alias("items"),
        F.sort_array(F.collect_list("item")).alias("listed"),
        F.sum("weighted").alias("total"),
    )
    tokens_listed = F.array_join(F.col("listed.tokens").cast("array<string>"), ", ", "NULL")
    return batches.select(
        "conv_id",
        "items",
        F.concat(F.lit("["), tokens_listed, F.lit("]")).alias("tokens"),
        r6("total", 4).alias("weighted_total"),
    )


@query(
    "t11_query_embed",
    f"""WITH {hashed_sql("benchmark", "item_id", "text", DEFAULT_DIM, 128, "q", "search_query")}
SELECT item_id, tokens, {s6("sqrt(list_sum(list_transform(v, lambda x: x * x)))")} AS norm,
  {s6("list_sum(v)", 5)} AS total FROM q""",
)
def query_embed(spark, sf_dir):
    embedded = ops.embed_texts(table(spark, sf_dir, "benchmark"), "text", dim=128)
    return embedded.select(
        "item_id",
        F.col("tokens").cast("bigint").alias("tokens"),
        r6(vectors.norm("embedding")).alias("norm"),
        r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"),
    )


@query(
    "t12_batch_admission",
    """WITH sizes AS (SELECT conv_id, count(*) AS batch_size, conv_id % 3 = 0 AS quantized
  FROM conversations GROUP BY conv_id)
SELECT conv_id, batch_size, quantized,
  CASE WHEN (quantized AND batch_size > 1) OR batch_size > 6 THEN 400 ELSE 200 END AS code,
  CASE WHEN quantized AND batch_size > 1
      THEN 'Batching is not supported for quantized text models'
    WHEN batch_size > 6
      THEN 'Batch size ' || batch_size || ' exceeds maximum allowed batch size of 6' END AS message
FROM sizes""",
)
def batch_admission(spark, sf_dir):
    sizes = (
        wide_table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.count("*").alias("batch_size"))
        .withColumn("quantized", F.col("conv_id") % 3 == 0)
    )
    return sizes.withColumn(
        "status", ops.admission_status(F.col("batch_size"), F.col("quantized"), 6)
    ).select("conv_id", "batch_size", "quantized", "status.code", "status.message")


PATH_SQL = """SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN 'models/txt/model.onnx' WHEN 1 THEN 'models/txt/model_quantized.onnx'
  WHEN 2 THEN 'models/MODEL_INT8.onnx' WHEN 3 THEN 'quantized/' || p_name || '.onnx'
  WHEN 4 THEN p_name || '_UInt8.onnx' ELSE 'int8/' || p_brand || '/' END AS path FROM part"""


@query(
    "t13_variant_detect",
    f"""SELECT p_partkey, path, CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')),
  'quantized|int8|uint8') THEN 'Quantized' ELSE 'Full' END AS variant FROM ({PATH_SQL})""",
)
def variant_detect(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    path = (
        F.when(kind == 0, F.lit("models/txt/model.onnx"))
        .when(kind == 1, F.lit("models/txt/model_quantized.onnx"))
        .when(kind == 2, F.lit("models/MODEL_INT8.onnx"))
        .when(kind == 3, F.concat(F.lit("quantized/"), F.col("p_name"), F.lit(".onnx")))
        .when(kind == 4, F.concat(F.col("p_name"), F.lit("_UInt8.onnx")))
        .otherwise(F.concat(F.lit("int8/"), F.col("p_brand"), F.lit("/")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.withColumn("variant", ops.model_variant(F.col("path")))


PADDING_SQL = f"""ids AS (
  SELECT conv_id, turn, list_concat(list_concat([101::BIGINT], list_transform({tokens_sql("text")},
    lambda t: ('0x' || substr(md5(t), 1, 9))::BIGINT % 30522)), [102::BIGINT]) AS ids FROM conversations),
longest AS (SELECT conv_id, max(len(ids)) AS padded_length FROM ids GROUP BY conv_id)"""


@query(
    "t15_batch_padding",
    f"""WITH {PADDING_SQL}
SELECT i.conv_id, i.turn, len(ids) AS tokens, padded_length,
  list_sum(ids)::BIGINT AS id_total, padded_length - len(ids) AS zeros, len(ids) AS mask_total
FROM ids i JOIN longest USING (conv_id)""",
)
def batch_padding(spark, sf_dir):
    rows = wide_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ops.token_ids(F.col("text")).alias("ids")
    )
    zero = F.lit(0).cast("bigint")
    return ops.pad_batches(rows, "conv_id").select(
        "conv_id",
        "turn",
        F.size("ids").cast("bigint").alias("tokens"),
        F.size("padded_ids").cast("bigint").alias("padded_length"),
        F.aggregate("padded_ids", zero, lambda s, x: s + x).alias("id_total"),
        F.size(F.filter("mask", lambda m: m == 0)).cast("bigint").alias("zeros"),
        F.aggregate("mask", zero, lambda s, x: s + x).alias("mask_total"),
    )


@query(
    "t16_padding_invariance",
    f"""WITH {PADDING_SQL},
items AS (SELECT conv_id, turn, padded_length, len(ids) AS n, unnest(ids) AS id FROM ids JOIN longest USING (conv_id)),
slots AS (SELECT conv_id, turn, any_value(padded_length) AS padded_length, id % 32 AS slot,
  count(*)::DOUBLE / any_value(n) AS value FROM items GROUP BY conv_id, turn, slot)
SELECT conv_id, turn, any_value(padded_length) AS padded_length, 0.0::DOUBLE AS max_abs_diff,
  {s6("sqrt(sum(value * value))")} AS norm FROM slots GROUP BY conv_id, turn""",
)
def padding_invariance(spark, sf_dir):
    """Pools the padded and the plain ids of every turn; the padding must not change the mean."""
    rows = wide_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ops.token_ids(F.col("text")).alias("ids")
    )
    padded = ops.pad_batches(rows, "conv_id")

    def pooled(ids, mask):
        tokens_kept = (
            padded.select("conv_id", "turn", "padded_length", F.explode(F.arrays_zip(ids.alias("id"), mask.alias("m"))).alias("t"))
            .where("t.m > 0")
            .groupBy("conv_id", "turn", "padded_length", (F.col("t.id") % 32).alias("slot"))
            .agg(F.count("*").alias("n"))
        )
        return tokens_kept

    keys = ["conv_id", "turn", "padded_length", "slot"]
    ones = F.array_repeat(F.lit(1).cast("bigint"), F.size("ids"))
    both = pooled(F.col("ids"), ones).withColumnRenamed("n", "plain").join(
        pooled(F.col("padded_ids"), F.col("mask")).withColumnRenamed("n", "with_padding"), keys, "full"
    )
    plain, with_padding = (F.coalesce(c, F.lit(0)) for c in ("plain", "with_padding"))
    return (
        both.groupBy("conv_id", "turn", "padded_length")
        .agg(
            F.max(F.abs(plain - with_padding)).alias("gap"),
            F.sum(plain).alias("n"),
            F.sum(plain * plain).alias("squares"),
        )
        .select(
            "conv_id",
            "turn",
            F.col("padded_length").cast("bigint").alias("padded_length"),
            r6(F.col("gap") / F.col("n")).alias("max_abs_diff"),
            r6(F.sqrt(F.col("squares")) / F.col("n")).alias("norm"),
        )
    )
