"""One registered query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embedspark.llm import bin_slack, classifier, line_dedup, merkle, merkle_sql, near_dedup, nearest, packing, periodic_runs, piece_sampling, quality_rules, sharding, suffix_dedup, token_files
from embedspark.llm.common import table
from embedspark.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEQUENCE_TOKENS = 4096
END_ID = 1
SHARD_BYTES = 16 << 20


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to directly addressable files and read back."""
    folder = f"{shared_folder(spark)}/tokens"
    docs = table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_documents(spark, folder).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences by best-two-fit."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut_documents(docs, path, END_ID, SEQUENCE_TOKENS, digests=True)
    return packing.pack(pieces, SEQUENCE_TOKENS).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the rules."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(F.col("_row.doc_id").alias("doc_id"), *[c for c in judged.columns if c != "_row"])


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from positive-unlabelled learning."""
    scored = classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("_row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; shards hold 16 MiB of all columns at most."""
    docs = table(spark, sf_dir, "documents")
    found = sharding.assign_shards(docs, SHARD_BYTES, weight=sharding.row_bytes(docs))
    return found.select("doc_id", "shard", "depth", "shard_bytes", "shard_rows")


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 15 words that an earlier place has already."""
    return line_dedup.dedup_passages(table(spark, sf_dir, "documents"))


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that start at two places."""
    found = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.octet_length("bytes").cast("bigint").alias("n_bytes"),
        (F.octet_length("bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@_query
def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query
def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and a digest of the text that it decodes to."""
    docs = table(spark, sf_dir, "documents")
    sampled = piece_sampling.sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return sampled.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op11_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences by minimum bin slack."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = bin_slack.pack_documents(table(spark, sf_dir, "documents"), path, 2, SEQUENCE_TOKENS, keep_ids=False)
    return packed.drop("ids")


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents; a third of them is checked with its text lower-cased."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = [*columns[:-1], F.translate("text", UPPER, LOWER)]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(
        docs,
        tree=F.col("lang"),
        key=F.col("doc_id"),
        leaf=merkle.digest_of(columns),
        claimed=F.when(changed, merkle.digest_of(lowered)),
    )
    return found.withColumnRenamed("key", "doc_id")


ORACLES["op12_merkle_manifest"] = merkle_sql.manifest_sql(levels=8, head_levels=4)


def _with_planted_period(text: Column, number: Column) -> Column:
    """The text, or for every tenth number its words with a stretch that repeats one period up to the end."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rest = F.floor(number / 10)

    def planted(own: Column) -> Column:
        n = F.size(own)
        first = (rest % n).cast("int")
        period = (F.lit(1) + F.floor((n - first) / (F.lit(3) + rest % 8))).cast("int")
        times = F.ceil((n - first) / period).cast("int")
        repeated = F.flatten(F.array_repeat(F.slice(own, first + 1, period), times))
        return F.concat_ws(" ", F.concat(F.slice(own, F.lit(1), first), F.slice(repeated, F.lit(1), n - first)))

    # The array of one binds the words, so that the text is split once.
    changed = F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, planted(own)).otherwise(text))[0]
    return F.when(number % 10 == 0, changed).otherwise(text)


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents and digests of the collapsed texts; every tenth document gets a planted period."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", _with_planted_period(F.col("text"), number).alias("text"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    found = periodic_runs.collapse_runs(docs, ["doc_id"]).withColumn("longest", longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.col1")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.col1) div longest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
