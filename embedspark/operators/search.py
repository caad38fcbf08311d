"""Exact top-k similarity search between two tables of unit vectors.

Scores of all pairs are computed in numpy blocks inside the tasks; only k rows per query leave a
task, so pairs are never rows. Two ways to bring the tables together:

* the query block is broadcast, if its measured size stays within ``max_broadcast_bytes``;
* otherwise both tables are cut into blocks of bounded size and each cell of the grid of
  (query block, corpus block) is one task group.

Scores are rounded to ``digits`` before ranking, ties go to the lower id: the order does not depend
on how the blocks were cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embedspark.constants import BROADCAST_BYTES
from embedspark.functions.arrow import blocks

_SCORES = 1 << 22
_SCHEMA = "query_id bigint, item_id bigint, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    parts = list(blocks(column))
    if len(parts) != 1 or len(parts[0][0]) != len(column):
        raise ValueError("vectors must be present and of equal width")
    return parts[0][1]


def _rows_at_once(n_queries: int) -> int:
    """Corpus rows per score block, so that a block holds about ``_SCORES`` scores."""
    return max(1, _SCORES // max(1, n_queries))


def _candidates(q_ids, q, c_ids, c, k, digits):
    """Top k of every query among one corpus block, ties at the border included."""
    scores = q @ c.T
    np.round(scores, digits, out=scores)
    scores += 0.0
    if scores.shape[1] > k:
        border = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        query, item = np.nonzero(scores >= border[:, None])
    else:
        query, item = np.nonzero(np.ones_like(scores, dtype=bool))
    return _best(q_ids[query], c_ids[item], scores[query, item], k)


def _best(query, item, score, k):
    """k best rows per query by (score descending, item ascending)."""
    order = np.lexsort((item, -score, query))
    query, item, score = query[order], item[order], score[order]
    starts = np.r_[True, query[1:] != query[:-1]]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - first < k
    return query[keep], item[keep], score[keep]


def _search_partition(block, k, digits):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = block.value
        best = None
        for batch in batches if len(q_ids) else ():
            step = _rows_at_once(len(q_ids))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                c_ids = part.column(0).to_numpy(zero_copy_only=False)
                found = _candidates(q_ids, q, c_ids, _matrix(part.column(1)), k, digits)
                if best is not None:
                    found = _best(*(np.concatenate(pair) for pair in zip(best, found)), k)
                best = found
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(part) for part in best], names=["query_id", "item_id", "score"]
            )

    return search


def _search_cell(k, digits):
    def search(key, queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        q = np.stack(queries["vector"].to_numpy()).astype("f8")
        q_ids = queries["id"].to_numpy()
        ids, best = corpus["id"].to_numpy(), None
        step = _rows_at_once(len(q_ids))
        for first in range(0, len(corpus), step):
            rows = slice(first, first + step)
            c = np.stack(corpus["vector"].to_numpy()[rows]).astype("f8")
            found = _candidates(q_ids, q, ids[rows], c, k, digits)
            if best is not None:
                found = _best(*(np.concatenate(pair) for pair in zip(best, found)), k)
            best = found
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), best)))

    return search


def _grid_search(queries, corpus, n_queries, k, digits, block_rows):
    """Both sides in blocks of about ``block_rows`` vectors; every cell is searched on its own."""
    n_corpus = corpus.count()
    q_blocks = max(1, math.ceil(n_queries / block_rows))
    c_blocks = max(1, math.ceil(n_corpus / block_rows))

    def spread(df, own, own_blocks, other, other_blocks):
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        )

    left = spread(queries, "qb", q_blocks, "cb", c_blocks)
    right = spread(corpus, "cb", c_blocks, "qb", q_blocks)
    return (
        left.groupBy("qb", "cb")
        .cogroup(right.groupBy("qb", "cb"))
        .applyInPandas(_search_cell(k, digits), _SCHEMA)
    )


def top_k_neighbors(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str,
    item_id: str,
    vector: str = "embedding",
    digits: int = 6,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = 8192,
) -> DataFrame:
    """The k most similar corpus items of every query: query_id, rank, item_id, score.

    Rows whose vector is NULL take no part on either side.
    """
    q = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    c = corpus.select(F.col(item_id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    q, c = (side.where(F.col("vector").isNotNull()) for side in (q, c))
    # One combined row answers whether the query side is small enough to be sent to every task.
    size = q.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    if (size["rows"] * (size["width"] or 0)) * 8 <= max_broadcast_bytes:
        table = q.toArrow().combine_chunks()
        spark = queries.sparkSession
        ids = table.column("id").to_numpy()
        matrix = (
            _matrix(table.column("vector").combine_chunks()) if len(ids) else np.zeros((0, 1))
        )
        block = spark.sparkContext.broadcast((ids, matrix))
        found = c.mapInArrow(_search_partition(block, k, digits), _SCHEMA)
    else:
        found = _grid_search(q, c, size["rows"], k, digits, block_rows)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "item_id", "score")
    )


def overlap_at_k(found: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Share of common items among the k best of two rankings, per query."""

    def lists(df, name):
        return (
            df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("item_id").alias(name))
        )

    return lists(found, "a").join(lists(other, "b"), "query_id", "full").select(
        "query_id",
        F.coalesce(F.size(F.array_intersect("a", "b")) / F.lit(float(k)), F.lit(0.0)).alias("overlap"),
    )
