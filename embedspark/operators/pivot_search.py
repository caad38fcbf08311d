"""Exact top-k similarity search that visits only the cells whose bound can reach the k best.

The corpus falls into cells around pivots, each row to the pivot nearest to it. For a query q and a row c of the cell with pivot
p and radius r (the largest distance of a row from p), Cauchy and Schwarz give q.c = q.p + q.(c - p) <= q.p + |q| r: the
triangle inequality in the form that inner products of any length need. First each query visits the cells of its
nearest pivots that hold k rows together, which gives it a k-th best score. Then it visits those other cells whose bound reaches that
score. Bounds are widened by the rounding of scores, so ties are kept and the result equals that of all pairs.

How much is pruned depends on the data: clustered vectors leave few cells, vectors without any
structure leave all, and the work is then that of a grid of blocks. ``visits`` reports it per query.

At most ``max_pivots`` pivots travel to the tasks. Cells near each other share a block of about ``block_rows`` rows, and a larger
cell has several, so a cell with a third of all rows is many groups; so are the queries of a block. A query travels once to each block with a
cell that it visits, and meets only the rows of these cells there. Scores of pairs stay inside the tasks; k rows per query leave a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embedspark.operators.search import _SCHEMA, _best, _candidates, _matrix, _rows_at_once
from embedspark.session import written

_VISIT = "id bigint, vector array<double>, kth double, block int, part int"
_SAFETY = 1e-9
_QUERIES = 1024  # that are held against all pivots together


@dataclass(frozen=True)
class Cells:
    """Pivots, and by cell the radius and the number of rows."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def blocks(self, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """By cell its first block and the number of its blocks; neighbours on the pivots' main axis share one."""
        middle = self.pivots - self.pivots.mean(axis=0)
        axis = np.linalg.svd(middle, full_matrices=False)[2][0]
        first, many = np.zeros(len(self.rows), "i8"), np.ones(len(self.rows), "i8")
        block, held = 0, 0
        for cell in np.argsort(middle @ axis, kind="stable").tolist():
            rows = int(self.rows[cell])
            if held and held + rows > block_rows:
                block, held = block + 1, 0
            first[cell], many[cell] = block, max(1, -(-rows // block_rows))
            held += rows
            if many[cell] > 1:
                block, held = block + int(many[cell]), 0
        return first, many

    def home(self, near: np.ndarray, k: int) -> np.ndarray:
        """Per query (row of scores against the pivots) the cells that are visited first."""
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return first & (self.rows > 0)

    def reachable(self, near: np.ndarray, norms: np.ndarray, kth: np.ndarray, digits: int) -> np.ndarray:
        bound = near + norms[:, None] * self.radius
        return (bound + _SAFETY >= kth[:, None] - 0.5 * 10.0**-digits) & (self.rows > 0)


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot nearest to each vector, and its distance."""
    cell = np.argmin((pivots**2).sum(axis=1) - 2 * (vectors @ pivots.T), axis=1)
    return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(axis=1))


def _assign(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = _nearest(_matrix(batch.column(1)), pivots)
                columns = [batch.column(0), batch.column(1), pa.array(cell.astype("i4")), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cell", "distance"])

    return assign


def _wanted(q: np.ndarray, kth: np.ndarray, cells: Cells, k: int, digits: int, again: bool) -> np.ndarray:
    """Queries by cells: which ones are visited in this round."""
    near = q @ cells.pivots.T
    first = cells.home(near, k)
    if not again:
        return first
    return cells.reachable(near, np.sqrt((q**2).sum(axis=1)), kth, digits) & ~first


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, _QUERIES):
            part = batch.slice(first, _QUERIES)
            yield part, _matrix(part.column(1)), np.asarray(part.column(2).fill_null(-np.inf))


def _visits(cells: Cells, k: int, digits: int, again: bool, members: np.ndarray, parts: np.ndarray):
    """One row per query and block with a cell it visits."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, q, kth in _in_parts(batches):
            query, block = np.nonzero(_wanted(q, kth, cells, k, digits, again).astype("f4") @ members > 0)
            part = np.asarray(batch.column(0))[query] % parts[block]
            rows = pa.array(query)
            columns = [batch.column(i).take(rows) for i in range(3)] + [pa.array(x.astype("i4")) for x in (block, part)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "kth", "block", "part"])

    return visit


def _reaching(q_ids, q, kth, c_ids, c, digits):
    """Pairs whose rounded score reaches the query's k-th best."""
    scores = q @ c.T
    query, item = np.nonzero(scores >= (kth - 10.0**-digits)[:, None])
    score = np.round(scores[query, item], digits) + 0.0
    good = score >= kth[query]
    return q_ids[query[good]], c_ids[item[good]], score[good]


def _search_block(cells: Cells, k: int, digits: int, again: bool):
    """The best rows of a block for its queries: each meets only the cells that it visits."""

    def search(key, queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        corpus = corpus.sort_values("cell", kind="stable")
        c, c_ids, cell = np.stack(corpus["vector"].to_numpy()), corpus["id"].to_numpy(), corpus["cell"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends, parts = np.r_[starts[1:], len(cell)], []
        for at in range(0, len(queries), _QUERIES):
            some = queries.iloc[at : at + _QUERIES]
            q, q_ids = np.stack(some["vector"].to_numpy()), some["id"].to_numpy()
            kth = some["kth"].fillna(-np.inf).to_numpy()
            wanted = _wanted(q, kth, cells, k, digits, again)
            best = None
            for start, end in zip(starts.tolist(), ends.tolist()):
                asked = np.flatnonzero(wanted[:, cell[start]])
                step = _rows_at_once(len(asked))
                for first in range(start, end, step) if len(asked) else ():
                    rows = slice(first, min(first + step, end))
                    if again:  # the first cells' k-th score leaves few pairs
                        found = _reaching(q_ids[asked], q[asked], kth[asked], c_ids[rows], c[rows], digits)
                    else:
                        found = _candidates(q_ids[asked], q[asked], c_ids[rows], c[rows], k, digits)
                    best = found if best is None else tuple(np.concatenate(pair) for pair in zip(best, found))
                    if len(best[0]) > 64 * k * _QUERIES:
                        best = _best(*best, k)
            if best is not None:
                parts.append(_best(*best, k))
        columns = [np.concatenate(column) for column in zip(*parts)] if parts else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), columns)))

    return search


def _visited(cells: Cells, k: int, digits: int):
    """How many cells each query visits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, q, kth in _in_parts(batches):
            visited = sum(_wanted(q, kth, cells, k, digits, again).sum(axis=1) for again in (False, True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(visited.astype("i4"))], names=["query_id", "visited"])

    return count


def _block_counts(cells: Cells, k: int, digits: int, again: bool, members: np.ndarray):
    """How many queries of a task go to each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(members.shape[1], "i8")
        for _, q, kth in _in_parts(batches):
            total += (_wanted(q, kth, cells, k, digits, again).astype("f4") @ members > 0).sum(axis=0)
        block = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.astype("i4")), pa.array(total[block])], names=["block", "n"])

    return count


def _visit(queries: DataFrame, corpus: DataFrame, cells: Cells, k: int, digits: int, again: bool, block_rows: int) -> DataFrame:
    """The best rows of all visited cells: query_id, item_id, score."""
    first, many = cells.blocks(block_rows)
    members = np.zeros((len(first), int((first + many).max())), "f4")
    for cell in range(len(first)):
        members[cell, first[cell] : first[cell] + many[cell]] = 1
    counts = queries.mapInArrow(_block_counts(cells, k, digits, again, members), "block int, n bigint")
    asked = {r["block"]: r["n"] for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # a row a block
    parts = np.array([max(1, -(-asked.get(block, 0) // block_rows)) for block in range(members.shape[1])])
    left = queries.mapInArrow(_visits(cells, k, digits, again, members, parts), _VISIT)

    def of(numbers: np.ndarray, place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), place + 1)

    # A block's rows go there once for each part of the queries that ask for it.
    block = of(first, F.col("cell")) + F.pmod(F.xxhash64("id"), of(many, F.col("cell"))).cast("int")
    right = corpus.select("id", "vector", "cell", block.alias("block")).where(F.col("block").isin(sorted(asked)))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), of(parts, F.col("block")) - 1)))
    keys = ["block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_block(cells, k, digits, again), _SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pruned_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str,
    item_id: str,
    vector: str = "embedding",
    digits: int = 6,
    cell_rows: int = 1024,
    max_pivots: int = 1024,
    block_rows: int = 8192,
) -> tuple[DataFrame, DataFrame]:
    """The k most similar corpus items of every query (query_id, rank, item_id, score), and its visits (query_id, cells, visited).

    Scores are rounded to ``digits``, ties go to the lower id. Rows without a vector take no part; ids of queries and items
    are unique and not negative. Both tables are written once, as they are read several times.
    """

    def side(df: DataFrame, key: str) -> DataFrame:
        own = F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector")
        return written(df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), own))

    q, c = side(queries, query_id), side(corpus, item_id)
    number = min(max_pivots, math.ceil(c.count() / cell_rows))
    empty = q.sparkSession.createDataFrame([], "query_id bigint, rank int, item_id bigint, score double")
    if not number:
        return empty, q.select(F.col("id").alias("query_id"), F.lit(0).alias("cells"), F.lit(0).alias("visited"))
    # Pivots are rows drawn by a hash of their id: max_pivots vectors at most.
    drawn = c.orderBy(F.xxhash64("id"), "id").limit(number).select("vector").toArrow().combine_chunks()
    pivots = _matrix(drawn.column(0).combine_chunks())
    c = written(c.mapInArrow(_assign(pivots), "id bigint, vector array<double>, cell int, distance double"))
    stats = c.groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).collect()
    radius, rows = np.zeros(number), np.zeros(number, "i8")
    for r in stats:
        radius[r["cell"]], rows[r["cell"]] = r["radius"], r["rows"]
    cells = Cells(pivots, radius, rows)

    unknown = q.withColumn("kth", F.lit(None).cast("double"))
    first = written(_ranked(_visit(unknown, c, cells, k, digits, False, block_rows), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    q = written(q.join(kth, "id", "left").select("id", "vector", "kth"))
    more = _visit(q, c, cells, k, digits, True, block_rows)
    found = _ranked(first.select("query_id", "item_id", "score").unionByName(more), k)
    visited = q.mapInArrow(_visited(cells, k, digits), "query_id bigint, visited int")
    full = int((rows > 0).sum())
    return found.select("query_id", "rank", "item_id", "score"), visited.select("query_id", F.lit(full).alias("cells"), "visited")
