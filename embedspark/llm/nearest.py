"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced parts: neighbours pull a
node into their part as long as it has room. A small network then learns, from a vector alone, in which parts its
neighbours lie. Every vector of the table is indexed in its most probable part. A query goes to as many most
probable parts as bring the sample's own neighbours to ``RECALL`` (measured, not assumed), and what lies
there is ranked exactly in double precision.

Sample size, parts and network are bounded (``SAMPLE`` vectors at most); index and search cover every
row. Parts and query sets of any size are cut into blocks, so that a task holds ``BLOCK`` vectors
and ``QUERY_BLOCK`` queries at most. Queries that find too few get all parts.

Vectors that are null, zero, of another width than most, or hold null or non-finite components take no
part, nor do null ids. Rows of one id are candidates each, never for a query of that id. Ties go to the smaller
id. With one part (small tables) the search is exact. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embedspark.llm.common import whole_groups, written

SAMPLE = 8192
PART_SAMPLE = 512
GRAPH_NEIGHBOURS = 10
RECALL = 0.97
BLOCK, QUERY_BLOCK = 2048, 512


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector (doubles): the rows that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    rows = rows.where(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) > 0)
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head(1)
    return rows.where(F.size("vector") == (widths[0]["width"] if widths else 0))


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other rows, for unit rows, block by block."""
    out = np.empty((len(x), k), "i8")
    for at in range(0, len(x), 1024):
        scores = x[at : at + 1024] @ x.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for every node; parts have nearly equal sizes and cut few edges.

    Starts from centres with limited room, then moves nodes to the part that most of their neighbours are
    in, the largest gains first, while that part has room.
    """
    n, random = len(x), np.random.default_rng(seed)
    room = int(np.ceil(1.05 * n / parts))
    centres = x[random.choice(n, parts, replace=False)]
    part = np.zeros(n, "i8")
    for _ in range(8):
        scores = x @ centres.T
        part = _limited(scores, room)
        sums = np.stack([np.bincount(part, weights=x[:, d], minlength=parts) for d in range(x.shape[1])], axis=1)
        centres = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
    for _ in range(rounds):
        pull = np.zeros((n, parts))
        for column in range(near.shape[1]):  # edges count in both directions
            np.add.at(pull, (np.arange(n), part[near[:, column]]), 1)
            np.add.at(pull, (near[:, column], part), 1)
        best = pull.argmax(1)
        gain = pull[np.arange(n), best] - pull[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[best[node]] < room:
                sizes[part[node]] -= 1
                sizes[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if not moved:
            break
    return part


def _limited(scores: np.ndarray, room: int) -> np.ndarray:
    """The best column of every row, at most ``room`` rows a column; the surest rows choose first."""
    order = np.argsort(-(scores.max(1) - np.partition(scores, -2, axis=1)[:, -2]), kind="stable")
    choice, sizes, part = np.argsort(-scores, axis=1), np.zeros(scores.shape[1], "i8"), np.zeros(len(scores), "i8")
    for row in order:
        for column in choice[row]:
            if sizes[column] < room:
                part[row] = column
                sizes[column] += 1
                break
    return part


class Router:
    """Probabilities of parts from a vector, by a network with one hidden layer."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 5, epochs: int = 40, hidden: int = 128):
        random = np.random.default_rng(seed)
        parts = target.shape[1]
        self.weights = [
            random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)),
            np.zeros(hidden),
            random.normal(0, np.sqrt(1 / hidden), (hidden, parts)),
            np.zeros(parts),
        ]
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for at in range(0, len(x), 256):
                rows, step = order[at : at + 256], step + 1
                a, b, c, d = self.weights
                h = np.maximum(x[rows] @ a + b, 0)
                slope = (self._soft(h @ c + d) - target[rows]) / len(rows)
                back = slope @ c.T * (h > 0)
                for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ slope, slope.sum(0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.weights[i] = self.weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Parts of every row, the most probable first."""
        a, b, c, d = self.weights
        return np.argsort(-(np.maximum(x @ a + b, 0) @ c + d), axis=1, kind="stable")


class _OnePart:
    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1), "i8")


def train(rows: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE):
    """router, number of parts, number of parts a query needs; from at most ``sample`` vectors."""
    total = rows.count()
    share = min(1.0, sample / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(sample)
    found = drawn.toArrow().combine_chunks()
    n = found.num_rows
    parts = min(32, n // PART_SAMPLE)
    if parts < 2:
        return _OnePart(), 1, 1
    order = np.argsort(np.asarray(found.column("id").combine_chunks()), kind="stable")
    x = _units(_matrix(found.column("vector").combine_chunks()))[order]
    near = _neighbours(x, GRAPH_NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    # A part of the sample is kept back to measure how many parts a query needs.
    held = np.arange(n) % 5 == 0
    router = Router(x[~held], target[~held])
    order = router.parts(x)
    home = order[:, 0]
    nearest = _neighbours(x, k)
    place = np.argsort(order, axis=1)
    needed = place[np.flatnonzero(held)[:, None], home[nearest[held]]] + 1
    return router, parts, int(np.quantile(needed, recall, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # no overflow for very large or small numbers
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _route(router, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = router.parts(_units(_matrix(batch.column("vector"))))[:, :count]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(best) + 1, dtype="i4") * best.shape[1]), pa.array(best.ravel().astype("i4"))
                )
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), lists], names=["id", "vector", "parts"])

    return run


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row pair, summed in the same order whatever else is in the block."""
    q, c = q / np.abs(q).max(1, keepdims=True), c / np.abs(c).max(1, keepdims=True)
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def _rank(k: int):
    names = ["query_id", "vec_id", "score"]

    def best_of(cell: pa.Table):
        asked = np.asarray(cell.column("asked").combine_chunks())
        ids, x = np.asarray(cell.column("id").combine_chunks()), _matrix(cell.column("vector").combine_chunks())
        q_ids, q, c_ids, c = ids[asked], x[asked], ids[~asked], x[~asked]
        if not len(q) or not len(c):
            return None
        rough = _units(q) @ _units(c).T
        rough[q_ids[:, None] == c_ids[None, :]] = -np.inf
        border = np.partition(rough, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -2.0)
        row, column = np.nonzero(rough >= np.maximum(border - 1e-9, -2)[:, None])
        score = _cosines(q[row], c[column])
        order = np.lexsort((c_ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        starts = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0)) if len(row) else row
        keep = np.arange(len(row)) - starts < k
        return q_ids[row[keep]], c_ids[column[keep]], score[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "cell", 4096):
            cell = np.asarray(rows.column("cell").combine_chunks())
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(cell)]):
                found = best_of(rows.slice(s, e - s))
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=names)

    return run


def _search(asked: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block; asked has id, vector, parts, and indexed has part."""
    queries = asked.select("id", "vector", F.explode("parts").alias("part"))
    # One number per part on either side.
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    loads = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    if not sizes or not loads:
        return asked.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")

    def blocks(counts: dict[int, int], size: int):
        case = F.lit(1)
        for part, n in counts.items():
            case = F.when(F.col("part") == part, F.lit(-(-n // size))).otherwise(case)
        return case

    mine, theirs = blocks(sizes, BLOCK), blocks(loads, QUERY_BLOCK)
    spread = F.pmod(F.xxhash64("id", "vector"), F.col("own")).cast("int")
    left = queries.withColumns({"own": theirs, "other": F.explode(F.sequence(F.lit(0), mine - 1))}).select(
        F.xxhash64("part", "other", spread).alias("cell"), F.lit(True).alias("asked"), "id", "vector"
    )
    right = indexed.withColumns({"own": mine, "other": F.explode(F.sequence(F.lit(0), theirs - 1))}).select(
        F.xxhash64("part", spread, "other").alias("cell"), F.lit(False).alias("asked"), "id", "vector"
    )
    cells = left.unionByName(right).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_rank(k), "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row for which ``is_query`` (of id) holds."""
    rows = written(usable(vectors, key, vector))
    router, parts, probes = train(rows, k, recall)
    schema = "id bigint, vector array<double>, parts array<int>"
    indexed = written(rows.mapInArrow(_route(router, 1), schema).select("id", "vector", F.col("parts")[0].alias("part")))
    asked = written(rows.where(is_query).mapInArrow(_route(router, probes), schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = written(ranked(_search(asked, indexed, k)))
    if probes < parts:  # a query may have met fewer than k rows though there are more
        full = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k)
        short = asked.join(full.select("id"), "id", "left_anti")
        if not short.isEmpty():
            every = F.array(*[F.lit(p) for p in range(parts)])
            more = ranked(_search(short.withColumn("parts", every), indexed, k))
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
