import numpy as np
import pytest

from embedspark.operators import search


def brute_force(queries, corpus, k):
    out = set()
    for qid, q in queries:
        ranked = sorted((-(round(float(np.dot(q, c)), 6) + 0.0), cid) for cid, c in corpus)
        out |= {(qid, i + 1, cid, -score + 0.0) for i, (score, cid) in enumerate(ranked[:k])}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)

    def unit(n):
        v = np.round(rng.normal(size=(n, 6)), 1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    queries = [(i, v.tolist()) for i, v in enumerate(unit(23))]
    corpus = [(i, v.tolist()) for i, v in enumerate(unit(400))]
    # A third of all items are copies of one vector: ties at the border of the result.
    corpus += [(400 + i, corpus[7][1]) for i in range(200)]
    schema = "id bigint, embedding array<double>"
    return queries, corpus, spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_both_ways_equal_brute_force(tables, limit):
    queries, corpus, q, c = tables
    found = search.top_k_neighbors(
        q, c.repartition(5), 4, "id", "id", max_broadcast_bytes=limit, block_rows=37
    ).collect()
    got = {(r["query_id"], r["rank"], r["item_id"], r["score"]) for r in found}
    assert got == brute_force(queries, corpus, 4)


def test_empty_sides_and_large_k(tables, spark):
    queries, corpus, q, c = tables
    none = c.where("id < 0")
    assert search.top_k_neighbors(q, none, 3, "id", "id").count() == 0
    assert search.top_k_neighbors(none, c, 3, "id", "id").count() == 0
    few = c.where("id < 2")
    assert search.top_k_neighbors(q, few, 9, "id", "id").count() == 2 * len(queries)


def test_overlap(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "query_id int, rank int, item_id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id int, rank int, item_id int")
    rows = {r["query_id"]: r["overlap"] for r in search.overlap_at_k(a, b, 2).collect()}
    assert rows == {1: 0.5, 2: 0.0}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_without_a_vector_take_no_part(spark, limit):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id bigint, embedding array<double>")
    found = search.top_k_neighbors(rows, rows, 5, "id", "id", max_broadcast_bytes=limit).collect()
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in found} == {(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 1)}
