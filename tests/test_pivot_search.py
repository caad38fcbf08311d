"""Pruned exact search against brute force."""

import numpy as np
import pytest

from embedspark.operators import pivot_search
from test_search import brute_force

SCHEMA = "id bigint, embedding array<double>"


def clustered(random, n, centres, spread=0.05):
    v = centres[random.integers(0, len(centres), n)] + random.normal(size=(n, centres.shape[1])) * spread
    return np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 3)


@pytest.fixture(scope="module")
def tables(spark):
    random = np.random.default_rng(8)
    centres = random.normal(size=(12, 8))
    corpus = [(i, v.tolist()) for i, v in enumerate(clustered(random, 900, centres))]
    # A third of all items are copies of one vector; some are zero or not of unit length.
    corpus += [(900 + i, corpus[7][1]) for i in range(450)]
    corpus += [(1350, [0.0] * 8), (1351, [3.0] * 8), (1352, [-2.0] * 8)]
    queries = [(i, v.tolist()) for i, v in enumerate(clustered(random, 60, centres))]
    queries += [(60 + i, corpus[7][1]) for i in range(40)] + [(100, [0.0] * 8), (101, (5 * random.normal(size=8)).tolist())]
    return queries, corpus, spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.mark.parametrize("k,cell_rows,block_rows", [(1, 50, 8192), (5, 50, 64), (40, 20, 8192), (7, 5000, 37), (2000, 100, 8192)])
def test_equals_brute_force(tables, k, cell_rows, block_rows):
    queries, corpus, q, c = tables
    found, visits = pivot_search.pruned_top_k(q, c, k, "id", "id", cell_rows=cell_rows, block_rows=block_rows)
    got = {(r["query_id"], r["rank"], r["item_id"], r["score"]) for r in found.collect()}
    assert got == brute_force(queries, corpus, k)
    visits = visits.collect()
    assert {r["query_id"] for r in visits} == {i for i, _ in queries}
    assert all(1 <= r["visited"] <= r["cells"] for r in visits)
    if k == 5:  # clustered vectors leave most cells unvisited
        assert sum(r["visited"] for r in visits) < 0.6 * sum(r["cells"] for r in visits)


def test_unstructured_vectors(spark):
    random = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(300, 40)))]
    df = spark.createDataFrame(rows, SCHEMA)
    found, _ = pivot_search.pruned_top_k(df, df, 3, "id", "id", cell_rows=30)
    assert {(r["query_id"], r["rank"], r["item_id"], r["score"]) for r in found.collect()} == brute_force(rows, rows, 3)


def test_null_vectors_and_empty_sides(tables, spark):
    queries, corpus, q, c = tables
    none = spark.createDataFrame([(1, None), (2, None)], SCHEMA)
    assert pivot_search.pruned_top_k(q, none, 3, "id", "id")[0].count() == 0
    found, visits = pivot_search.pruned_top_k(none, c, 3, "id", "id")
    assert found.count() == 0 and visits.count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], SCHEMA)
    found, _ = pivot_search.pruned_top_k(mixed, mixed, 5, "id", "id", cell_rows=1)
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in found.collect()} == {(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 1)}
