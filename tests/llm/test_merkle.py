"""The Merkle manifest against a plain version and its SQL twin."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from embedspark.llm import merkle, merkle_sql, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def plain_hash(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    fields = [None if row[c] is None else str(row[c]) for c in COLUMNS]
    return plain_hash(*("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """The root, and for each node the runs (siblings before, siblings after) up to it."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at, below in enumerate(members):
            first = at - at % 8
            for i in below:
                paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        members = [sum(members[i : i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [plain_hash(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[(row["lang"] is not None, (row["lang"] or "").encode())].append(row)
    subroots, local = [], []
    for name in sorted(trees):
        own = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        root, paths = plain_tree([plain_leaf(r) for r in own])
        subroots.append(root)
        local.append(list(zip(own, paths)))
    root, above = plain_tree(subroots)
    for subroot, outer, own in zip(subroots, above, local):
        for row, path in own:
            path = path + outer
            found = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                found["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            node = plain_leaf(found)
            for before, after in path:
                node = plain_hash(before, node, after)
            yield row["doc_id"], plain_leaf(row), subroot, root, plain_hash(*(b + a for b, a in path)), node, node == root


def found_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, found.collect()))


def rows_of_sql(folder):
    connection = duckdb.connect()
    connection.execute(f"create view documents as from '{folder}'")
    return Counter(connection.execute(queries.ORACLES["op12_merkle_manifest"]).fetchall())


def test_query(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = found_rows(spark, docs, tmp_path)
    assert found == Counter(plain_manifest([r.asDict() for r in docs.collect()]))
    assert found == rows_of_sql(f"{sf_dir}/documents.parquet")
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [8, 9], [513, 1, 512], [5000, 64, 65, 7], [1] * 70])
def test_sizes_of_trees(spark, tmp_path, sizes):
    rows = [(i + 1000 * t, f"Text {i}", f"l{t}", "s", i) for t, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = found_rows(spark, docs.repartition(7), tmp_path)
    assert found == Counter(plain_manifest([r.asDict() for r in docs.collect()]))


def test_deep_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LOCAL_LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    rows = [(i, f"Text {i}", f"l{i % 11}" if i % 3 else "hot", "s", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = found_rows(spark, docs.repartition(3), tmp_path)
    assert found == Counter(plain_manifest([r.asDict() for r in docs.collect()]))


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, "No key", "en", "s", 1),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (2**60 + 1, "A Large key", None, "s", 3),
        (5, "", "", "", 0),
        (6, "Twice ÄÖÜ İ", "en", "s", 9),
        (6, "Twice ÄÖÜ İ", "en", "s", 9),
        (6, "Same key, other Text", "en", "s", None),
        (-7, "X" * 3_000_000, "\U0001f600", "s", 3_000_000),
        (8, "Between", "￮", "s", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("key", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("a.b c", F.lit(3))
    found = found_rows(spark, docs, tmp_path)
    assert found == Counter(plain_manifest([{c: r[c] for c in COLUMNS} for r in docs.collect()]))
    assert found == rows_of_sql(f"{tmp_path}/documents.parquet/*.parquet")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert not found_rows(spark, docs, tmp_path)


def test_crc_in_sql():
    numbers = [0, 7, -12, 2**62, 99999]
    asked = ", ".join(merkle_sql.crc32_sql(f"'{n}'") for n in numbers)
    assert list(duckdb.connect().execute(f"select {asked}").fetchone()) == [zlib.crc32(str(n).encode()) for n in numbers]
