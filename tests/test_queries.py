"""Every registered query against its SQL twin, and plan rules that hold for all of them."""

import glob
import os
import re

import duckdb
import pytest

from embedspark.plans import catalog, content
from embedspark.sources import images


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def rows_of(names, rows):
    return sorted(tuple("null" if row[n] is None else repr(row[n]) for n in sorted(names)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    result = catalog.QUERIES[name](spark, sf_dir)
    found = result.collect()
    assert len(set(result.columns)) == len(result.columns)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in catalog.ORACLES:
        assert found
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [column[0] for column in cursor.description]
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert sorted(names) == sorted(result.columns)
    assert rows_of(names, [row.asDict() for row in found]) == rows_of(names, expected)


def test_batch_embed_of_long_conversations(spark, tmp_path):
    rows = [(c, t, f"turn {t} of conversation {c}, " + "more words " * (t % 5)) for c, n in ((1, 40), (2, 17), (3, 16), (4, 1)) for t in range(n)]
    rows.append((5, 0, None))
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.QUERIES["t10_batch_embed"](spark, str(tmp_path)).collect()
    cursor = duckdb.connect().execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = cursor.execute(catalog.ORACLES["t10_batch_embed"])
    names = [column[0] for column in cursor.description]
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert rows_of(names, [row.asDict() for row in found]) == rows_of(names, expected)
    assert {r["conv_id"]: r["items"] for r in found} == {1: 40, 2: 17, 3: 16, 4: 1, 5: 1}


def test_names_and_oracles():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert not [name for name in catalog.QUERIES if re.match(r"op\d|.*pipeline", name)]


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = catalog.QUERIES["c12_dominant_color"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_flagship(spark):
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert result.columns == ["query_id", "rank", "item_id", "score"]
    assert result.count() > 0


def test_stats_rows_broadcast_no_metadata(spark, tmp_path):
    rows = [(k, f"name {k}", f"Brand#{k % 9}", "SMALL", 1 + k % 50, 1.0) for k in range(400)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    result = catalog.QUERIES["c15_stats_rows"](spark, str(tmp_path))
    found = result.collect()
    assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
    cursor = duckdb.connect().execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    cursor = cursor.execute(catalog.ORACLES["c15_stats_rows"])
    names = [column[0] for column in cursor.description]
    assert rows_of(names, [row.asDict() for row in found]) == rows_of(names, [dict(zip(names, row)) for row in cursor.fetchall()])
    assert {r["exif_fields"] for r in found if r["image_id"] % 7 == 0} == {0}


def test_decode_files_lists_few_files_at_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"name {k}", "Brand#1", "SMALL", 1 + k % 50, 1.0) for k in range(300)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    counts, whole = [], images.decoded_files

    def listed(*given):
        files = whole(*given)
        counts.append(len(files.inputFiles()))
        return files

    monkeypatch.setattr(images, "decoded_files", listed)
    monkeypatch.setattr(content, "FILES_PER_FOLDER", 60)
    found = catalog.QUERIES["s10_decode_files"](spark, str(tmp_path)).collect()
    assert sum(counts) == 300 and len(counts) == 5 and max(counts) < 120
    cursor = duckdb.connect().execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    cursor = cursor.execute(catalog.ORACLES["s10_decode_files"])
    names = [column[0] for column in cursor.description]
    assert rows_of(names, [row.asDict() for row in found]) == rows_of(names, [dict(zip(names, row)) for row in cursor.fetchall()])
