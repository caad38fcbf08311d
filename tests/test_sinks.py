"""The sink that commits batches by number."""

import pytest

from embedspark.sources import sinks

SCHEMA = "day string, n bigint"


def rows_of(spark, path):
    return sorted((r["day"] or "", r["n"]) for r in sinks.committed_rows(spark, path, "day").collect())


def test_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), (None, 3)], SCHEMA)
    assert sinks.commit_batch(first, path, 0, "day")
    assert not sinks.commit_batch(first, path, 0, "day")
    assert sinks.commit_batch(spark.createDataFrame([("2024-01-01", 4)], SCHEMA), path, 1, "day")
    assert rows_of(spark, path) == [("", 3), ("2024-01-01", 1), ("2024-01-01", 4), ("2024-01-02", 2)]
    assert sinks.commit_batch(spark.createDataFrame([], SCHEMA), path, 2, "day")
    assert len(rows_of(spark, path)) == 4


def test_interrupted_batch_stays_unseen_and_is_replaced(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sinks.commit_batch(spark.createDataFrame([("2024-01-01", 1)], SCHEMA), path, 0, "day")
    batch = spark.createDataFrame([("2024-01-01", 2), ("2024-01-03", 3)], SCHEMA)

    class Broken(Exception):
        pass

    def count(*_):
        raise Broken

    with monkeypatch.context() as patch:
        patch.setattr(sinks.F, "count", count)  # breaks off after the data, before the manifest
        with pytest.raises(Broken):
            sinks.commit_batch(batch, path, 1, "day")
    assert spark.read.parquet(f"{path}/data").count() == 3
    assert rows_of(spark, path) == [("2024-01-01", 1)]
    assert sinks.commit_batch(batch, path, 1, "day")
    assert rows_of(spark, path) == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-03", 3)]


def test_stream_goes_on_from_its_last_batch(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    for number in range(3):
        spark.createDataFrame([(f"2024-01-0{number + 1}", number)], SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sinks.exactly_once(stream, out, checkpoint).awaitTermination()
    assert rows_of(spark, out) == [("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-03", 2)]
