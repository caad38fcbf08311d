import datetime as dt

import pytest

from embedspark.operators.encoders import HashingTextEncoder
from embedspark.operators.text import embed_texts
from embedspark.session import shared_folder
from embedspark.streaming import streams

START = dt.datetime(2024, 1, 1)


def minute(n):
    return START + dt.timedelta(minutes=n)


def run_files(spark, tmp_path, schema, batches, build, how=streams.append_to_parquet):
    """Feeds one file per micro-batch, in order, and returns the rows written."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = build(streams.parquet_stream(spark, str(source), spark.read.parquet(str(source)).schema))
        how(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(out).collect()


def test_stream_embedding_equals_batch(spark, tmp_path):
    rows = [[(i, f"text number {i}") for i in range(5)], [(i, f"text number {i}") for i in range(5, 9)]]
    encoder = HashingTextEncoder(16)
    got = run_files(
        spark, tmp_path, "id int, text string", rows, lambda s: streams.embedded_stream(s, "text", encoder=encoder)
    )
    batch = embed_texts(spark.createDataFrame(sum(rows, []), "id int, text string"), "text", encoder=encoder).collect()
    assert {r["id"]: r["embedding"] for r in got} == {r["id"]: r["embedding"] for r in batch}


def test_dedup_forgets_after_the_expiry(spark, tmp_path):
    batches = [
        [(minute(0), "a", 1), (minute(1), "b", 2), (minute(2), "a", 3)],
        [(minute(30), "a", 4), (minute(45), "c", 5)],
        [(minute(300), "d", 6)],
        [(minute(301), "a", 7), (minute(10), "z", 8)],
    ]
    got = run_files(
        spark, tmp_path, "ts timestamp, content string, n int", batches, lambda s: streams.deduplicated_stream(s, "content")
    )
    # 3 and 4 repeat 1 within the hour; 7 comes after the hour; 8 is later than the watermark.
    assert sorted(r["n"] for r in got if r["content"] != "a") == [2, 5, 6]
    kept = sorted(r["n"] for r in got if r["content"] == "a")
    assert len(kept) == 2 and kept[0] in (1, 3) and kept[1] == 7


LOG = "ts timestamp, endpoint string, latency_ms double, success boolean"


@pytest.mark.parametrize("kind", ["tumbling", "session"])
def test_windows_close_and_drop_late_rows(spark, tmp_path, kind):
    batches = [
        [(minute(0), "x", 10.0, True), (minute(1), "x", 20.0, False)],
        [(minute(60), "x", 1.0, True)],
        [(minute(2), "x", 99.0, True), (minute(200), "x", 1.0, True)],
        [(minute(400), "x", 1.0, True)],
    ]
    got = run_files(spark, tmp_path, LOG, batches, lambda s: streams.windowed_summary(s, kind))
    closed = {r["window_start"]: r for r in got}
    first = closed[minute(0)]
    # The row of minute 2 arrives after the watermark passed its window.
    assert (first["total"], first["successful"], first["mean_ms"], first["max_ms"]) == (2, 1, 15.0, 20.0)
    assert minute(60) in closed and minute(400) not in closed


def test_batch_windows_match_manual_counts(spark):
    rows = [(minute(m), "x", float(m), True) for m in (0, 4, 5, 9, 10)]
    df = spark.createDataFrame(rows, LOG)
    got = {r["window_start"]: r["total"] for r in streams.windowed_summary(df, lateness=None).collect()}
    assert got == {minute(0): 2, minute(5): 2, minute(10): 1}
    sliding = streams.windowed_summary(df, "sliding", size="10 minutes", slide="5 minutes", lateness=None)
    assert sum(r["total"] for r in sliding.collect()) == 10
    with pytest.raises(ValueError):
        streams.time_window("other")


class ClusterSession:
    """Just enough of a session to ask for its settings."""

    def __init__(self, master, settings):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_one_the_cluster_names(spark, tmp_path):
    named = ClusterSession("spark://host:7077", {"spark.checkpoint.dir": str(tmp_path)})
    assert shared_folder(named).startswith(f"{tmp_path}/") and shared_folder(named) != shared_folder(named)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(ClusterSession("spark://host:7077", {}))
    assert shared_folder(spark).startswith("/tmp/")


@pytest.mark.parametrize("parts", [1, 3])
def test_tables_that_are_a_file_or_a_folder_are_streamed_whole(spark, tmp_path, parts):
    from embedspark.plans.catalog import QUERIES

    rows = [(i, f"text number {i}", "en", "web", 13) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if parts == 1:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["x1_stream_embedding"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in found) == [(i, 9) for i in range(9)]
