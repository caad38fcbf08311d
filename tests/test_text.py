import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspark.functions import payload
from embedspark.functions.text import tokens
from embedspark.operators import text as ops
from embedspark.operators.encoders import HashingTextEncoder, embedding_from_output, pool_hidden


def test_prefix_is_never_deduplicated(spark):
    df = spark.createDataFrame([("search_query: x",)], "input string")
    once = ops.embed_texts(df, encoder=HashingTextEncoder(32)).first()
    # search, _, query, : twice, x, and two special tokens.
    assert once["tokens"] == 11


def test_tokens(spark):
    df = spark.createDataFrame([("Héllo, wörld 42!",), ("",)], "t string")
    got = [r[0] for r in df.select(tokens(F.col("t"))).collect()]
    assert got == [["héllo", ",", "wörld", "42", "!"], []]


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, input string")
    empty, null = ops.embed_texts(df, encoder=HashingTextEncoder(8), prefix=F.lit("p")).orderBy("id").collect()
    assert empty["tokens"] == 4 and np.linalg.norm(empty["embedding"]) == pytest.approx(1.0)
    assert null["embedding"] is None and null["tokens"] is None


def test_dim_messages(spark):
    df = spark.createDataFrame([(0,), (1,), (768,), (769,)], "dim int").select(
        ops.dim_status(F.col("dim")).alias("s")
    )
    assert [(r["s"]["code"], r["s"]["message"]) for r in df.collect()] == [
        (400, "dim must be between 1 and 768, got 0"),
        (200, None),
        (200, None),
        (400, "dim must be between 1 and 768, got 769"),
    ]


def test_admission_order(spark):
    rows = [(1, True), (2, True), (20, True), (16, False), (17, False), (0, True)]
    df = spark.createDataFrame(rows, "n int, q boolean").select(
        ops.admission_status(F.col("n"), F.col("q"), 16).alias("s")
    )
    got = [(r["s"]["code"], (r["s"]["message"] or "")[:10]) for r in df.collect()]
    assert got == [(200, ""), (400, "Batching i"), (400, "Batching i"), (200, ""), (400, "Batch size"), (200, "")]


def test_batches_keep_order_and_refuse_oversize(spark):
    rows = [(1, p, f"a{p}") for p in (2, 0, 1)] + [(2, p, "x") for p in range(50)]
    df = spark.createDataFrame(rows, "b int, pos int, input string")
    got = {r["b"]: r for r in ops.assemble_batches(df, "b", "pos", ["input"], 4).collect()}
    assert got[1]["input"] == ["a0", "a1", "a2"]
    assert got[2]["batch_size"] == 50 and got[2]["input"] is None
    plan = ops.assemble_batches(df, "b", "pos", ["input"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_unnest_and_aliases(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "b int, items array<string>")
    rows = [(r["b"], r["pos"], r["input"]) for r in ops.unnest_batches(df, "items").collect()]
    assert rows == [(1, 0, "a"), (1, 1, "b")]
    df = spark.createDataFrame([(1, None, "y"), (2, "x", None)], "id int, content string, input string")
    assert [r["v"] for r in ops.aliased(df, "v", "input", "content").collect()] == ["y", "x"]


def test_distinct_encoding_gives_the_same_rows(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)] + [(9, None)], "id int, input string")
    plain = {r["id"]: r["embedding"] for r in ops.embed_texts(df, encoder=HashingTextEncoder(16)).collect()}
    once = {
        r["id"]: r["embedding"]
        for r in ops.embed_distinct_texts(df, encoder=HashingTextEncoder(16)).collect()
    }
    plain.pop(9), once.pop(9)
    assert plain == once


def test_padding_and_variants(spark):
    df = spark.createDataFrame([(1, [5, 6]), (1, [7, 8, 9])], "b int, ids array<bigint>")
    rows = {tuple(r["ids"]): r for r in ops.pad_batches(df, "b").collect()}
    assert rows[(5, 6)]["padded_ids"] == [5, 6, 0] and rows[(5, 6)]["mask"] == [1, 1, 0]
    assert rows[(7, 8, 9)]["padded_ids"] == [7, 8, 9]
    paths = ["model.onnx", "model_quantized.onnx", "MODEL_INT8.onnx", "quantized/model.onnx", "a/b_uint8.onnx"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(ops.model_variant(F.col("p")))
    assert [r[0] for r in df.collect()] == ["Full", "Quantized", "Quantized", "Full", "Quantized"]


def test_shapes():
    mask = np.array([[1, 1, 0]])
    hidden = np.arange(6.0).reshape(1, 3, 2)
    assert pool_hidden(hidden, mask, 2).tolist() == [[1.0, 2.0]]
    assert pool_hidden(np.ones((1, 2)), mask, 2).tolist() == [[1.0, 1.0]]
    assert pool_hidden(hidden, np.zeros((1, 3)), 2).tolist() == [[0.0, 0.0]]
    with pytest.raises(ValueError, match="Unexpected embedding shape"):
        pool_hidden(np.ones((2, 3, 4)), mask, 2)


def test_output_shapes_in_columns(spark):
    rows = [([1.0, 2.0], [2], [1]), ([1.0, 2.0, 3.0, 4.0], [2, 2], [1, 1]), ([1.0, 2.0], [1, 3], [1]), ([1.0, 2.0], [1, 2], [0])]
    df = spark.createDataFrame(rows, "f array<double>, s array<int>, m array<int>")
    got = [r[0] for r in df.select(embedding_from_output(F.col("f"), F.col("s"), F.col("m"), 2)).collect()]
    assert got == [[1.0, 2.0], [2.0, 3.0], None, [1.0, 2.0]]


def test_size_limit_boundary(spark):
    limit = 20 * 1024 * 1024
    df = spark.createDataFrame([(limit,), (limit + 1,)], "n bigint").select(
        payload.size_status(F.col("n")).alias("s")
    )
    ok, refused = [r["s"] for r in df.collect()]
    assert ok["code"] == 200
    assert refused["message"] == f"Image too large: {limit + 1} bytes (max 20 MB)"


def test_content_rules(spark):
    rows = ["http://a", "https://a", "HTTP://a", "data:x,aGk=,b", "data:;base64,aGk=", "data:none", "aGk=", "!!!!", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, content string")
    from embedspark.sources.payloads import resolve_inline

    got = {r["i"]: (r["kind"], r["payload"] and bytes(r["payload"]), r["status"]["code"]) for r in resolve_inline(df).collect()}
    assert got[0][0] == got[1][0] == "url" and got[2][0] == "base64"
    assert got[3][2] == 400
    assert got[4] == ("data_url", b"hi", 200)
    assert got[5] == ("data_url", None, 400)
    assert got[6] == ("base64", b"hi", 200) and got[7] == ("base64", None, 400)


def test_text_vectors_leave_in_blocks():
    import pyarrow as pa

    from embedspark.operators import encoders

    codes = [None if i % 100 == 7 else [1 + i % 8, -(1 + i % 3)] for i in range(1100)]
    found = list(encoders._hashed_vectors(8, 8, False).func(iter([pa.array(codes, pa.list_(pa.int64()))])))
    assert [len(block) for block in found] == [512, 512, 76]
    rows = [row for block in found for row in block.to_pylist()]
    for code, row in zip(codes, rows):
        assert (row is None) == (code is None)
    assert rows[0] == [0.0] * 8 and rows[1][1] == -0.25 + 0.25 and rows[3][3] == 0.25 and rows[3][0] == -0.25


def test_masked_pool_hashes_each_token_once(spark, tmp_path):
    """F16: keys repeat or are null; every kept token counts for its key, and the tokens are made by one step of the plan."""
    from embedspark.plans.text import masked_mean_pool

    rows = [(1, "a b c d"), (1, "e f"), (None, "a b"), (2, ""), (3, None), (4, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = masked_mean_pool(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    kept = {1: ["a", "b", "d", "e", "f"], 4: ["x"]}
    wanted = {}
    for key, tokens in kept.items():
        for token in tokens:
            digest = hashlib.md5(token.encode()).hexdigest()
            place = (key, int(digest[:8], 16) % 64)
            wanted[place] = wanted.get(place, 0) + (1 if int(digest[8], 16) % 2 == 0 else -1) / len(tokens)
    got = {(r["doc_id"], r["slot"]): r["value"] for r in found.collect()}
    assert got == pytest.approx(wanted, abs=1e-6)
