"""The ONNX plug-ins with tiny models written by hand (no model files are needed)."""

import numpy as np
import pytest

from embedspark.operators.encoders import OnnxTextEncoder
from embedspark.operators.image import CLIP, OnnxImageEncoder, embed_images, preprocessed
from embedspark.operators.text import embed_texts
from embedspark.plans.binary_fixtures import picture

onnxruntime = pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

FLOAT, INT64 = 1, 7


def varint(value):
    out = b""
    while True:
        value, low = value >> 7, value & 127
        out += bytes([low | (128 if value else 0)])
        if not value:
            return out


def field(number, body):
    """Protocol-buffer field: numbers as varints, everything else length-delimited."""
    if isinstance(body, int):
        return varint(number << 3) + varint(body)
    body = body.encode() if isinstance(body, str) else body
    return varint(number << 3 | 2) + varint(len(body)) + body


def tensor(name, array):
    kind = FLOAT if array.dtype == np.float32 else INT64
    dims = b"".join(field(1, d) for d in array.shape)
    return dims + field(2, kind) + field(8, name) + field(9, array.tobytes())


def port(name, kind, dims):
    shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(op, inputs, output, *attributes):
    parts = b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op)
    return parts + b"".join(field(5, a) for a in attributes)


def model(nodes, constants, inputs, output):
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g")
    graph += b"".join(field(5, c) for c in constants)
    graph += b"".join(field(11, i) for i in inputs) + field(12, output)
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture
def text_files(tmp_path):
    table = np.arange(24, dtype="f4").reshape(6, 4)
    body = model(
        [node("Gather", ["table", "input_ids"], "hidden")],
        [tensor("table", table)],
        [port("input_ids", INT64, ["n", "t"])],
        port("hidden", FLOAT, ["n", "t", 4]),
    )
    path = tmp_path / "model.onnx"
    path.write_bytes(body)
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"[UNK]": 0, "p": 1, ":": 2, "a": 3, "b": 4, "c": 5}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    return str(path), str(tmp_path / "tokenizer.json"), table


@pytest.mark.parametrize("batch", [1, 3])
def test_text_model_pools_and_normalises(spark, text_files, batch):
    from pyspark.sql import functions as F

    path, words, table = text_files
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "zzz a a a"), (4, None)], "id int, input string")
    encoder = OnnxTextEncoder(path, words, width=4, batch=batch)
    got = {r["id"]: r for r in embed_texts(df.coalesce(1), encoder=encoder, prefix=F.lit("p"), dim=3).collect()}
    for i, ids in ((1, [1, 2, 3, 4]), (2, [1, 2, 5]), (3, [1, 2, 0, 3, 3, 3])):
        mean = table[ids].mean(axis=0)
        assert got[i]["tokens"] == len(ids)
        assert got[i]["embedding"] == pytest.approx((mean / np.linalg.norm(mean))[:3], abs=1e-6)
    assert got[4]["embedding"] is None and got[4]["tokens"] is None


def test_image_model_takes_the_first_token(spark, tmp_path):
    # Mean per channel, shaped to one token of width 3.
    axes = field(1, "axes") + field(20, 7) + field(8, 2) + field(8, 3)
    keep = field(1, "keepdims") + field(20, 2) + field(3, 0)
    body = model(
        [node("ReduceMean", ["pixel_values"], "mean", axes, keep), node("Unsqueeze", ["mean", "one"], "out")],
        [tensor("one", np.array([1], dtype="i8"))],
        [port("pixel_values", FLOAT, ["n", 3, 224, 224])],
        port("out", FLOAT, ["n", 1, 3]),
    )
    path = tmp_path / "vision.onnx"
    path.write_bytes(body)
    rows = [(i, 10, 9, 4, picture(i, 10, 9).tobytes()) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "image_id int, w bigint, h bigint, channels int, data binary")
    for r in embed_images(df, OnnxImageEncoder(str(path), 3), batch=2).collect():
        mean = preprocessed(picture(r["image_id"], 10, 9), CLIP).mean(axis=(1, 2))
        assert r["embedding"] == pytest.approx(mean / np.linalg.norm(mean), abs=2e-3)
