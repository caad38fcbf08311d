"""Text encoder plug-ins.

``HashingTextEncoder`` is the offline default: signed feature hashing, a stand-in with the algebra
of the pipeline (token vectors, masked mean, unit length, truncation) but not the quality of a
trained network. ``OnnxTextEncoder`` runs a configured model and tokenizer file in the executors.
Both map a text column to STRUCT<tokens INT, embedding ARRAY<FLOAT>> without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from embedspark.constants import DEFAULT_DIM, SPECIAL_TOKENS, ZERO_NORM
from embedspark.functions.arrow import blocks, float_lists, list_lengths, once_per_row
from embedspark.functions.text import signed_slots, token_count, tokens

_ROWS_PER_BLOCK = 512


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Every row scaled to length one; rows of length at most 1e-9 are left alone."""
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    scale = np.where(lengths > ZERO_NORM, lengths, 1.0)
    return matrix / scale[:, None]


def _hashed_vectors(width: int, dim: int, normalize: bool):
    def vectors_of(chunk: pa.Array) -> pa.Array:
        lengths = np.maximum(list_lengths(chunk), 0)
        flat = chunk.flatten().to_numpy(zero_copy_only=False).astype("i8", copy=False)
        cell = np.repeat(np.arange(len(chunk)), lengths) * width + np.abs(flat) - 1
        sums = np.bincount(cell, weights=np.sign(flat), minlength=len(chunk) * width)
        pooled = sums.reshape(len(chunk), width) / (lengths + SPECIAL_TOKENS)[:, None]
        vectors = float_lists((unit_rows(pooled) if normalize else pooled)[:, :dim])
        if chunk.null_count:  # no text, no vector
            vectors = pa.ListArray.from_arrays(vectors.offsets, vectors.values, mask=chunk.is_null())
        return vectors

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Blocks leave one by one: a worker holds the vectors and the token cells of one block, not of a batch.
        for codes in batches:
            for first in range(0, len(codes), _ROWS_PER_BLOCK):
                yield vectors_of(codes.slice(first, _ROWS_PER_BLOCK))

    return once_per_row(encode)


class HashingTextEncoder:
    """Signed feature hashing. Special tokens count in the mean but have zero vectors; NULL gives NULL."""

    def __init__(self, width: int = DEFAULT_DIM):
        self.width = width

    def encode(self, text: Column, dim: int | None = None, normalize: bool = True) -> Column:
        words = tokens(text)
        vectors = _hashed_vectors(self.width, dim or self.width, normalize)
        return F.struct(
            token_count(words).alias("tokens"),
            vectors(signed_slots(words, self.width)).alias("embedding"),
        )


def pool_hidden(output: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    """One vector per row of a model output.

    ``[n, width]`` is used as is (checked before the token form, so one token is not pooled);
    ``[n, tokens, width]`` is averaged over the positions whose mask is positive.
    """
    if output.ndim == 2 and output.shape[1] == width:
        return output.astype("f8")
    if output.ndim == 3 and output.shape[2] == width:
        keep = (mask > 0).astype("f8")
        counts = np.maximum(keep.sum(axis=1), 1.0)
        return np.einsum("ntw,nt->nw", output.astype("f8"), keep) / counts[:, None]
    raise ValueError(f"Unexpected embedding shape: {list(output.shape)}")


class OnnxTextEncoder:
    """Runs an ONNX text model; files must be readable under the same path on every executor.

    ``batch`` is the number of texts per call. Quantized models must keep 1, because their
    vectors change when texts share a batch.
    """

    def __init__(self, model: str, tokenizer: str, width: int = DEFAULT_DIM, batch: int = 1):
        self.model, self.tokenizer, self.width, self.batch = model, tokenizer, width, batch

    def encode(self, text: Column, dim: int | None = None, normalize: bool = True) -> Column:
        model, tokenizer, width, batch = self.model, self.tokenizer, self.width, self.batch
        keep = dim or width

        @F.arrow_udf("struct<tokens:int,embedding:array<float>>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import onnxruntime
            from tokenizers import Tokenizer

            session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
            wanted = {port.name for port in session.get_inputs()}
            encoder = Tokenizer.from_file(tokenizer)
            for texts in batches:
                rows: list[np.ndarray | None] = [None] * len(texts)
                counts: list[int | None] = [None] * len(texts)
                values = texts.to_pylist()
                present = [i for i, value in enumerate(values) if value is not None]
                for first in range(0, len(present), batch):
                    group = present[first : first + batch]
                    encoded = encoder.encode_batch([values[i] for i in group])
                    longest = max(len(item.ids) for item in encoded)
                    feed = {
                        name: np.array(
                            [part + [0] * (longest - len(part)) for part in parts], dtype="i8"
                        )
                        for name, parts in (
                            ("input_ids", [list(item.ids) for item in encoded]),
                            ("token_type_ids", [list(item.type_ids) for item in encoded]),
                            ("attention_mask", [list(item.attention_mask) for item in encoded]),
                        )
                    }
                    output = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
                    pooled = pool_hidden(output, feed["attention_mask"], width)
                    pooled = (unit_rows(pooled) if normalize else pooled)[:, :keep]
                    for i, item, vector in zip(group, encoded, pooled):
                        rows[i], counts[i] = vector, len(item.ids)
                yield pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int32()), float_lists(rows)], names=["tokens", "embedding"]
                )

        return once_per_row(run)(text)


def _pooled_by_shape(width: int):
    @F.arrow_udf("array<float>")
    def pooled(flat: pa.Array, mask: pa.Array) -> pa.Array:
        rows: list[np.ndarray | None] = [None] * len(flat)
        masks = mask.to_pylist()
        for at, matrix in blocks(flat):
            tokens_per_row = matrix.shape[1] // width
            for row, values in zip(at, matrix):
                if tokens_per_row <= 1:
                    rows[row] = values
                    continue
                keep = np.array(masks[row][:tokens_per_row]) > 0
                hidden = values.reshape(tokens_per_row, width)
                rows[row] = hidden[keep].mean(axis=0) if keep.any() else np.zeros(width)
        return float_lists(rows)

    return pooled


def embedding_from_output(flat: Column, shape: Column, mask: Column, width: int) -> Column:
    """Vector of a flat model output whose dimensions are ``shape``, NULL for other shapes.

    Accepted: [width], [1, width], [1, tokens, width] and [tokens, width].
    """
    dims = F.size(shape)
    last = F.element_at(shape, -1) == width
    accepted = last & (
        (dims == 1) | (dims == 2) | ((dims == 3) & (F.element_at(shape, 1) == 1))
    )
    return F.when(accepted, _pooled_by_shape(width)(F.when(accepted, flat), mask))


def shape_message(shape: Column) -> Column:
    return F.concat(
        F.lit("Unexpected embedding shape: ["), F.array_join(shape.cast("array<string>"), ", "), F.lit("]")
    )
