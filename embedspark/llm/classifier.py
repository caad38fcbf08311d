"""A quality classifier learnt from trusted positives and unlabelled text.

Non-negative unbiased positive-unlabelled learning: with class prior p, the risk of a scorer is
``p R_pos(+1) + max(0, R_unl(-1) - p R_pos(-1))``. When the second part turns negative, which only
overfitting can do, the step goes the other way on that part. The prior is estimated from the scores of all
training rows: the share of unlabelled rows above a score, divided by that of the positives, is at
least the prior for every score, and its minimum over scores is taken.

Features are counts over the whole text (bytes by class, lengths, repetition), computed in the tasks.
The model is fitted on the driver from at most ``max_rows`` positives and ``max_rows`` unlabelled rows
(a documented bound); the rows are drawn by a hash of their text. Prior, features and scores cover all rows.

Null and empty texts have all features zero and are scored like any other. Labels of one key that
disagree, and keys with a null, are no positives. Without any positive every score is 0.5. Rows with the
same text get the same score. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from embedspark.llm.common import text_slices, written

MAX_ROWS = 20_000
_BINS = 1000
#: Bytes that are told apart one by one; all others count as letters, digits or other.
_MARKS = b"#*$%&|<>!?.,;:-_=/\\@~^()[]{}\"'`+"
_NAMES = 12 + len(_MARKS)


def _table() -> np.ndarray:
    """Class of each byte value."""
    classes = np.full(256, 5, "i8")
    classes[list(b" \t\r\n")] = 0
    classes[ord("a") : ord("z") + 1] = 1
    classes[ord("A") : ord("Z") + 1] = 2
    classes[ord("0") : ord("9") + 1] = 3
    classes[128:] = 4
    for place, mark in enumerate(_MARKS):
        classes[mark] = 6 + place
    return classes


_CLASS = _table()


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text; each stays within a small range whatever its length."""
    out = np.zeros(_NAMES, "f4")
    words = (text or "").split()
    if not words:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    shares = np.bincount(_CLASS, weights=np.bincount(data, minlength=256), minlength=6 + len(_MARKS)) / len(data)
    out[: 6 + len(_MARKS)] = np.sqrt(shares)
    n = len(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    out[6 + len(_MARKS) :] = (
        np.log1p(n) / 10,
        len(set(words)) / n,
        same / n,
        pairs / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        (len(text) - n + 1) / n / 10,
    )
    return out


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """_key, _draw (hash of the text), _features and the columns to keep as _row."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep or [key]])
    source = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_draw"), row.alias("_row"), F.col(text).alias("text"))
    fields = source.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [features(t) for t in part.column("text").to_pylist()]
                flat = pa.array(np.concatenate(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * _NAMES), flat)
                columns = [part.column(f.name) for f in fields] + [lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "_features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return written(source.mapInArrow(run, f"{schema}, _features array<float>"))


class Model:
    """A one-hidden-layer network over standardised features, fitted by Adam on the non-negative risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, steps: int = 1500):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        random = np.random.default_rng(seed)
        width, hidden = both.shape[1], 16
        self.weights = [
            random.normal(0, 1 / np.sqrt(width), (width, hidden)),
            np.zeros(hidden),
            random.normal(0, 1 / np.sqrt(hidden), hidden),
            np.zeros(1),
        ]
        p, u = self._scaled(positive), self._scaled(unlabelled)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            bp, bu = p[random.integers(0, len(p), 256)], u[random.integers(0, len(u), 256)]
            slopes = self._gradient(bp, bu, prior)
            for i, slope in enumerate(slopes):
                slope = slope + 1e-4 * self.weights[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                rate = 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                self.weights[i] = self.weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _gradient(self, bp, bu, prior):
        """Gradient of the risk with the logistic loss log(1 + exp(-y s))."""
        w, b, v, c = self.weights
        hp, hu = np.tanh(bp @ w + b), np.tanh(bu @ w + b)
        sp, su = hp @ v + c, hu @ v + c
        up, uu = 1 / (1 + np.exp(-sp)), 1 / (1 + np.exp(-su))
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        dp_positive = prior * (up - 1) / len(sp)
        dp_negative, du_negative = -prior * up / len(sp), uu / len(su)
        if negative >= 0:
            dp, du = dp_positive + dp_negative, du_negative
        else:
            dp, du = -dp_negative, -du_negative
        tp, tu = np.outer(dp, v) * (1 - hp**2), np.outer(du, v) * (1 - hu**2)
        return [bp.T @ tp + bu.T @ tu, tp.sum(0) + tu.sum(0), hp.T @ dp + hu.T @ du, np.array([dp.sum() + du.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return 1 / (1 + np.exp(-(np.tanh(self._scaled(x.astype("f8")) @ w + b) @ v + c)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, _NAMES)


def _scored(rows: DataFrame, model: Model | None, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("_features"))
                score = np.full(len(x), 0.5) if model is None else model.score(x)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.select(*names, "_features").mapInArrow(run, f"{schema}, score double")


def estimate_prior(scores: DataFrame) -> float:
    """Share of positives among unlabelled rows, from columns score and positive, over all rows.

    The minimum over scores of P(unlabelled above) / P(positive above), each with an allowance for its
    sampling error, as few rows above a score make the quotient unreliable.
    """
    counts = scores.groupBy(F.floor(F.col("score") * _BINS).alias("bin")).agg(
        F.count("*").alias("all"), F.sum(F.col("positive").cast("int")).alias("positive")
    )
    rows = {min(r["bin"], _BINS - 1): (r["all"], r["positive"]) for r in counts.collect()}
    both = np.array([rows.get(i, (0, 0)) for i in range(_BINS)], dtype="f8")[::-1].cumsum(0)
    n, np_ = both[-1]
    if not np_:
        return 0.5
    above_u, above_p = both[:, 0] / n, both[:, 1] / np_
    slack = 1 / np.sqrt(n) + 1 / np.sqrt(np_)
    usable = above_p > 0.5  # beyond, a fit to few rows flatters the positives it has seen
    quotient = (above_u[usable] + slack) / above_p[usable]
    return float(np.clip(quotient.min(), 0.02, 0.999))


def fit(
    rows: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", quality: str = "quality", max_rows: int = MAX_ROWS
) -> Model | None:
    """The fitted model; only rows of ``training`` are used. Unlabelled are all of them, whatever their label."""
    trusted = (
        labels.groupBy(F.col(key).alias("_key"))
        .agg(F.min(F.coalesce(quality, F.lit(0))).alias("_quality"))
        .where("_quality = 1 and _key is not null")
    )
    marked = rows.where(training).join(trusted, "_key", "left")
    marked = written(marked.select("_draw", "_features", F.col("_quality").isNotNull().alias("positive")))
    n = marked.agg(F.count("*").alias("all"), F.sum(F.col("positive").cast("int")).alias("positive")).first()
    if not n["positive"]:
        return None

    def drawn(part: DataFrame, count: int) -> np.ndarray:
        # A share by hash, so that no sort is needed, and the documented bound.
        share = min(1.0, max_rows / count)
        taken = part.where(F.pmod("_draw", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(max_rows)
        found = _matrix(taken.select("_features").toArrow().column(0).combine_chunks()).astype("f8")
        return found[np.lexsort(found.T)]  # an order that does not depend on the tasks

    positive = drawn(marked.where("positive"), n["positive"])
    unlabelled = drawn(marked, n["all"])
    if not len(positive) or not len(unlabelled):
        return None
    prior = 0.5
    for steps in (300, 1500):  # the first fit only serves to estimate the prior
        model = Model(positive, unlabelled, prior, steps=steps)
        if steps == 300:
            prior = estimate_prior(_scored(marked, model, ["positive"]))
    model.prior = prior
    return model


def in_fold(key: str = "_key") -> Column:
    """Whether a row is held out: crc32 of its key as text, modulo 3, is 1. Null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """_row (the columns to keep), held_out, score, predicted."""
    rows = feature_table(docs, key, text, keep)
    model = fit(rows, labels, ~in_fold() & F.col("_key").isNotNull(), key)
    scored = _scored(rows, model, ["_key", "_row"])
    return scored.select("_row", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_positive(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows scored 0.5 or more, with their own columns."""
    return score_documents(docs, labels, key, text, docs.columns).where("predicted = 1").select("_row.*")
