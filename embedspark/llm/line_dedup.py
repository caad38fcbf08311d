"""Substring deduplication by digests of lines or of passages.

*Lines* (``dedup_lines``): the lines of all texts are normalised (lower case, single blanks) and digested. Of
the lines with one digest the earliest by (key, text hash, line number) stays, all others go. Lines with fewer
than ``min_words`` words are never removed.

*Passages* (``dedup_passages``): a lone short line says little, since different documents hold it by chance, and
what is copied may stand inside a line. So lines are cut at the ends of sentences into units, and a
passage is a run of consecutive units of one document that holds ``min_words`` words, without a unit more than
that takes (counted from its first unit or back from its last one). Passages are normalised, digested and
grouped over all documents. The earliest by (key, text hash, unit number) stays; of all others every unit
goes, so what goes stands at an earlier place still. Units in no passage that stands earlier stay. A text
with fewer words than ``min_words`` has no passage.

What is removed is told by original offsets. A line that loses all its units goes with its line end. Null texts
stay null. Null keys come last in the order. Rows with the same key and the same text are one document: they
get the same result. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embedspark.llm.common import frugal, text_slices

_UNITS = "key bigint, tie bigint, unit int, start bigint, end bigint, digest binary"
_NAMES = ["key", "tie", "unit", "start", "end", "digest"]


def _units(min_words: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for key, tie, text in zip(*[part.column(c).to_pylist() for c in ("key", "tie", "text")]):
                    start = 0
                    for number, line in enumerate((text or "").split("\n")):
                        words = line.lower().split()
                        if len(words) >= min_words:
                            digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
                            rows.append((key, tie, number, start, start + len(line), digest))
                        start += len(line) + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)

    return units


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """The lines to remove: key, tie (hash of the text), unit (line number), start, end (characters)."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    units = rows.mapInArrow(_units(min_words), _UNITS)
    place = F.struct(F.col("key").isNull().alias("late"), "key", "tie", "unit")
    first = (
        units.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    later = units.join(first, "digest").where(place != F.col("first"))
    return later.select("key", "tie", "unit", "start", "end")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (spans of characters), text (what stays)."""
    gone = (
        removed_lines(docs, key, text, min_words)
        .distinct()
        .groupBy("key", "tie")
        .agg(F.sort_array(F.collect_list(F.struct("unit", "start", "end"))).alias("gone"))
        .select(F.col("key").alias("gone_key"), F.col("tie").alias("gone_tie"), "gone")
    )
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_key")) & (F.col("tie") == F.col("gone_tie")), "left")
    lines = F.split("text", "\n")
    units = F.transform("gone", lambda x: x["unit"])
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(units, i)), "\n")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        "doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.transform("gone", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), nothing).alias(
            "removed"
        ),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


#: Where a unit ends: at the end of a line, or after a sentence's last character. It starts with one set of characters, for
#: which texts are searched far faster than for places behind a character.
_UNIT_END = re.compile(r"[\n.!?。！？](?:(?<=[.!?])[^\S\n]+|(?<![.!?]))")


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the units, with or without a word."""
    start = 0
    for found in _UNIT_END.finditer(text):
        end, after = found.span()
        yield start, end + (text[end] != "\n")
        start = after
    yield start, len(text)


def sentence_units(text: str) -> list[tuple[int, int]]:
    """Start and end (characters) of the units that hold a word."""
    return [(start, end) for start, end in _pieces(text) if text[start:end].strip()]


def passages(lengths: list[int], min_words: int) -> list[tuple[int, int]]:
    """First and last unit of all shortest runs of units that hold so many words."""
    return list(zip(*(ends.tolist() for ends in _runs(lengths, min_words))))


def _runs(lengths: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(np.array(lengths, "i8"))])
    n = len(lengths)
    first = np.arange(n)
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # from each first unit on
    forward = (first << 32 | last)[last < n]
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # back from each last unit
    back = (start << 32 | first)[start >= 0]
    both = np.unique(np.concatenate([forward, back]))
    return both >> 32, both & 0xFFFFFFFF


def _passages(min_words: int):
    names, md5 = ["key", "tie", "unit", "units", "digest"], hashlib.md5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                owner, firsts, counts, digests = [], [], [], []
                for row, value in enumerate(part.column("text").to_pylist()):
                    text = value or ""
                    # Units without a word fall away here as in sentence_units.
                    words = [own for start, end in _pieces(text) if (own := text[start:end].lower().split())]
                    if not words:
                        continue
                    joined = [" ".join(own).encode("utf-8", "surrogatepass") for own in words]
                    first, last = _runs(list(map(len, words)), min_words)
                    whole, size = memoryview(b" ".join(joined)), np.fromiter(map(len, joined), "i8", len(joined))
                    end = np.cumsum(size + 1) - 1
                    digests += [md5(whole[x:y]).digest() for x, y in zip((end - size)[first].tolist(), end[last].tolist())]
                    owner.append(np.full(len(first), row))
                    firsts.append(first)
                    counts.append(last - first + 1)
                if digests:
                    at = pa.array(np.concatenate(owner))
                    columns = [part.column(c).take(at) for c in ("key", "tie")]
                    columns += [pa.array(np.concatenate(c).astype("i4")) for c in (firsts, counts)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], names=names)

    return frugal(run)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some units; lines that keep nothing go too."""
    lines, at, number = [], 0, 0
    for line in text.split("\n"):
        end, place, parts, cut = at + len(line), at, [], False
        while number < len(spans) and spans[number][0] < end:
            parts.append(text[place : spans[number][0]])
            place, number, cut = spans[number][1], number + 1, True
            while place < end and text[place].isspace():
                place += 1
        rest = "".join(parts) + text[place:end]
        if not cut:
            lines.append(rest)
        elif rest.strip():
            lines.append(rest.rstrip())
        at = end + 1
    return "\n".join(lines)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "doc_id bigint, n_units bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string()]
    names = ["doc_id", "n_units", "n_removed", "removed", "text"]
    for batch in batches:
        for part in text_slices(batch, "text"):
            rows = []
            for key, text, runs in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "gone")]):
                units = sentence_units(text or "")
                gone = np.zeros(len(units) + 1, "i8")
                for run in runs or ():
                    gone[run["unit"]] += 1
                    gone[run["unit"] + run["units"]] -= 1
                spans = [units[k] for k in np.flatnonzero(np.cumsum(gone)[:-1])]
                kept = without_spans(text, spans) if spans else text
                rows.append((key, len(units), len(spans), [{"start": s, "end": e} for s, e in spans], kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def removed_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 15) -> DataFrame:
    """The passages that stand earlier too: key, tie (hash of the text), unit (the first one), units (how many)."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    runs = rows.mapInArrow(_passages(min_words), "key bigint, tie bigint, unit int, units int, digest binary")
    place = F.struct(F.col("key").isNull().alias("late"), "key", "tie", "unit")
    first = (
        runs.groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("digest", "first")
    )
    return runs.join(first, "digest").where(place != F.col("first")).select("key", "tie", "unit", "units").distinct()


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 15) -> DataFrame:
    """One row per row: doc_id, n_units, n_removed, removed (spans of characters), text (what stays)."""
    gone = (
        removed_passages(docs, key, text, min_words)
        .groupBy("key", "tie")
        .agg(F.collect_list(F.struct("unit", "units")).alias("gone"))
        .select(F.col("key").alias("gone_key"), F.col("tie").alias("gone_tie"), "gone")
    )
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_key")) & (F.col("tie") == F.col("gone_tie")), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(frugal(_cut), _RESULT)
