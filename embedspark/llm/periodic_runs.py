"""Periodic runs of words in whole texts, and texts with each run collapsed to its first period.

Words are split at ASCII white space. A run is a stretch of consecutive words with smallest period q (words q apart are
equal) and a length of at least max(6, 4 * q) that no neighbouring word extends. Collapsing drops every word
that some run contains after that run's first q words.

Runs are enumerated on a harmonic grid. A run of period p has at least g = max(3 * p, 6 - p) places in a row
whose word equals the one p later, so it has a place that is a multiple of g: for each p only every g-th place is asked, n/3 * ln(n)
places in all. From there, longest common extensions (LCE) to both sides give the run's ends. The same words come
out for multiples of the smallest period; of these the smallest stays (a run of period p with a smaller period q is, by
the periodicity theorem, the run of q itself).

LCE by a difference cover: with the cover {0, 1, 3, 9} modulo 13, for any two places some shift below 13 leads both into the
cover. Only the suffixes at the covered 4 of 13 places are sorted (by 13 words at once, then by doubled ranks), with the common prefix
lengths of neighbours and a sparse table for their range minima. A query compares words until the shift,
below 13 of them, and asks the table for the rest. Places that differ at once, nearly all, end with the first words,
and the structure is built only over the documents of a slice of which some place is left. The texts of a slice share one structure,
parted by marks that occur once, so that nothing crosses documents.

Work and memory are bounded by a slice of texts, or one long text: n ln n for n words. Null texts have no words.
Empty texts and empty tables give no runs and no rows. Every row is taken by itself, whatever its key; equal rows give equal
results. Columns of any name stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from embedspark.llm.common import frugal, text_slices

MIN_WORDS, MIN_PERIODS = 6, 4
_MODULUS, _COVER = 13, np.array([0, 1, 3, 9])
_SLICE_BYTES = 2_000_000
_AT_ONCE = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

_COVERED = np.isin(np.arange(_MODULUS), _COVER)
#: By difference of two places modulo 13: a covered residue of the first for which the second is covered too.
_MEETING = np.array([next(a for a in _COVER if _COVERED[(a + d) % _MODULUS]) for d in range(_MODULUS)])


class CoverLce:
    """Longest common extensions to the right in an array of non-negative codes whose last code occurs once."""

    def __init__(self, codes: np.ndarray):
        n, top = len(codes), int(codes.max()) + 1
        self.codes = np.concatenate([codes, top + np.arange(2 * _MODULUS)])
        places = np.flatnonzero(np.tile(_COVERED, n // _MODULUS + 1)[:n])
        order, ranks = self._sorted(places, top + 2 * _MODULUS)
        self.rank = ranks[-1]
        self.table = [self._common(order, ranks).astype("i4")]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            half, below = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def _sorted(self, places: np.ndarray, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The covered places in the order of their suffixes, and the ranks by 13, 26, 52, ... words."""
        bits = max(1, top.bit_length())
        at_once, keys = max(1, 62 // bits), []
        for first in range(0, _MODULUS, at_once):
            key = np.zeros(len(places), "i8")
            for word in range(first, min(first + at_once, _MODULUS)):
                key = key << bits | self.codes[places + word]
            keys.append(key)
        ranks, step = [], _MODULUS
        while True:
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(order), bool)
            for key in keys:
                new[1:] |= key[order[1:]] != key[order[:-1]]
            found = np.full(len(self.codes), -1, "i4")
            found[places[order]] = np.cumsum(new)
            ranks.append(found)
            if new[1:].all():
                return places[order], ranks
            keys = [found[places], found[np.minimum(places + step, len(found) - 1)]]
            step *= 2

    def _common(self, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of neighbours in the order of suffixes."""
        a, b = order[:-1].copy(), order[1:].copy()
        last = len(self.codes) - 1
        for level in range(len(ranks) - 2, -1, -1):
            x, y = ranks[level][np.minimum(a, last)], ranks[level][np.minimum(b, last)]
            same = np.where((x == y) & (x >= 0), _MODULUS << level, 0)
            a += same
            b += same
        alive = np.ones(len(a), bool)
        for _ in range(_MODULUS - 1):
            alive &= self.codes[np.minimum(a, last)] == self.codes[np.minimum(b, last)]
            a += alive
            b += alive
        return a - order[:-1]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from ``i`` on equal those from ``j`` on; each ``i`` differs from its ``j``."""
        shift = (_MEETING[(j - i) % _MODULUS] - i) % _MODULUS
        length, alive = np.zeros(len(i), "i8"), np.ones(len(i), bool)
        for word in range(_MODULUS - 1):
            asked = np.flatnonzero(alive & (word < shift))
            if not len(asked):
                break
            same = self.codes[i[asked] + word] == self.codes[j[asked] + word]
            length[asked] += same
            alive[asked] = same
        rest = np.flatnonzero(alive)
        if len(rest):
            x, y = self.rank[i[rest] + shift[rest]], self.rank[j[rest] + shift[rest]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype("f8"))[1] - 1
            for one in np.unique(level).tolist():
                own = np.flatnonzero(level == one)
                row = self.table[one]
                length[rest[own]] += np.minimum(row[low[own]], row[high[own] - (1 << one)])
        return length


def _spacing(period: np.ndarray) -> np.ndarray:
    return np.maximum((MIN_PERIODS - 1) * period, MIN_WORDS - period)


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in it and period of all grid points, about _AT_ONCE at a time."""
    periods = np.where(sizes >= MIN_WORDS, sizes // MIN_PERIODS, 0)
    many = np.cumsum(periods)
    done = 0
    while done < (many[-1] if len(many) else 0):
        pairs = np.arange(done, min(done + _AT_ONCE // 4, many[-1]))
        text = np.searchsorted(many, pairs, side="right")
        period = pairs - (many[text] - periods[text]) + 1
        points = (sizes[text] - period - 1) // _spacing(period) + 1
        until = np.cumsum(points)
        pairs_at_once = max(1, int(np.searchsorted(until, _AT_ONCE)))
        text, period, points = text[:pairs_at_once], period[:pairs_at_once], points[:pairs_at_once]
        done += len(text)
        number = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        text, period = np.repeat(text, points), np.repeat(period, points)
        yield text, number * _spacing(period), period


def _promising(codes: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Grid points in three equal places in a row; every run has five at its grid points."""
    last = len(codes) - 1

    def same(shift, rows):
        at = np.clip(place[rows] + shift, 0, last)
        return codes[at] == codes[np.clip(place[rows] + period[rows] + shift, 0, last)]

    rows = np.flatnonzero(same(0, slice(None)))
    before, after = same(-1, rows), same(1, rows)
    rows, before, after = (x[before | after] for x in (rows, before, after))
    return rows[before & after | before & same(-2, rows) | after & same(2, rows)]


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs in texts whose words' codes follow each other in ``codes``.

    Sorted by text, start and period; starts count from the text's first word.
    """
    starts = np.cumsum(sizes) - sizes
    found = []
    for text, place, period in _grid(sizes):
        rows = _promising(codes, starts[text] + place, period)
        found.append((text[rows], place[rows], period[rows]))
    nothing = np.zeros(0, "i8")
    text, place, period = (np.concatenate([f[k] for f in found]) if found else nothing for k in range(3))
    if not len(text):
        return nothing, nothing, nothing, nothing
    # The promising texts behind each other, each between two marks.
    texts = np.unique(text)
    own = sizes[texts]
    first = np.cumsum(own + 1) - own
    words = np.full(int(own.sum()) + len(own) + 1, -1, "i8")
    words[np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())] = codes[
        np.repeat(starts[texts] - np.cumsum(own) + own, own) + np.arange(own.sum())
    ]
    marks = np.flatnonzero(words < 0)
    words[marks] = int(words.max()) + 1 + np.arange(len(marks))
    right, left = CoverLce(words), CoverLce(words[::-1].copy())
    begin = first[np.searchsorted(texts, text)]
    runs = []
    for at in range(0, len(text), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        i, p = begin[some] + place[some], period[some]
        back = left(len(words) - i, len(words) - i - p)
        length = back + p + right(i, i + p)
        good = length >= np.maximum(MIN_WORDS, MIN_PERIODS * p)
        runs.append(np.column_stack([text[some], place[some] - back, length, p])[good])
    runs = np.unique(np.concatenate(runs), axis=0)
    same = np.zeros(len(runs), bool)  # as the row before, but for a larger period
    same[1:] = (runs[1:, :3] == runs[:-1, :3]).all(axis=1)
    runs = runs[~same]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return tuple(runs.T)


def _collapse(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    lists = pc.ascii_split_whitespace(texts)
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype("i8")
    words = lists.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    bounds = before[np.concatenate([[0], np.cumsum(counts)])]
    if not full.all():
        words = words.filter(pa.array(full))
    sizes = np.diff(bounds)
    text, start, length, period = find_runs(np.asarray(words.dictionary_encode().indices).astype("i8"), sizes)
    steps = np.zeros(len(words) + 1, "i8")
    np.add.at(steps, bounds[text] + start + period, 1)
    np.add.at(steps, bounds[text] + start + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    if not kept.all():
        words = words.filter(pa.array(kept))
    offsets = np.concatenate([[0], np.cumsum(kept)])[bounds].astype("i4")
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")
    of_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype("i4")
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
    return sizes, pa.ListArray.from_arrays(pa.array(of_text), rows), collapsed


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", _SLICE_BYTES):
            sizes, runs, collapsed = _collapse(part.column("text"))
            columns = [part.column("row"), pa.array(sizes), runs, collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: ``row`` (the columns of ``keep``), ``n_words``, ``runs`` (start, length, period; by start and period) and ``collapsed``."""
    quoted = [F.col(f"`{name}`") for name in (*keep, text)]
    rows = docs.select(F.struct(*quoted[:-1]).alias("row"), quoted[-1].alias("text"))
    run = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
    fields = [rows.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())]
    return rows.mapInArrow(frugal(_collapse_batches), StructType(fields))
