"""Removes every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else.

Texts are UTF-8 bytes; a string is repeated if it starts at two places, of one or of two documents.

*Candidates.* A window is the string of ``LENGTH`` bytes at a place. Its anchor is the gram of
``GRAM`` bytes in it with the smallest hash (the leftmost, if several), so equal windows have equal anchors at
equal offsets. The windows in a row that share an anchor make a block. Only blocks whose anchor's hash
occurs twice or more can hold a repeated window. Blocks that are equal as a whole are settled by counting.

*Suffix sort.* What is left, blocks that share an anchor but differ, is settled by sorting: the blocks'
suffixes from the anchor, and their reversed prefixes before it, go through a mergesort that compares two
of them by the length of their common extension, found by binary search over prefix polynomial
hashes. Neighbours' common extensions are verified byte by byte (should hashes ever collide, that batch is
sorted by its bytes). Two windows at one offset are equal if they lie in the same run of suffixes with
a common extension long enough, and likewise in the reversed prefixes.

*Hot anchors.* A passage in very many documents gives an anchor with very many different blocks. If
there are more than ``MAX_GROUP``, the blocks are halved and grouped anew by what the windows of a half
have in common, again and again: a half of one window is settled by counting, so every group ends small,
whatever the data. No step brings the blocks of one anchor together before that.

Null texts count as empty. Texts below the length lose nothing. Rows with equal text (also with equal or
null key) are occurrences like any other, so both lose what they share. Results go by the text, never by
the key. An empty table gives no rows. Further columns are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embedspark.llm.common import discard, frugal, mix64, near_rows, recording, whole_groups, written

LENGTH = 200
GRAM = 32
MAX_GROUP = 512
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype="u8") * np.uint64(0xD1B54A32D192ED03))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, "u8")
    return tuple(np.concatenate([one, np.cumprod(np.full(size, x, "u8"))]) for x in (_BASE, _UNBASE))


def _prefix_hashes(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """h with (h[j] - h[i]) / base**i the polynomial hash (modulo 2**64) of data[i:j]."""
    out = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[data] * powers[: len(data)], out=out[1:])
    return out


def _blocks(data: np.ndarray, powers, unpowers, length: int, gram: int):
    """first window, windows, anchor's distance from the first, anchor hash, block hash; data fits a chunk."""
    width = length - gram + 1
    h = _prefix_hashes(data, powers)
    grams, windows = len(data) - gram + 1, len(data) - length + 1
    g = mix64((h[gram:] - h[:-gram]) * unpowers[:grams])
    # The place in the low bits makes the leftmost of equal grams the smallest.
    rank = (g >> np.uint64(24) << np.uint64(24)) | np.arange(grams, dtype="u8")
    rows = -(-grams // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[:grams] = rank
    padded = padded.reshape(rows, width)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    smallest = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    anchor = (smallest & np.uint64((1 << 24) - 1)).astype("i8")
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, windows])
    anchor = anchor[first]
    whole = (h[first + count - 1 + length] - h[first]) * unpowers[first]
    shape = mix64(((anchor - first) * 1024 + count).astype("u8"))
    return first, count, anchor - first, g[anchor], mix64(whole ^ shape)


def _find_blocks(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unpowers = _powers(_CHUNK + length)
        for batch in batches:
            parts, held = [], 0
            for tie, text in zip(batch.column("tie").to_pylist(), batch.column("bytes")):
                size = len(text.as_buffer()) if text.is_valid else 0
                if size < length:
                    continue
                data = np.frombuffer(text.as_buffer(), "u1")
                for at in range(0, size - length + 1, _CHUNK):
                    first, count, before, anchor, block = _blocks(
                        data[at : at + _CHUNK + length - 1], powers, unpowers, length, gram
                    )
                    n = len(first)
                    parts.append((anchor, block, np.full(n, tie), np.full(n, size), first + at, before, count))
                    held += n
                if held > 50_000:
                    yield _batch(parts)
                    parts, held = [], 0
            if parts:
                yield _batch(parts)

    return frugal(run)


_NAMES = ["anchor", "block", "tie", "size", "first", "before", "windows"]


def _batch(parts) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    kinds = ["i8", "i8", "i8", "i8", "i8", "i4", "i4"]
    arrays = [pa.array(c.view("i8") if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _cut_contexts(length: int):
    names = ["anchor", "block", "n", "tie", "size", "first", "before", "windows", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for row in batch.slice(at, 100).to_pylist():
                    for b in row["blocks"]:
                        end = b["first"] + b["windows"] - 1 + length
                        context = row["bytes"][b["first"] : end]
                        rows.append(
                            (b["anchor"], b["block"], b["n"], row["tie"], row["size"], b["first"], b["before"], b["windows"], context)
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), _CONTEXT_KINDS)] if rows else [pa.array([], k) for k in _CONTEXT_KINDS],
                    names=names,
                )

    return frugal(run)


_CONTEXT_KINDS = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.binary()]
_CONTEXT = "anchor bigint, block bigint, n bigint, tie bigint, size bigint, first bigint, before int, windows int, context binary"


class _Strings:
    """Byte strings of one length limit with their prefix hashes, compared by common extension."""

    def __init__(self, rows: list[bytes], limit: int):
        self.length = np.array([len(r) for r in rows], "i8")
        self.bytes = np.zeros((len(rows), limit + 1), "u1")
        for i, row in enumerate(rows):
            self.bytes[i, : len(row)] = np.frombuffer(row, "u1")
        powers, _ = _powers(limit)
        self.hashes = np.zeros((len(rows), limit + 1), "u8")
        # All start at place 0, so the hash of a prefix needs no division by a power.
        np.cumsum(_BYTE[self.bytes[:, :limit]] * powers[:limit], axis=1, out=self.hashes[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search."""
        low, high = np.zeros(len(a), "i8"), np.minimum(self.length[a], self.length[b])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; of equal ones neither does."""
        common = self.extension(a, b)
        ends_a, ends_b = common >= self.length[a], common >= self.length[b]
        return np.where(ends_a | ends_b, ends_a & ~ends_b, self.bytes[a, common] < self.bytes[b, common])

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row numbers in order inside every group of neighbours; start and size are those of each row's group.

        Bottom-up mergesort of all groups at once: every row finds its place in the run it is merged
        with by binary search.
        """
        n = len(self.length)
        order, inside = np.arange(n), np.arange(n) - start
        run = 1
        while len(size) and run < size.max():
            number = inside // run
            other = start + (number ^ 1) * run
            last = np.minimum(other + run, start + size)
            active = np.flatnonzero(other < start + size)
            low, high = other[active].copy(), last[active].copy()
            second = (number[active] & 1).astype(bool)
            mine = order[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                theirs = order[middle]
                # Rows of the first run go before equal rows of the second.
                ahead = np.where(
                    second[open_], ~self.less(mine[open_], theirs), self.less(theirs, mine[open_])
                )
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            target = np.arange(n)
            own_run = start[active] + number[active] * run
            pair = np.minimum(own_run, other[active])
            target[active] = pair + (active - own_run) + (low - other[active])
            merged = np.empty_like(order)
            merged[target] = order
            order, run = merged, run * 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each row in order with the one before it, verified; -1 on a hash collision."""
        common = np.zeros(len(order), "i8")
        a, b = order[1:], order[:-1]
        common[1:] = self.extension(a, b)
        differs = self.bytes[a] != self.bytes[b]
        differs |= np.arange(differs.shape[1]) >= np.minimum(self.length[a], self.length[b])[:, None]
        exact = differs.argmax(1)
        return common if (exact == common[1:]).all() else None


def _ranks(rows: list[bytes], limit: int, group: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Order of rows inside their groups and common extensions of neighbours."""
    strings = _Strings(rows, limit)
    order = strings.sort(start, size)
    common = strings.neighbours(order)
    if common is None:  # colliding hashes: sort and compare the bytes themselves
        order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], rows[i])))
        common = np.zeros(len(rows), "i8")
        for k in range(1, len(rows)):
            a, b = rows[order[k]], rows[order[k - 1]]
            common[k] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    common[new] = -1
    return order, common


def matched_windows(group: np.ndarray, before: np.ndarray, windows: np.ndarray, n: np.ndarray, contexts: list[bytes], length: int):
    """For every block (rows of a group are neighbours) and anchor offset, whether that window occurs twice.

    ``n`` is the number of places where the whole block stands.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    right = _ranks([c[b:] for c, b in zip(contexts, before)], length, group, start, size)
    left = _ranks([c[:b][::-1] for c, b in zip(contexts, before)], length, group, start, size)
    found = np.zeros((len(group), length), bool)
    for offset in range(int(before.max()) + 1 if len(before) else 0):
        has = np.flatnonzero((offset <= before) & (offset > before - windows))
        if not len(has):
            continue
        keys = []
        for (order, common), depth in ((right, length - offset), (left, offset)):
            classes = np.empty(len(group), "i8")
            classes[order] = np.cumsum(common < depth)
            keys.append(classes[has])
        key = keys[0] * (len(group) + 1) + keys[1]
        _, place = np.unique(key, return_inverse=True)
        found[has, offset] = np.bincount(place, weights=n[has])[place] > 1
    return found


def _settle(length: int):
    names = ["tie", "size", "start", "end"]

    def spans(rows: pa.Table) -> pa.RecordBatch:
        group, before, windows, n, first, tie, size = (
            np.asarray(rows.column(c).combine_chunks()) for c in ("anchor", "before", "windows", "n", "first", "tie", "size")
        )
        found = matched_windows(group, before, windows, n, rows.column("context").to_pylist(), length)
        found[n > 1] = False  # their places are settled already
        block, offset = np.nonzero(found)
        place = first[block] + before[block] - offset
        order = np.lexsort((place, block))
        block, place = block[order], place[order]
        # Windows in a row that overlap make one span.
        new = np.r_[True, (block[1:] != block[:-1]) | (place[1:] > place[:-1] + length)] if len(block) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(block)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (tie[block[at]], size[block[at]], place[at], place[last] + length)] if len(block) else [pa.array([], pa.int64())] * 4,
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "anchor"):
            yield spans(rows)

    return frugal(run)


def _digest(data: bytes, *numbers: int) -> int:
    key = b",".join(str(x).encode() for x in numbers)
    return int.from_bytes(hashlib.blake2b(key + b":" + data, digest_size=8).digest(), "little", signed=True)


def _divide(level: int, length: int):
    """Cuts blocks at multiples of 2**level of the anchor offset; parts get new groups.

    The windows at offsets of one cell share the bytes from ``before - low`` to ``before - high + length``:
    equal windows have them in common, so their digest is the part's new group.
    """
    names = [f.split()[0] for f in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                high, context = r["before"], r["context"]
                low = high - r["windows"] + 1
                for cell in range(low >> level, (high >> level) + 1):
                    cell_low, cell_high = cell << level, ((cell + 1) << level) - 1
                    lo, hi = max(low, cell_low), min(high, cell_high)
                    part = context[high - hi : high - lo + length]
                    shared = context[high - cell_low : high - cell_high + length]
                    group = _digest(shared, r["anchor"], level, cell)
                    block = _digest(part, group, lo, hi)
                    rows.append((group, block, r["n"], r["tie"], r["size"], r["first"] + high - hi, hi, hi - lo + 1, part))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), _CONTEXT_KINDS)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frugal(run)


def _span(start, windows, length: int):
    return F.col(start).alias("start"), (F.col(start) + F.col(windows) - 1 + F.lit(length)).alias("end")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """tie, size, start, end: byte spans to remove from every text with that hash and size. They may overlap.

    ``rows`` has ``tie`` (a hash of the text) and ``bytes``.
    """
    schema = "anchor bigint, block bigint, tie bigint, size bigint, first bigint, before int, windows int"
    blocks = written(rows.mapInArrow(_find_blocks(length, gram), schema))
    # Anchors at two places or more; ``plain`` if all their blocks are equal.
    anchors = blocks.groupBy("anchor").agg(
        F.count("*").alias("places"), (F.min("block") == F.max("block")).alias("plain")
    )
    repeated = written(blocks.join(anchors.where("places > 1").drop("places"), "anchor"))
    discard(rows.sparkSession, [blocks.folder])
    spans = [repeated.where("plain").select("tie", "size", *_span("first", "windows", length))]

    mixed = repeated.where("not plain").drop("plain")
    place = F.struct("tie", "first")
    kinds = mixed.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(place).alias("keeper"))
    counted = written(mixed.join(kinds, ["anchor", "block"]))
    spans.append(counted.where("n > 1").select("tie", "size", *_span("first", "windows", length)))

    # One block of each kind goes on, if its anchor has others.
    kept = counted.where(place == F.col("keeper")).drop("keeper")
    kept = kept.dropDuplicates(["anchor", "block"])
    near, _ = near_rows(rows, kept, "tie")
    needed = kept.groupBy("tie", "size").agg(
        F.collect_list(F.struct("anchor", "block", "n", "first", "before", "windows")).alias("blocks")
    )
    texts = near.withColumn("size", F.octet_length("bytes").cast("bigint")).dropDuplicates(["tie", "size"])
    cut = needed.join(texts, ["tie", "size"]).select("tie", "size", "bytes", "blocks")
    open_ = written(cut.mapInArrow(_cut_contexts(length), _CONTEXT))
    level = (length - gram).bit_length() - 1
    small = []
    while True:
        sizes = open_.groupBy("anchor").agg(F.count("*").alias("members")).where(F.col("members") > max_group)
        hot = written(sizes.select("anchor"))
        if level < 0 or hot.isEmpty():
            small.append(open_)
            break
        small.append(written(open_.join(hot, "anchor", "left_anti")))
        parts = written(open_.join(hot, "anchor", "left_semi").mapInArrow(_divide(level, length), _CONTEXT))
        kinds = parts.groupBy("anchor", "block").agg(F.sum("n").alias("total"), F.min(place).alias("keeper"))
        joined = written(parts.join(kinds, ["anchor", "block"]))
        spans.append(
            joined.where("n = 1 and total > 1").select("tie", "size", *_span("first", "windows", length))
        )
        rest = joined.where(place == F.col("keeper")).withColumn("n", F.col("total")).drop("total", "keeper")
        open_ = written(rest.select(*open_.columns))  # only parts of hot anchors go on
        level -= 1
    grouped = functools.reduce(DataFrame.unionByName, small)
    grouped = grouped.repartition("anchor").sortWithinPartitions("anchor")
    spans.append(grouped.mapInArrow(_settle(length), "tie bigint, size bigint, start bigint, end bigint"))
    result = spans[0]
    for other in spans[1:]:
        result = result.unionByName(other)
    return result


def _remove():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for data, spans in zip(batch.column("bytes"), batch.column("spans")):
                data, merged = data.as_py(), []
                for start, end in sorted((s["start"], s["end"]) for s in spans.as_py()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                parts, at = [], 0
                for start, end in merged:
                    parts.append(data[at:start])
                    at = end
                kept.append(b"".join([*parts, data[at:]]))
                found.append([{"start": a, "end": b} for a, b in merged])
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("row"), batch.column("bytes"), pa.array(kept, pa.binary()), pa.array(found, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "bytes", "kept", "removed"])

    return frugal(run)


def dedup_substrings(
    docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP
) -> DataFrame:
    """One row per document: row (the columns to keep), bytes, kept (bytes that stay), removed (maximal spans)."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.xxhash64(text).alias("tie"),
        F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("bytes"),
    )
    with recording() as folders:
        spans = repeated_spans(rows.select("tie", "bytes"), length, gram, max_group)
        # Rows of equal text bring the same spans: sets are combined before the shuffle.
        found = written(spans.groupBy("tie", "size").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(docs.sparkSession, folders, keep=(found,))
    near, far = near_rows(rows, found, "tie")
    near = near.withColumn("size", F.octet_length("bytes").cast("bigint")).join(found, ["tie", "size"], "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    row = rows.schema["row"].dataType.simpleString()
    cut = (
        near.where("spans is not null")
        .select("row", "bytes", "spans")
        .mapInArrow(_remove(), f"row {row}, bytes binary, kept binary, removed array<struct<start:bigint,end:bigint>>")
    )
    whole = near.where("spans is null").select("row", "bytes").unionByName(far.select("row", "bytes"))
    return cut.unionByName(whole.select("row", "bytes", F.col("bytes").alias("kept"), none.alias("removed")))


def _decode():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [data.decode("utf-8", "ignore") for data in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "kept"])

    return frugal(run)


def without_repeats(docs: DataFrame, text: str = "text", sizes: dict | None = None, **settings) -> DataFrame:
    """The documents with their own columns, the text without its repeated bytes.

    A cut may leave a part of a character; that part goes too. ``sizes`` names columns to compute anew
    from the text where it has changed. Null texts stay null.
    """
    found = dedup_substrings(docs, docs.columns, text, **settings)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema["row"].dataType
    same = found.where(F.size("removed") == 0).select("row.*")
    cut = found.where(F.size("removed") > 0).select("row", "kept").mapInArrow(
        _decode(), f"row {row.simpleString()}, kept string"
    )
    new = {text: F.col("kept"), **{name: make(F.col("kept")) for name, make in (sizes or {}).items() if name in docs.columns}}
    kinds = {f.name: f.dataType for f in docs.schema}
    columns = [
        new[c].cast(kinds[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns
    ]
    return same.unionByName(cut.select(*columns))
