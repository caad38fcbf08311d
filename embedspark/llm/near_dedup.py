"""Near-duplicate classes by ProbMinHash.

A text's five-word shingles, weighted by how often they occur, form a distribution. Each shingle sends
points of a Poisson process whose rate is its weight; every point falls into one of ``REGISTERS``
registers. A register keeps the shingle of its earliest point. Two texts agree in a register with the
probability of their probability Jaccard similarity (for texts that repeat no shingle: the plain Jaccard
similarity). Points later than the moment at which all registers are filled cannot matter, so the
processes stop there.

*Banding.* Of a register only the lowest byte of its shingle's hash is kept. Different shingles agree in it
once in 256, which can only add pairs to be compared. Registers are cut into bands of ``ROWS``; texts that
agree in a band meet. A pair with similarity 0.8 misses all bands with probability 3e-5.

*Verification.* Met pairs whose registers agree often enough are compared exactly. First only the
strongest pairs that hold a band's members together are compared, and the links found give
components. Then every bucket that still holds several components compares all its pairs between
components inside one task, where a link joins its components at once. So a bucket sends on less than
one pair for each member however alike its texts are, yet no met pair between components is left out. Only the
members that agree often enough with one of another component are given their texts for that.

Texts with equal words are one text from the start. Large buckets are cut into blocks, by members and by
characters, and every pair of blocks is a cell, so no task gets more than two blocks.

Null and wordless texts are in a class of their own each (their key). Texts of fewer than five words have one
shingle, all their words. Rows are told apart by a written row number, texts by the digest of their
words; keys only name them and may be null or repeated. The first row of a class is the one with the
smallest (key, text hash, row number), null keys last. The class id is that row's key, null if no row
of the class has a key; where one key has several texts, ``class_hash`` (the first row's text hash)
tells their classes apart. An empty table gives no rows. Further columns may have any
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from embedspark.llm.common import discard, frugal, mix64, near_rows, per_worker, recording, text_slices, unit, whole_groups, written
from embedspark.llm.components import components

SIMILARITY = 0.8
SHINGLE = 5
ROWS, BANDS = 5, 26
REGISTERS = ROWS * BANDS
#: A band's key is its registers times this, plus its number.
_BAND_ROOM = 32
BLOCK, BLOCK_CHARS = 512, 16 << 20
#: Hash buckets that spare texts a shuffle: a broadcast of at most so many numbers.
_FILTER = 1 << 20
#: 3.5 standard deviations of the estimate below the similarity asked for.
LEAST_AGREEMENT = SIMILARITY - 3.5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
_MAX_WORDS = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < _MAX_WORDS:
            self[word] = value
        return value


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs."""
    hashes = per_worker("word hashes", _WordHashes)
    w = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, "u8")
    for k in range(size):
        h = mix64(h * _STEP + w[k : k + len(h)]) if k == size - 1 else h * _STEP + w[k : k + len(h)]
    return np.unique(h, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each register the element whose point came first."""
    total = weights.sum()
    until = REGISTERS * (np.log(REGISTERS) + 4) / total
    per_round = np.uint64(64 if len(elements) <= 200 else 4)
    while True:
        times, registers, owners = [], [], []
        active, at, number = np.arange(len(elements)), np.zeros(len(elements)), np.uint64(0)
        while len(active):
            steps = (np.arange(per_round, dtype="u8") + number + np.uint64(1)) * _STEP
            bits = mix64(elements[active][:, None] + steps[None, :])
            t = at[active][:, None] + np.cumsum(-np.log(unit(bits)), axis=1) / weights[active][:, None]
            row, column = np.nonzero(t < until)
            times.append(t[row, column])
            registers.append((mix64(bits[row, column]) >> np.uint64(16)) % np.uint64(REGISTERS))
            owners.append(active[row])
            at[active] = t[:, -1]
            active = active[t[:, -1] < until]
            number += per_round
        time, register, owner = (np.concatenate(x) for x in (times, registers, owners))
        order = np.argsort(time, kind="stable")
        found, first = np.unique(register[order], return_index=True)
        if len(found) == REGISTERS:
            return elements[owner[order[first]]]
        until *= 2  # some register is still empty: let the processes run on


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted shingle sets, exactly."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][ia].astype("f8"), b[1][ib].astype("f8")
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratios, place = np.unique(x / y, return_inverse=True)
    # sum over all shingles of max(x', r y') for each ratio r = x / y that occurs
    sums = np.array([only_a + r * only_b + np.maximum(x, r * y).sum() for r in ratios])
    return float((x / sums[place]).sum())


def _sign():
    names = ["row", "digest", "size", "registers"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
                    words = (text or "").split()
                    if not words:
                        rows.append((row, None, None, None))
                        continue
                    digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
                    rows.append((row, digest, len(text), signature(*shingles(words)).astype("u1").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return frugal(run)


def _bands() -> Column:
    """The keys of all bands of a text."""

    def key(number: Column) -> Column:
        own = F.substr("registers", number * ROWS + 1, F.lit(ROWS))
        return F.conv(F.hex(own), 16, 10).cast("bigint") * _BAND_ROOM + number

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)


def _agreement(registers: np.ndarray, i: np.ndarray | slice) -> np.ndarray:
    """Equal registers of some rows with all rows."""
    return registers[i][:, None, :] == registers[None, :, :]


def _cell_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each cell of two members and more, with its nodes and registers."""
    for rows in whole_groups(batches, "cell", 1024):
        cell = np.asarray(rows.column("cell").combine_chunks())
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(cell)]):
            if end - start > 1:
                part = rows.slice(start, end - start)
                nodes = np.asarray(part.column("node").combine_chunks())
                registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), "u1").reshape(-1, REGISTERS)
                yield part, nodes, registers


def _row_blocks(n: int) -> Iterator[np.ndarray]:
    """Row numbers in parts whose comparison with all n rows takes bounded memory."""
    step = max(1, 20_000_000 // (REGISTERS * n))
    for at in range(0, n, step):
        yield np.arange(at, min(n, at + step))


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(sorted({(min(p), max(p)) for p in found}), "i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _strong_pairs():
    """The strongest pairs that hold a cell's members together: less than one for each member."""

    def forest(share: np.ndarray) -> list[tuple[int, int]]:
        n, pairs = len(share), []
        left, best, via = np.ones(n, bool), np.full(n, -1.0), np.zeros(n, "i8")
        for _ in range(n):
            k = int(np.where(left, best, -2).argmax())
            if best[k] >= LEAST_AGREEMENT:
                pairs.append((int(via[k]), k))
            left[k] = False
            better = left & (share[k] > best)
            best[better], via[better] = share[k][better], k
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, registers in _cell_parts(batches):
            share = np.concatenate([_agreement(registers, own).mean(2) for own in _row_blocks(len(nodes))])
            yield _pair_batch([(int(nodes[i]), int(nodes[j])) for i, j in forest(share)])

    return frugal(run)


def _candidates(cell: pa.Table, registers: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Pairs of a cell's rows of different components, those that agree most first."""
    sides = np.asarray(cell.column("side").combine_chunks())
    low, high, band = (int(cell.column(c)[0].as_py()) for c in ("i", "j", "number"))
    every, found, shares = np.arange(len(labels)), [], []
    for own in _row_blocks(len(labels)):
        equal = _agreement(registers, own)
        share = equal.mean(2)
        good = (share >= LEAST_AGREEMENT) & (labels[own][:, None] != labels[None, :])
        if low == high:
            good &= own[:, None] < every[None, :]
        else:
            good &= (sides[own] == low)[:, None] & (sides == high)[None, :]
        r, c = np.nonzero(good)
        # Of all bands in which two rows meet, the first one compares them.
        here = equal[r, c].reshape(len(r), BANDS, ROWS).all(2).argmax(1) == band
        found.append(np.stack([own[r[here]], c[here]], axis=1))
        shares.append(share[r[here], c[here]])
    return np.concatenate(found)[np.argsort(-np.concatenate(shares), kind="stable")]


def _likely():
    """The rows of a cell that are in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _, registers in _cell_parts(batches):
            pairs = _candidates(cell, registers, np.asarray(cell.column("label").combine_chunks()))
            if len(pairs):
                yield from cell.take(pa.array(np.unique(pairs))).to_batches()

    return frugal(run)


def _links_across():
    """Links between a cell's components, compared exactly: less than one for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, nodes, registers in _cell_parts(batches):
            names, labels = np.unique(np.asarray(cell.column("label").combine_chunks()), return_inverse=True)
            parent, found, texts = list(range(len(names))), [], cell.column("text")

            def top(label: int) -> int:
                while parent[label] != label:
                    parent[label] = label = parent[parent[label]]
                return label

            of = cache(lambda row: shingles(texts[row].as_py().split()))
            for i, j in _candidates(cell, registers, labels).tolist():
                one, other = top(labels[i]), top(labels[j])
                if one != other and similarity(of(i), of(j)) >= SIMILARITY - 1e-12:
                    parent[one] = other
                    found.append((int(nodes[i]), int(nodes[j])))
            yield _pair_batch(found)

    return frugal(run)


def _verify():
    """The pairs that are similar enough; the two rows of a pair follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=64)(lambda text: shingles(text.split()))
        first = None
        for part in chain.from_iterable(text_slices(batch, "text") for batch in batches):
            found = []
            for pair, text in zip(zip(part.column("a").to_pylist(), part.column("b").to_pylist()), part.column("text")):
                if first is None:
                    first = text.as_py()
                    continue
                if similarity(of(first), of(text.as_py())) >= SIMILARITY - 1e-12:
                    found.append(pair)
                first = None
            if found:
                yield _pair_batch(found)

    return frugal(run)


def _links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are similar enough, compared by their texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"), "a", "b")
    near, _ = near_rows(rows, ends, "row", _FILTER)
    sides = near.join(ends, "row").repartition("a", "b").sortWithinPartitions("a", "b", "row")
    return written(sides.select("a", "b", "text").mapInArrow(_verify(), "a bigint, b bigint"))


def _place() -> Column:
    """The order of the rows of a class."""
    return F.struct(F.col("key").isNull().alias("late"), "key", "hash", "row")


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (all columns) and row: a number that stays, because it is written."""
    every = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return written(docs.select(every.alias("doc"), F.monotonically_increasing_id().alias("row")), codec="zstd")


def _labels(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, label: every linked text with the smallest node of its class."""
    met = nodes.select("node", "size", F.explode(_bands()).alias("band"))
    sizes = met.groupBy("band").agg(F.count("*").alias("members"), F.sum("size").alias("chars")).where("members > 1")
    members = written(met.drop("size").join(sizes, "band"))
    registers = written(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "registers"))
    # A bucket of more than one block becomes a triangle of cells.
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    celled = (
        members.withColumns({"side": side, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        .withColumns({"cell": F.xxhash64("band", "i", "j"), "number": (F.col("band") % _BAND_ROOM).cast("int")})
        .select("cell", "number", "i", "j", "side", "node")
    )
    cells = celled.select("cell", "node").join(registers, "node").select("cell", "node", "registers")
    strong = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_strong_pairs(), "a bigint, b bigint")
    strong = written(strong.distinct())
    # Who is in no strong pair agrees nowhere often enough, so these texts are all that is compared.
    ends = written(strong.select(F.col("a").alias("node")).union(strong.select("b")).distinct())
    links = _links(strong, rows)
    labels = components(links)

    named = celled.join(ends, "node", "left_semi")
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rest = named.join(written(open_.select("cell")), "cell").join(registers, "node")
    rest = rest.select("cell", "number", "i", "j", "side", "node", "label", "registers")
    kinds = "cell bigint, number int, i int, j int, side int, node bigint, label bigint, registers binary"
    likely = written(rest.repartition("cell").sortWithinPartitions("cell").mapInArrow(_likely(), kinds))
    near, _ = near_rows(rows, likely.select(F.col("node").alias("row")), "row", _FILTER)
    texts = likely.join(near.withColumnRenamed("row", "node"), "node")
    more = texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_across(), "a bigint, b bigint")
    more = written(more.distinct())
    return labels if more.isEmpty() else components(links.union(more))


def _classes(numbered: DataFrame, key: str, text: str) -> DataFrame:
    """One row per numbered row: row, key, first (place of the first row of its class)."""
    rows = numbered.select("row", F.col("doc")[text].alias("text"))
    signed = written(rows.mapInArrow(_sign(), "row bigint, digest binary, size bigint, registers binary"))
    digests = signed.where("digest is not null").select("row", "digest")
    # A node is a text: it is named by the smallest row number that has it.
    firsts = written(digests.groupBy("digest").agg(F.min("row").alias("node")))
    with recording() as folders:
        nodes = signed.join(firsts.select(F.col("node").alias("row")), "row", "left_semi")
        labels = _labels(written(nodes.select(F.col("row").alias("node"), "size", "registers")), rows)
    discard(numbered.sparkSession, folders, keep=(labels,))

    names = firsts.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    own_key, own_text = F.col("doc")[key], F.col("doc")[text]
    places = numbered.select("row", own_key.cast("bigint").alias("key"), F.xxhash64(own_text).alias("hash"))
    wordy = written(digests.join(names, "digest").select("row", "label").join(places, "row"))
    first = wordy.groupBy("label").agg(F.min(_place()).alias("first"))
    wordless = places.join(signed.where("digest is null").select("row"), "row", "left_semi")
    return (
        wordy.join(first, "label")
        .select("row", "key", "first")
        .unionByName(wordless.select("row", "key", _place().alias("first")))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_hash."""
    classes = _classes(_numbered(docs.select(key, text)), key, text)
    return classes.select(
        F.col("key").alias("doc_id"), F.col("first.key").alias("class_id"), F.col("first.hash").alias("class_hash")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each class, with its own columns."""
    with recording() as folders:
        numbered = _numbered(docs)
        classes = _classes(numbered, key, text)
        gone = written(classes.where("row <> first.row").select("row"))
    discard(docs.sparkSession, folders, keep=(numbered, gone))
    near, far = near_rows(numbered, gone, "row", _FILTER)
    return near.join(gone, "row", "left_anti").unionByName(far).select("doc.*")
