"""Reproducible sampled segmentations of a SentencePiece vocabulary, and lossless decoding.

All ways to cut a text into pieces form a lattice. Forward filtering sums, for every place, the weights of all ways
to reach it; backward sampling then walks from the end and picks each last piece with its share of that
sum. So whole segmentations are drawn with probability proportional to the product of their pieces' weights.
The random numbers come from the row's key, the word's place and the step, by hashing: the same key and text
give the same pieces, wherever the row is processed.

Pieces never span blanks except at their front, so the lattice of a text falls into those of its words.
Words repeat: the distinct words of some 500,000 characters of text are filtered together, and all their words are walked together.

The vocabulary file ranks its pieces instead of giving probabilities; a piece of rank r weighs
``(r + 10) ** -power``. Characters without a piece become byte pieces, a literal block mark (U+2581) included, so decoding
gives back every text exactly. Null texts have null ids, empty ones none. Null keys draw like key 0. Rows
with equal key and text get equal pieces. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embedspark.llm.common import mix64, per_worker, text_slices, unit

_WORDS = re.compile(" *[^ \n]+|\n| +")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = "▁"


class Vocabulary:
    """Pieces as plain text (blank instead of the block mark), byte pieces, and weights."""

    def __init__(self, path: str, power: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.of_text: dict[str, int] = {}
        self.of_byte = np.zeros(256, "u4")
        self.bytes: list[bytes] = [b""] * model.get_piece_size()
        ranks = {}
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.of_byte[value], self.bytes[number] = number, bytes([value])
            elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
                text = piece.replace(_MARK, " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError("pieces must not span words")
                self.of_text[text], self.bytes[number] = number, text.encode()
                ranks[number] = model.get_score(number)
        order = sorted(ranks, key=lambda i: (-ranks[i], i))
        self.weight = np.zeros(model.get_piece_size())
        self.weight[order] = (np.arange(len(order)) + 10.0) ** -power
        self.longest = max(map(len, self.of_text))
        self._index()

    def _index(self) -> None:
        """A tree of all pieces: sorted keys (node, character) with the nodes they lead to. The root is 0."""
        edges: dict[int, int] = {}
        pieces = {}
        for text, number in self.of_text.items():
            node = 0
            for character in text:
                node = edges.setdefault(node << 21 | ord(character), len(edges) + 1)
            pieces[node] = number
        self._keys = np.array(sorted(edges), "i8")
        self._next = np.array([edges[k] for k in self._keys.tolist()], "i8")
        self.piece_at = np.full(len(edges) + 1, -1, "i8")
        self.piece_at[list(pieces)] = list(pieces.values())
        # Where a key stands: by a table of hashes, or by search where several keys share a slot (-2).
        self._shift = np.uint64(64 - (8 * len(edges)).bit_length())
        self._table = np.full(1 << (8 * len(edges)).bit_length(), -1, "i4")
        slots = self._slot(self._keys)
        self._table[slots] = np.arange(len(slots))
        taken, times = np.unique(slots, return_counts=True)
        self._table[taken[times > 1]] = -2

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view("u8") * _STEP) >> self._shift).view("i8")

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to; 0 where there is none."""
        key = node << 21 | code
        at = self._table[self._slot(key)]
        shared = np.flatnonzero(at == -2)
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self._keys, key[shared]), len(self._keys) - 1)
        at = np.maximum(at, 0)
        return np.where(self._keys[at] == key, self._next[at], 0)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges in a row."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class _Lattice:
    """The lattices of many words at once, filtered forward.

    A state is a word and a place in it; words follow each other, so that place p of word w is state
    ``base[w] + p``. Edges are grouped by the state they end in, groups by place, so that one pass over
    the places filters all words. An id below -1 stands for the bytes of a character.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        v = vocabulary
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
        self.size = np.fromiter(map(len, words), "i8", len(words))
        self.base = np.cumsum(self.size + 1) - self.size - 1
        place = _spread(np.zeros(len(words), "i8"), self.size)
        state = np.repeat(self.base, self.size) + place
        room = np.repeat(self.size, self.size) - place
        froms, lengths, ids = [], [], []
        active, node, depth = np.arange(len(codes)), np.zeros(len(codes), "i8"), 0
        while len(active):
            node = v.step(node, codes[active + depth])
            depth += 1
            active, node = active[node > 0], node[node > 0]
            piece = v.piece_at[node]
            found = piece >= 0
            froms.append(active[found])
            ids.append(piece[found])
            lengths.append(np.full(len(froms[-1]), depth, "i8"))
            if depth == 1:
                alone = np.ones(len(codes), bool)
                alone[froms[0]] = False
            more = room[active] > depth
            active, node = active[more], node[more]
        alone = np.flatnonzero(alone) if len(codes) else np.zeros(0, "i8")
        froms, lengths, ids = (
            np.concatenate([*x, y]) for x, y in ((froms, alone), (lengths, np.ones(len(alone), "i8")), (ids, -2 - codes[alone]))
        )
        weights = np.where(ids >= 0, v.weight[np.maximum(ids, 0)], 1e-6)
        ends, froms = place[froms] + lengths, state[froms]
        tos = froms + lengths
        # By place, then state, then length: one number, which no two edges share, sorts far faster than three.
        longest = int(lengths.max(initial=0)) + 1
        order = np.argsort((ends * (int(self.size.sum()) + len(words)) + tos) * longest - lengths)
        self.froms, self.ids, tos, ends = froms[order], ids[order], tos[order], ends[order]
        self.first = np.flatnonzero(np.diff(tos, prepend=-1))
        self.group = np.zeros(int(self.size.sum()) + len(words), "i8")
        self.group[tos[self.first]] = np.arange(len(self.first))
        self.rising = self._filter(weights[order], tos, ends, v.longest)

    def _filter(self, weights: np.ndarray, tos: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """Group number plus the share of the group's edges up to each one."""
        counts = np.diff(self.first, append=len(tos))
        reach = np.zeros(len(self.group))
        reach[self.base] = 1.0
        share = np.zeros(len(tos))
        steps = np.flatnonzero(np.diff(ends[self.first], prepend=0))
        for low, high in zip(steps.tolist(), [*steps[1:].tolist(), len(self.first)]):
            own = slice(self.first[low], self.first[low] + counts[low:high].sum())
            part = reach[self.froms[own]] * weights[own]
            total = np.add.reduceat(part, self.first[low:high] - self.first[low])
            share[own] = part / np.repeat(total, counts[low:high])
            now = tos[self.first[low:high]]
            reach[now] = total
            small = now[total < 1e-100]
            if len(small):  # keep the numbers of long words in range
                back = min(int(ends[self.first[low]]), longest)
                for k in range(back + 1):
                    reach[small - k] *= 1e100
        run = np.cumsum(share)
        number = np.repeat(np.arange(len(counts)), counts)
        share = np.minimum(run - (run - share)[self.first][number], 1.0)
        share[self.first + counts - 1] = 1.0
        return number + share

    def draw(self, state: np.ndarray, random: np.ndarray) -> np.ndarray:
        """An edge that ends in each state, with its share as probability."""
        group = self.group[state]
        return np.maximum(np.searchsorted(self.rising, group + random), self.first[group])


def sample(texts: list[str | None], seeds: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray | None]:
    """Sampled ids of every text; null for null."""
    split = [_WORDS.findall(" " + t) if t else [] for t in texts]
    lengths = np.fromiter(map(len, split), "i8", len(split))
    flat = list(chain.from_iterable(split))
    if not flat:
        return [None if t is None else np.zeros(0, "u4") for t in texts]
    distinct = list(dict.fromkeys(flat))
    numbers = {w: i for i, w in enumerate(distinct)}
    lattice = _Lattice(distinct, vocabulary)
    word = np.fromiter(map(numbers.__getitem__, flat), "i8", len(flat))
    row = np.repeat(np.arange(len(texts)), lengths)
    place = _spread(np.zeros(len(texts), "i8"), lengths)
    key = mix64(seeds.astype("i8").view("u8")[row] + mix64((place + 1).astype("u8")))
    base = lattice.base[word]
    active, now, step = np.arange(len(word)), base + lattice.size[word], 0
    count = np.zeros(len(word), "i8")
    walked = []
    while len(active):
        step += 1
        edge = lattice.draw(now, unit(mix64(key[active] + np.uint64(step * int(_STEP) % (1 << 64)))))
        walked.append((active, lattice.ids[edge]))
        count[active] = step
        now = lattice.froms[edge]
        go = now > base[active]
        active, now = active[go], now[go]
    # The walk of a word goes from its last piece to its first one.
    picked, end = np.zeros(int(count.sum()), "i8"), np.cumsum(count)
    for step, (who, ids) in enumerate(walked, 1):
        picked[end[who] - step] = ids
    owner = np.repeat(row, count)
    special = np.flatnonzero(picked < 0)
    if len(special):
        found = {c: vocabulary.of_byte[np.frombuffer(chr(-2 - c).encode("utf-8", "surrogatepass"), "u1")] for c in np.unique(picked[special]).tolist()}
        times = np.ones(len(picked), "i8")
        times[special] = [len(found[c]) for c in picked[special].tolist()]
        at = np.cumsum(times) - times
        owner, spread = np.repeat(owner, times), np.repeat(picked, times)
        for k in special.tolist():
            spread[at[k] : at[k] + times[k]] = found[int(picked[k])]
        picked = spread
    pieces = np.bincount(owner, minlength=len(texts))
    cuts = np.cumsum(pieces)[:-1]
    return [None if t is None else part for t, part in zip(texts, np.split(picked.astype("<u4"), cuts))]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of the ids."""
    data = b"".join(map(vocabulary.bytes.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "surrogatepass") if len(data) else ""


def sample_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", power: float = 1.0) -> DataFrame:
    """doc_id, ids (u32 little-endian), decoded (the text the ids give back)."""
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(key).cast("bigint"), F.lit(0))).alias("seed"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = per_worker(f"pieces {model} {power}", lambda: Vocabulary(model, power))
        for batch in batches:
            for part in text_slices(batch, "text"):
                seeds = np.asarray(part.column("seed"))
                found = sample(part.column("text").to_pylist(), seeds, vocabulary)
                ids = pa.array([None if f is None else f.tobytes() for f in found], pa.binary())
                texts = pa.array([None if f is None else decode(f, vocabulary) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, texts], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id bigint, ids binary, decoded string")
