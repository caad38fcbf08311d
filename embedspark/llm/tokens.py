"""Fast whole-text encoding with a tokenizer file of the ``tokenizers`` library.

The library's normaliser and splitter work between white space, so a text's ids are the ids of its
white-space separated words in order, and a word of letters with closing punctuation has the ids of both
parts in turn. Arrow splits the texts of a slice and numbers their distinct words and parts; each worker
keeps a bounded dictionary from parts to ids and asks the library only for unknown ones, many at a time;
numpy puts the ids of all texts together. ``tests/llm`` compares the ids with those of the library for
whole texts.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from embedspark.llm.common import per_worker

_PUNCTUATION = ".,;:!?*#$%&|"
_MAX_WORDS = 1 << 18
_AT_ONCE = 2048
#: Bytes of text that are worth encoding together.
SLICE_BYTES = 4_000_000


def _cores(words: pa.Array) -> pa.Array:
    """The letters of words that only end in punctuation; else the words themselves. ASCII ones in lower case."""
    stripped = pc.utf8_rtrim(words, characters=_PUNCTUATION)
    cores = pc.if_else(pc.utf8_is_alpha(stripped), stripped, words)
    return pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)


def _gather(ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a series of rows, and where each row's ids begin and the last end."""
    own = sizes[rows]
    until = np.concatenate([[0], np.cumsum(own)])
    return ids[np.arange(until[-1]) + np.repeat(firsts[rows] - until[:-1], own)], until


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Only a tokenizer whose pieces never span white space may be used. White space inside the
    tokenizer is wider than the ASCII white space that separates words here, which does no harm: a longer
    word is simply encoded whole. Special tokens in a text are treated as the library treats them.

    A part's slot is its place in ``firsts`` and ``sizes``, which say where its ids lie in ``ids``. About
    _MAX_WORDS slots outlive a slice of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots: dict = {"": 0}
        self.ids, self.firsts, self.sizes = np.zeros(0, "<u4"), np.zeros(1, "i8"), np.zeros(1, "i8")
        # Ids that end a word. Without any (another kind of tokenizer) words are always asked one by one.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def _keep(self, parts: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New slots for these parts."""
        slots, ends = len(self.firsts), len(self.ids) + np.cumsum(sizes)
        self.slots.update(zip(parts, range(slots, slots + len(sizes))))
        self.ids = np.concatenate([self.ids, ids])
        self.firsts = np.concatenate([self.firsts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _ask(self, parts: list[str]) -> None:
        """Slots from the library. Parts of letters only are sent as one text and told apart by their last ids."""
        letters = [w for w in parts if w.isalpha()]
        others = [w for w in parts if not w.isalpha()]
        names, ids, sizes = [], [], []
        for first in range(0, len(letters), _AT_ONCE):
            some = letters[first : first + _AT_ONCE]
            found = np.array(self._encode([" ".join(some)])[0].ids, "<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(some):
                names += some
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:  # some part is more than one word to the library
                others += some
        for first in range(0, len(others), _AT_ONCE):
            some = others[first : first + _AT_ONCE]
            found = [e.ids for e in self._encode(some)]
            names += some
            ids.append(np.array([i for own in found for i in own], "<u4"))
            sizes.append(np.array([len(own) for own in found]))
        self._keep(names, np.concatenate(ids), np.concatenate(sizes))

    def _slots_of(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.slots.get, distinct, repeat(-1)), "i8", len(distinct))
        unknown = np.flatnonzero(found < 0).tolist()
        if unknown:
            names = [distinct[i] for i in unknown]
            self._ask(names)
            found[unknown] = [self.slots[name] for name in names]
        return found[np.asarray(coded.indices)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in one array, and where each word begins and the last ends."""
        cores = _cores(words)
        slots = np.zeros((len(words), 2), "i8")
        slots[:, 0] = self._slots_of(cores)
        sizes = np.asarray(pc.utf8_length(cores))
        longer = np.flatnonzero(np.asarray(pc.utf8_length(words)) > sizes)
        if len(longer):
            pairs = zip(words.take(pa.array(longer)).to_pylist(), sizes[longer].tolist())
            slots[longer, 1] = self._slots_of(pa.array([word[size:] for word, size in pairs], pa.string()))
        ids, bounds = _gather(self.ids, self.firsts, self.sizes, slots.ravel())
        return ids, bounds[::2]

    def _forget(self, parts: int, slots: int) -> None:
        """Drops what this slice has added to a full dictionary."""
        if len(self.slots) > _MAX_WORDS and (parts >= _MAX_WORDS or len(self.slots) - parts > _MAX_WORDS):
            for part in list(islice(self.slots, parts, None)):
                del self.slots[part]
            if slots < len(self.firsts):
                self.ids = self.ids[: self.firsts[slots]].copy()
                self.firsts, self.sizes = self.firsts[:slots].copy(), self.sizes[:slots].copy()

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text begins and the last ends.

        Nulls count as empty. ``end_id``, if given, follows each text.
        """
        lists = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype("i8"))
        coded = lists.flatten().dictionary_encode()
        before = len(self.slots), len(self.firsts)
        ids, bounds = self._of_words(coded.dictionary)
        self._forget(*before)
        words = np.asarray(coded.indices)
        if end_id is not None:  # one more word, after each text
            words = np.insert(words, ends, len(bounds) - 1)
            ends = ends + np.arange(1, len(ends) + 1)
            ids, bounds = np.append(ids, np.uint32(end_id)), np.append(bounds, bounds[-1] + 1)
        ids, until = _gather(ids, bounds[:-1], np.diff(bounds), words)
        return ids, until[np.concatenate([[0], ends])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return per_worker("encoder " + path, lambda: WordEncoder(path))
