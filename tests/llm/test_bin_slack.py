"""Minimum-bin-slack packing against brute force and exact round trips."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from embedspark.llm import bin_slack, queries

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, end_id):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, end_id] for e in found]


def check_packing(rows, capacity, expected):
    """Rows tile every document and every sequence, and at most the last windows are not full."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    sizes = [sum(r["length"] for r in own) for own in by_sequence.values()]
    total = sum(map(len, itertools.chain.from_iterable(expected.values())))
    assert sum(sizes) == total
    assert len([s for s in sizes if s == capacity]) == total // capacity
    assert sorted(s for s in sizes if s < capacity) == [1 << b for b in range(20) if total % capacity >> b & 1]
    assert set(by_key) == set(expected)
    for key, documents in expected.items():
        wanted = Counter(map(tuple, documents))
        for r in by_key[key]:  # every piece is a part of a document of this key
            own = [d for d in documents if len(d) == r["doc_tokens"]]
            assert r["ids_crc32"] in {zlib.crc32(np.array(d[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for d in own}
        if sum(wanted.values()) == 1:
            at = 0
            for r in sorted(by_key[key], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(documents[0])


def expected_ids(rows, end_id):
    expected = defaultdict(list)
    for r, ids in zip(rows, library_ids([r["text"] for r in rows], end_id)):
        expected[r["doc_id"]].append(ids)
    return expected


@pytest.mark.parametrize("seed", range(40))
def test_closest_fill_is_the_best_subset(seed):
    random = np.random.default_rng(seed)
    pieces = Counter(random.integers(1, 40, random.integers(1, 11)).tolist())
    room = int(random.integers(1, 120))
    found = bin_slack.closest_fill(pieces.__getitem__, sorted(pieces), room)
    assert all(0 < n <= pieces[length] for length, n in found.items())
    each = list(pieces.elements())
    best = max(s for mask in itertools.product((0, 1), repeat=len(each)) if (s := sum(itertools.compress(each, mask))) <= room)
    assert sum(length * n for length, n in found.items()) == best


@pytest.mark.parametrize("sizes", [[3000] * 50, [1] * 9000, [4096] * 3, [5000, 4095, 2, 1], list(range(1, 400)), [2049] * 20])
def test_pool_wastes_nothing(sizes):
    pool = bin_slack.Pool(4096)
    for document, size in enumerate(sizes):
        for start in range(0, size, 4096):
            pool.add(document, start, min(4096, size - start))
    windows = list(pool.windows(0))
    assert all(sum(length for *_, length in w) == 4096 for w in windows) and len(windows) == sum(sizes) // 4096
    windows += pool.remainder()
    tokens = Counter((d, at) for w in windows for d, start, length in w for at in range(start, start + length))
    assert tokens == Counter((d, at) for d, size in enumerate(sizes) for at in range(size))


def test_query(spark, sf_dir):
    found = queries.QUERIES["op11_bin_slack_packing"](spark, sf_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_packing(found.collect(), 4096, expected_ids(docs, 2))


def test_levels_of_remainders(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(40, "doc_id")
    monkeypatch.setattr(bin_slack, "_FAN_IN", 3)
    packed = bin_slack.pack_documents(docs, TOKENIZER, 2, 256, pool_tokens=3000)
    check_packing(packed.collect(), 256, expected_ids(docs.select("doc_id", "text").collect(), 2))


ODD = [
    (1, None, "x"),
    (None, "no key " * 30, "x"),
    (2, "", "x"),
    (3, "  \n\t ", None),
    (4, "D\u00e9j\u00e0 vu, don't <|endoftext|> \u65e5\u672c\u8a9e 12%", "x"),
    (5, "word, words. " * 40_000, "x"),
    (6, "twice the very same row", "x"),
    (6, "twice the very same row", "x"),
    (7, "twice the very same row", "x"),
]


def test_odd_rows_and_real_sequences(spark):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, `ids` string").withColumn("x.y z", F.lit(1)).withColumn("sequence_id", F.lit("a"))
    packed = bin_slack.pack_documents(odd, TOKENIZER, 2, 64).cache()
    rows = packed.collect()
    expected = expected_ids([{"doc_id": k, "text": t} for k, t, _ in ODD], 2)
    check_packing(rows, 64, expected)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    windows = bin_slack.sequences(packed, 64, 7).collect()
    ids = Counter(i for w in windows for i in np.frombuffer(w["ids"], "<u4").tolist())
    assert ids == Counter(i for own in expected.values() for d in own for i in d)
    few = bin_slack.sequences(packed.where("offset = 0 AND length = 3"), 64, 7).collect()
    assert all(len(w["ids"]) == 4 * 64 and set(np.frombuffer(w["ids"], "<u4")[3:].tolist()) == {7} for w in few)


def test_empty_table(spark):
    assert bin_slack.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), TOKENIZER, 2, 64).count() == 0
