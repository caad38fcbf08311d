"""Periodic runs against their definition."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedspark.llm import periodic_runs, queries


def brute_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                own = words[start : start + length]
                if all(any(own[t] != own[t + d] for t in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


@pytest.mark.parametrize("seed", range(60))
def test_lce(seed):
    random = np.random.default_rng(seed)
    n = int(random.integers(1, 200))
    codes = random.integers(0, int(random.integers(1, 4)), n)
    if seed % 2:
        codes = np.tile(codes[: int(random.integers(1, 9))], 60)[:n]
    codes = np.append(codes, 9)
    lce = periodic_runs.CoverLce(codes)
    if len(codes) < 3:
        return
    i = random.integers(0, len(codes) - 1, 300)
    j = random.integers(0, len(codes) - 1, 300)
    i, j = i[i != j], j[i != j]
    for a, b, length in zip(i.tolist(), j.tolist(), lce(i, j).tolist()):
        expected = 0
        while max(a, b) + expected < len(codes) and codes[a + expected] == codes[b + expected]:
            expected += 1
        assert length == expected


def random_words(random):
    words = random.integers(0, int(random.integers(1, 5)), int(random.integers(0, 150))).tolist()
    for _ in range(int(random.integers(0, 4))):
        period = random.integers(0, 3, int(random.integers(1, 12))).tolist()
        at = int(random.integers(0, len(words) + 1))
        words[at:at] = (period * 9)[: int(random.integers(1, 9 * len(period)))]
    return words


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("at_once", [64, 1 << 20])
def test_runs_of_random_words(seed, at_once, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_AT_ONCE", at_once)
    random = np.random.default_rng(seed)
    texts = [random_words(random) for _ in range(12)]
    codes = np.array([w for t in texts for w in t], "i8")
    found = periodic_runs.find_runs(codes, np.array([len(t) for t in texts]))
    rows = list(zip(*(x.tolist() for x in found)))
    assert rows == [(k, *run) for k, t in enumerate(texts) for run in brute_runs(t)]


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    collapsed = " ".join(brute_collapsed(words, runs))
    milli = 1000 * length // period if runs else None
    return (doc_id, len(runs), start, length, period, milli, *(sha256(t.encode()).hexdigest() for t in (lines, collapsed)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, sf_dir):
    found = queries.QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert found.columns == COLUMNS
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 12_000]
    expected = [expected_row(r["doc_id"], r["text"]) for r in docs]
    assert sum(r[1] > 0 for r in expected) > 5
    got = {tuple(r) for r in found.collect()}
    assert not [r for r in expected if r not in got]


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a b " * 20), (None, None),
        (4, "no break no break " * 5), (5, "one"), (5, "one"), (6, "w " * 300),
        (7, "  lead a a a a a a tail\n"), (8, "a b c d e f"), (9, "x y x y x y x y z " * 7),
        (10, "日 \U0001f600 " * 9),
        *[(i, " ".join(f"w{j % (i % 13 + 2)}" for j in range(i))) for i in range(11, 160)],
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumn("row", F.lit(1)).withColumn("runs", F.lit("r")).withColumn("a.b c", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted((expected_row(*r) for r in rows), key=key)
    kept = periodic_runs.collapse_runs(docs, docs.columns).select("row.*").collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.collect()))


def test_very_long_texts(spark):
    random = np.random.default_rng(5)
    words = [f"v{x}" for x in random.integers(0, 50_000, 1_000_000)]
    words[400_000:700_000] = (words[:1234] * 244)[:300_000]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "same " * 400_000)], "doc_id bigint, text string")
    one, two = sorted(periodic_runs.collapse_runs(docs, ["doc_id"]).collect(), key=lambda r: r["row"]["doc_id"])
    assert one["n_words"] == 1_000_000
    assert [tuple(r) for r in one["runs"]] == [(400_000, 300_000, 1234)]
    assert one["collapsed"].split(" ") == words[:401_234] + words[700_000:]
    assert [tuple(r) for r in two["runs"]] == [(0, 400_000, 1)] and two["collapsed"] == "same"


def test_empty_table(spark):
    assert periodic_runs.collapse_runs(spark.createDataFrame([], "doc_id bigint, text string"), ["doc_id"]).count() == 0
