"""The operators of the training-data package against brute force on small tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embedspark.llm import (
    classifier,
    common,
    line_dedup,
    near_dedup,
    nearest,
    packing,
    piece_sampling,
    quality_rules,
    queries,
    sharding,
    suffix_dedup,
    token_files,
)
from embedspark.llm.tokens import WordEncoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
ODD = [
    (1, None, "en", None, None, "x"),
    (None, "the same words of a row without a key " * 3, None, "s", 1, None),
    (2, "", "de", "s", 0, "x"),
    (3, "  \n\t ", "xx", "s", 0, "x"),
    (4, "Déjà vu, don't <|endoftext|> 日本語 \U0001f600 ▁ 12%", "fr", "s", 9, "x"),
    (5, "word " * 4000, "en", "s", 9, "x"),
    (6, "twice the very same row", "en", "s", 9, "x"),
    (6, "twice the very same row", "en", "s", 9, "x"),
    (7, "twice the very same row", "en", "s", 9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(texts):
    encoder = WordEncoder(TOKENIZER)
    asked = [t for _, t, *_ in ODD] + list(texts.values())[:40]
    asked += ["İstanbul İ İ", "áb é,", "x\x1cy z w", "it's we've 'll", "ends.,!", "ΣΑΣ ς"]
    for text, ids in zip(asked, encoder.encode(asked)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)


def test_packed_ids_round_trip_and_direct_access():
    random = np.random.default_rng(1)
    for ids in ([], [0], [255, 256], random.integers(0, 2**32, 3000), random.integers(0, 49408, 10_000)):
        ids = np.array(ids, "u4")
        packed = token_files.PackedIds(token_files.pack_ids(ids))
        assert packed.all().tolist() == ids.tolist()
        for place in random.integers(0, len(ids), 50) if len(ids) else []:
            assert packed[int(place)] == ids[place]


def test_token_files(spark, odd, empty, tmp_path):
    token_files.write_token_files(odd, f"{tmp_path}/t", TOKENIZER, 1, segment_tokens=50)
    rows = token_files.read_documents(spark, f"{tmp_path}/t").orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k) and len(rows) == len(ODD)
    by_key = {k: library_ids(t) + [1] for k, t, *_ in ODD}
    flat = []
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["start"] == len(flat) and ids == by_key[row["doc_id"]]
        flat += ids
    places = spark.createDataFrame([(p,) for p in [-1, 0, 7, len(flat) - 1, len(flat)]], "position long")
    found = {r["position"]: r["token_id"] for r in token_files.read_tokens(spark, f"{tmp_path}/t", places).collect()}
    assert found == {p: flat[p] for p in (0, 7, len(flat) - 1)}
    token_files.write_token_files(empty, f"{tmp_path}/e", TOKENIZER, 1)
    assert token_files.read_documents(spark, f"{tmp_path}/e").count() == 0


def one_by_one(lengths, capacity):
    """Best-two-fit with single pieces, for comparison."""
    left, bins = Counter(lengths), 0
    while left:
        taken, gap = [], capacity
        while fitting := [x for x in left if x <= gap]:
            taken.append(max(fitting))
            gap -= taken[-1]
            left[taken[-1]] -= 1
            left += Counter()
        if gap and len(taken) > 1:
            small = min(taken)
            free = left + Counter([small])
            pairs = [(a + b, max(a, b)) for a in free for b in free if a + b <= gap + small and (a != b or free[a] > 1)]
            best = max(pairs, default=(0, 0))
            if best[0] > small:
                left[small] += 1
                left -= Counter([best[1], best[0] - best[1]])
        bins += 1
    return bins


def test_best_two_fit_equals_single_pieces():
    random = np.random.default_rng(2)
    for capacity in (10, 64, 100):
        for _ in range(15):
            lengths = random.integers(1, capacity + 1, 60).tolist()
            fillings = packing.best_two_fit(dict(Counter(lengths)), capacity)
            used = Counter()
            for times, items in fillings:
                assert sum(length * n for length, n in items) <= capacity
                used.update({length: n * times for length, n in items})
            assert used == Counter(lengths)
            assert sum(t for t, _ in fillings) == one_by_one(lengths, capacity)


def test_packing(odd, empty):
    pieces = packing.cut_documents(odd, TOKENIZER, 1, 64)
    rows = packing.pack(pieces, 64).orderBy("sequence_id", "offset").collect()
    at = defaultdict(int)
    for row in rows:
        assert row["offset"] == at[row["sequence_id"]] and len(row["ids"]) == 4 * row["length"]
        at[row["sequence_id"]] += row["length"]
    total = sum(len(library_ids(t)) + 1 for _, t, *_ in ODD)
    assert sum(at.values()) == total and max(at.values()) <= 64 and len(at) <= -(-total // 64) + 1
    whole = packing.sequences(packing.pack(pieces, 64)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.pack(packing.cut_documents(empty, TOKENIZER, 1, 64), 64).count() == 0


def test_quality_rules(docs, odd, empty, texts):
    rows = quality_rules.judge(docs, ["doc_id"]).select("_row.doc_id", "*").collect()
    blanks = " \t\n\x0b\x0c\r"
    for row in rows:
        text = texts[row["doc_id"]]
        words = [w for w in "".join(" " if c in blanks else c for c in text).split(" ") if w]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts, covered = Counter(grams), set()
        for i, gram in enumerate(grams):
            if counts[gram] > 1:
                covered.update(range(i, i + 5))
        lines = [line for line in text.split("\n") if line.strip(blanks)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
        assert not (row["kept"] and failed)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0


def test_quality_rules_plan_has_no_python(docs):
    plan = quality_rules.measure(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_classifier_on_held_out_rows(spark, sf_dir, odd, empty):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scored = classifier.score_documents(docs, labels).select("_row.doc_id", "held_out", "score", "predicted")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in scored.collect())
    few = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    result = classifier.score_documents(odd, few).collect()
    assert len(result) == len(ODD) and all(0 <= r["score"] <= 1 for r in result)
    assert {r["score"] for r in classifier.score_documents(odd, few.where("false")).collect()} == {0.5}
    assert classifier.score_documents(empty, few).count() == 0
    assert classifier.keep_positive(odd, few).columns == odd.columns


@pytest.mark.parametrize("limit", [200, 5_000, 1 << 20])
def test_shards_fit_and_are_as_few_as_splitting_allows(docs, texts, limit):
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == len(texts)
    sizes, bits = Counter(), {}
    for row in rows:
        sizes[row["shard"]] += len(texts[row["doc_id"]].encode())
        number = int(hashlib.md5(str(row["doc_id"]).encode()).hexdigest()[:15], 16)
        bits[row["doc_id"]] = f"{number:060b}"
    for row in rows:
        prefix = row["shard"]
        assert len(prefix) == row["depth"] and sizes[prefix] == row["shard_bytes"]
        assert bits[row["doc_id"]].startswith(prefix[:60])
        assert row["shard_bytes"] <= limit or row["shard_rows"] == 1
        if 0 < len(prefix) <= 60:
            parent = sum(len(texts[d].encode()) for d, b in bits.items() if b.startswith(prefix[:-1]))
            assert parent > limit


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.assign_shards(odd, 30).collect()
    assert len(rows) == len(ODD) and all(r["shard_bytes"] <= 30 or r["shard_rows"] == 1 for r in rows)
    assert sharding.assign_shards(empty, 30).count() == 0


def test_written_shards(spark, odd, empty, tmp_path):
    rows = [(None, f"no key {i}", "x" * 50, [i]) for i in range(60)] + [(7, "hot " * 5, "y" * 40, None)] * 90
    rows += [(i, None, "z" * (i % 70), [1, 2]) for i in range(80)] + [(8, "", "", None)] * 200 + [(9, "t", "w" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, numbers array<long>").repartition(5)
    sharding.write_shards(docs, f"{tmp_path}/s", 1000)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert Counter(map(str, back.drop("shard").collect())) == Counter(map(str, docs.collect()))
    sizes = defaultdict(list)
    for r in back.collect():
        plain = len((r["text"] or "") + (r["extra"] or "")) + 8  # the key, and at least these bytes
        sizes[r["shard"]].append(plain)
    assert all(sum(s) <= 1000 or len(s) == 1 for s in sizes.values()) and max(map(len, sizes.values())) <= 100
    assert len({r["shard"] for r in back.where("doc_id = 7").collect()}) > 4
    sharding.write_shards(odd, f"{tmp_path}/o", 30)
    assert spark.read.parquet(f"{tmp_path}/o").count() == len(ODD)
    sharding.write_shards(empty, f"{tmp_path}/e", 30)


def test_sharding_query_counts_all_columns(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text", "repeat('x', 10000) AS extra")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op3_sharding"](spark, str(tmp_path)).collect()
    assert len(rows) == 3000 and len({r["shard"] for r in rows}) > 1
    assert all(r["shard_rows"] * 10000 <= r["shard_bytes"] <= queries.SHARD_BYTES for r in rows)


def test_piece_sampling(odd, empty):
    rows = piece_sampling.sample_pieces(odd, PIECES).collect()
    assert sorted(map(str, (r["decoded"] for r in rows))) == sorted(str(t) for _, t, *_ in ODD)
    again = piece_sampling.sample_pieces(odd.repartition(3), PIECES).collect()
    assert Counter((r["doc_id"], r["ids"]) for r in rows) == Counter((r["doc_id"], r["ids"]) for r in again)
    assert piece_sampling.sample_pieces(empty, PIECES).count() == 0


def test_sampled_shares_match_the_weights():
    vocabulary = piece_sampling.Vocabulary(PIECES, 1.0)

    def ways(rest):
        if not rest:
            yield ()
        for end in range(1, len(rest) + 1):
            piece = vocabulary.of_text.get(rest[:end])
            if piece is not None:
                yield from ((piece, *more) for more in ways(rest[end:]))

    for word in ("there", "ander"):
        all_ways = list(ways(" " + word))
        shares = np.array([math.prod(vocabulary.weight[i] for i in w) for w in all_ways])
        shares /= shares.sum()
        seeds = np.random.default_rng(4).integers(0, 2**62, 20_000)
        drawn = Counter(tuple(ids.tolist()) for ids in piece_sampling.sample([word] * len(seeds), seeds, vocabulary))
        assert set(drawn) <= set(all_ways)
        for way, share in zip(all_ways, shares):
            assert abs(drawn[way] / len(seeds) - share) < 5 * math.sqrt(share / len(seeds)) + 1e-4


def test_line_dedup(docs, odd, empty, texts):
    seen, expected = set(), {}
    for key in sorted(texts):
        kept = []
        for line in texts[key].split("\n"):
            words = " ".join(line.lower().split())
            if len(words.split()) >= 5:
                if words in seen:
                    continue
                seen.add(words)
            kept.append(line)
        expected[key] = "\n".join(kept)
    rows = line_dedup.dedup_lines(docs).collect()
    for row in rows:
        assert row["text"] == expected[row["doc_id"]]
        original = texts[row["doc_id"]]
        assert len(row["removed"]) == row["n_removed"]
        assert all("\n" not in original[s["start"] : s["end"]] for s in row["removed"])
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.dedup_lines(empty).count() == 0


def lines_kept(rows):
    """What line deduplication leaves of (key, text) rows with a key each, without a floor."""
    seen, kept = set(), {}
    for key, text in sorted(rows):
        for line in text.split("\n"):
            words = tuple(line.lower().split())
            if not words or words not in seen:
                kept.setdefault(key, []).append(line)
            seen.add(words)
    return {key: "\n".join(kept.get(key, [])) for key, _ in rows}


def test_line_dedup_without_a_floor(spark, texts):
    short = [(-2, "Home\nAbout us\n\none two three four\nhome"), (-1, "\n \nhome\n  ABOUT   us\nNew\n"), (-3, "new")]
    rows = short + sorted(texts.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_words=1).collect()}
    assert found == lines_kept(rows)
    assert found[-2] == "Home\nAbout us\n\none two three four" and found[-1] == "\n \n"


def removed_by_brute_force(rows):
    """Removed spans of (key, text) rows with a key each: units of passages of 15 words that stand earlier."""
    seen, removed = set(), {}
    for key, text in sorted(rows):
        cuts = sorted({0, len(text), *[k for i, c in enumerate(text) for k in (i, i + 1) if c == "\n"]}
                      | {i + 1 for i, c in enumerate(text) if c in ".!?" and text[i + 1 : i + 2].isspace()}
                      | {i + 1 for i, c in enumerate(text) if c in "。！？"})
        units = [(len(a) - len(a.lstrip()) + s, e, a.lower().split()) for s, e in zip(cuts, cuts[1:]) if (a := text[s:e]).strip()]
        runs = set()
        for i in range(len(units)):
            held = lambda a, b: sum(len(u[2]) for u in units[a:b])
            runs |= {(i, next(j for j in range(i, len(units) + 1) if held(i, j) >= 15))} if held(i, len(units)) >= 15 else set()
            runs |= {(next(j for j in range(i, -1, -1) if held(j, i + 1) >= 15), i + 1)} if held(0, i + 1) >= 15 else set()
        gone = set()
        for i, j in sorted(runs):
            words = tuple(w for u in units[i:j] for w in u[2])
            if words in seen:
                gone |= set(range(i, j))
            seen.add(words)
        removed[key] = [units[k][:2] for k in sorted(gone)]
    return removed


def test_passage_dedup_query(spark, texts, tmp_path):
    long = "This sentence is here to be copied. It has\nsome more words in it! And a few words follow now. Short end."
    rows = [
        (-9, f"Something else first. {long} Own words stay."), (-8, f"Quite another start?\n{long.upper()}\nOther words."),
        (-7, "home\nabout us"), (-6, "home\nabout us"), (-5, "go on now. " * 12), (-4, ""), (-3, "。".join(["一 二 三 四 五"] * 9)),
        *sorted(texts.items()),
    ]
    spark.createDataFrame([*rows, (-2, None), (None, long)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    originals = dict(rows)
    for key, spans in removed_by_brute_force(rows).items():
        row, text = found[key], originals[key]
        # A unit may begin with the blanks of an indented line.
        assert [(s["end"] - len(text[s["start"] : s["end"]].lstrip()), s["end"]) for s in row["removed"]] == spans
        assert row["n_removed"] == len(spans)
        kept, at = [], 0
        for start, end in spans:
            kept, at = [*kept, text[at:start]], end
        assert "".join(row["text"].split()) == "".join("".join([*kept, text[at:]]).split())
    assert found[-8]["text"] == "Quite another start?\nOther words." and found[-6]["text"] == "home\nabout us"
    assert found[-5]["text"] == "go on now. ".strip() and found[-2]["text"] is None
    assert found[None]["text"] == "" and found[None]["n_removed"] == 5


def test_passage_dedup_of_odd_rows(odd, empty):
    rows = line_dedup.dedup_passages(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["text"] for r in rows if r["doc_id"] in (1, 2, 3)} == {None, "", "  \n\t "}
    assert all(r["n_removed"] == 0 for r in rows)
    assert line_dedup.dedup_passages(empty).count() == 0


def brute_spans(data, length):
    places = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if places[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("max_group", [2, 512])
def test_suffix_dedup(docs, texts, max_group):
    keys = sorted(texts)
    expected = dict(zip(keys, brute_spans([texts[k].encode() for k in keys], 200)))
    for row in suffix_dedup.dedup_substrings(docs, ["doc_id"], max_group=max_group).collect():
        gone = expected[row["row"]["doc_id"]]
        assert row["kept"] == bytes(np.frombuffer(row["bytes"], "u1")[~gone])
        marked = np.zeros(len(gone), bool)
        for span in row["removed"]:
            marked[span["start"] : span["end"]] = True
        assert (marked == gone).all()


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_on_repetitive_bytes(spark, seed):
    random = np.random.default_rng(seed)
    parts = ["".join(random.choice(list("abé"), n)) for n in (5, 9, 17, 30)] + ["a", "ab" * 8]
    rows = [(i, "".join(random.choice(parts, random.integers(0, 12)))) for i in range(40)]
    rows += [(90, None), (91, ""), (None, rows[3][1]), (3, rows[3][1]), (92, "a" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.dedup_substrings(docs, ["doc_id"], length=20, gram=7, max_group=3).collect()
    assert len(found) == len(rows)
    data = [bytes(r["bytes"]) for r in found]
    for row, gone in zip(found, brute_spans(data, 20)):
        assert row["kept"] == bytes(np.frombuffer(bytes(row["bytes"]), "u1")[~gone])
    cut = suffix_dedup.without_repeats(docs, length=20, gram=7)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_suffix_sort_orders_by_bytes():
    random = np.random.default_rng(5)
    rows = [bytes(random.choice(list(b"ab"), random.integers(0, 12)).tolist()) for _ in range(200)]
    group = np.sort(random.integers(0, 7, 200))
    starts = np.searchsorted(group, group)
    sizes = np.bincount(group)[group]
    order, common = suffix_dedup._ranks(rows, 12, group, starts, sizes)
    assert [(group[i], rows[i]) for i in order] == sorted((g, r) for g, r in zip(group, rows))


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.dedup_substrings(empty, ["doc_id"]).count() == 0


def test_near_duplicates(docs, texts, odd, empty):
    sets = {}
    for key, text in texts.items():
        words = text.split()
        if words:
            sets[key] = Counter(zip(*[words[i:] for i in range(min(5, len(words)))]))
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = sets[a], sets[b]
            common = x.keys() & y.keys()
            if len(common) * 2 < min(len(x), len(y)):
                continue
            alike = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in common)
            if alike >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {k: root(k) for k in texts}
    found = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 2), (3, 3), (6, 6), (7, 6), (None, None)} <= found
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(odd).columns == odd.columns


def test_near_duplicates_by_row(spark):
    random = np.random.default_rng(8)
    a, b, c, d, e, f = (" ".join(f"w{w}" for w in random.integers(0, 10**6, 120)) for _ in range(6))
    near = lambda t, word: " ".join([*t.split()[:-1], word])
    rows = [
        (1, a, "x"), (2, near(a, "y"), "x"), (2, b, "unique text under the key of a near copy"),
        (3, c, "x"), (3, c, "the same row again"), (3, c, "and again"),
        (None, d, "x"), (None, d, "a copy without a key"), (None, near(d, "z"), "a near copy without a key"),
        (None, near(c, "q"), "x"), (9, e, "x"), (9, f, "x"), (10, near(e, "r"), "x"), (10, near(f, "s"), "x"),
        (11, None, "x"), (12, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    groups = [{a, rows[1][1]}, {b}, {c, rows[9][1]}, {d, rows[8][1]}, {e, rows[12][1]}, {f, rows[13][1]}, {None}, {" "}]
    kept = near_dedup.keep_first(docs).collect()
    assert sorted(min(i for i, g in enumerate(groups) if r["text"] in g) for r in kept) == list(range(8))
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 3, None, 9, 9, 11, 12])
    assert {r["text"] for r in kept if r["doc_id"]} == {a, b, c, e, f, None, " "}
    classes = near_dedup.near_duplicates(docs).collect()
    assert len(classes) == len(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in classes) == Counter(
        [(1, 1), (2, 1), (2, 2), *[(3, 3)] * 3, *[(None, None)] * 3, (None, 3), (9, 9), (9, 9), (10, 9), (10, 9), (11, 11), (12, 12)]
    )
    assert len({(r["class_id"], r["class_hash"]) for r in classes}) == 8


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_in_a_group_below_the_threshold(spark, monkeypatch, block):
    """Many texts alike at about 0.71, a few of them with partners above 0.8: only those are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random = np.random.default_rng(3)
    base, fresh = [f"w{w}" for w in random.integers(0, 10**6, 300)], iter(range(10**6))

    def changed(words: list[str], n: int) -> list[str]:
        own = list(words)
        for at in random.choice(len(own), n, replace=False):
            own[at] = f"fresh{next(fresh)}"
        return own

    texts = [changed(base, 10) for _ in range(60)]
    for k in (0, 0, 5, 60, 61, 7):
        texts.append(changed(texts[k], 2))
    sets = [near_dedup.shingles(t) for t in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if near_dedup.similarity(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 40 < len(set(label)) < len(texts)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == dict(enumerate(label))


def test_near_duplicates_keep_little_on_disk(spark):
    """A text's registers take a byte each, and tables that the result does not read are deleted before it is read."""
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in random.integers(0, 10**6, 120)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with common.recording() as folders:
        found = near_dedup.near_duplicates(docs)
    left = [spark.read.parquet(f) for f in folders if os.path.isdir(f)]
    assert len(left) == 5 < len(folders)  # numbered rows, signed texts, firsts, labels and places
    signed = next(t for t in left if "registers" in t.columns)
    sizes = [sum(len(v) * 8 if isinstance(v, list) else len(v) for v in r if hasattr(v, "__len__")) for r in signed.collect()]
    assert set(sizes) == {16 + near_dedup.REGISTERS}
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {k: texts.index(t.removesuffix(" more")) for k, t in enumerate(texts)}


def test_only_rows_with_a_candidate_get_their_texts():
    random = np.random.default_rng(7)
    registers = random.integers(0, 256, (6, near_dedup.REGISTERS)).astype("u1")
    registers[3] = registers[0]  # alike, but of one component
    registers[5], registers[5, -4:] = registers[1], 0  # alike, of two components, and together in the first band
    registers[4], registers[4, :5] = registers[2], 1  # alike, of two components, but not together in the first band
    labels = [10, 11, 12, 10, 14, 15]
    ones = pa.array([0] * 6, pa.int32())
    cell = pa.RecordBatch.from_arrays(
        [pa.array([9] * 6), ones, ones, ones, ones, pa.array(range(6)), pa.array(labels), pa.array([r.tobytes() for r in registers])],
        names=["cell", "number", "i", "j", "side", "node", "label", "registers"],
    )
    assert [r["node"] for b in near_dedup._likely()(iter([cell])) for r in b.to_pylist()] == [1, 5]


def test_keep_first_passes_any_columns_on(spark):
    names = ["doc_id", "text", "_row", "row", "doc", "_bucket", "a.b", "with blank", "back`tick"]
    rows = [(k, "one two three four five six" if k < 2 else None, 70 + k, 1, "x", 2, 3, 4, 5) for k in range(3)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'string' if n in ('text', 'doc') else 'long'}" for n in names))
    kept = near_dedup.keep_first(docs)
    assert kept.columns == names
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_signature_estimates_probability_jaccard():
    random = np.random.default_rng(6)
    a = np.unique(random.integers(0, 2**62, 300).astype("u8"))
    b = np.unique(np.concatenate([a[:270], random.integers(0, 2**62, 30).astype("u8")]))
    wa, wb = random.integers(1, 4, len(a)), random.integers(1, 4, len(b))
    exact = near_dedup.similarity((a, wa), (b, wb))
    agree = (near_dedup.signature(a, wa) == near_dedup.signature(b, wb)).mean()
    assert abs(agree - exact) < 4.5 * math.sqrt(exact * (1 - exact) / near_dedup.REGISTERS)
    for n in (1, 2, 5):
        assert len(near_dedup.signature(a[:n], wa[:n])) == near_dedup.REGISTERS


def test_nearest(spark):
    random = np.random.default_rng(7)
    x = random.normal(size=(2500, 16)).astype("f4")
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] * 8), (9005, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in nearest.nearest(table, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2500, 50):
        scores = unit @ unit[q]
        scores[q] = -9
        best = np.lexsort((np.arange(2500), -np.round(scores, 12)))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in found[q]})
        assert len(found[q]) == 5 and all(abs(s - scores[v]) < 1e-12 for v, s in found[q])
    assert [v for v, _ in found[100]] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 250
    few = nearest.nearest(table.where("vec_id < 3"), F.col("id") % 50 == 0).collect()
    assert [r["query_id"] for r in few] == [0, 0]
    assert nearest.nearest(table.where("false"), F.col("id") % 50 == 0).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_units_end_as_before_and_are_found_by_one_set_of_characters():
    import re

    from embedspark.llm import line_dedup

    slow = re.compile(r"\n|(?<=[.!?])[^\S\n]+|(?<=[。！？])")
    text = "One. Two!? 3.14 x.\n\nA。。B！\nlast . \t end.\r\n . "
    spans = [m.span() for m in slow.finditer(text)] + [(len(text), len(text))]
    want = [(a, b) for a, (b, _) in zip([0, *[after for _, after in spans[:-1]]], spans) if text[a:b].strip()]
    assert line_dedup.sentence_units(text) == want
    assert line_dedup._UNIT_END.pattern.startswith("[")


def test_pieces_are_found_by_table_and_by_search(monkeypatch):
    from embedspark.llm.piece_sampling import Vocabulary

    v = object.__new__(Vocabulary)
    v.of_text = {text: i for i, text in enumerate(["a", "ab", "abc", "b", " a", "日本"])}
    v._index()
    for same_slot in (False, True):
        if same_slot:
            v._table[:] = -2
        node = v.step(np.zeros(5, "i8"), np.array([ord(c) for c in "ab 日x"], "i8"))
        assert v.piece_at[node].tolist() == [0, 3, -1, -1, -1] and node[4] == 0 and (node[:4] > 0).all()
        assert v.piece_at[v.step(node[:1], np.array([ord("b")], "i8"))].tolist() == [1]
