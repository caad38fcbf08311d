"""Quality rules by divergence from language references, in SQL functions only.

A text's characters (upper-case letters, other letters, digits, symbols, the rest) and its most common
words are counted and compared, by Jensen-Shannon distance, with the shares of all texts of its
language. Texts too short for a fair comparison pass a test. Before that come base rules: too few
words, or too large a share of words in repeated five-word windows.

Null texts have no words and fail. Languages without a word list (and null) share one character
reference and skip the word test. A language with no text long enough for a reference has none and
its texts pass. Rows are judged one by one, so ties and repeated rows all get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embedspark.llm.common import written


SYMBOLS = "#*$%&|<>"
#: Frequent words of each language, whose histogram is compared.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words a text must have before its character and word histograms are judged.
MIN_CLASS_WORDS = 20
MIN_COMMON_WORDS = 60
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the reference: a limit for endless texts and
#: an allowance that is divided by the root of the number of words, as sampling noise is.
MAX_CLASS_DISTANCE = (0.2, 1.0)
MAX_WORD_DISTANCE = (0.22, 0.9)
_SPACE = "\\x20\\x09-\\x0D"
_CLASSES = 4


def _kept_chars(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def measure(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The kept columns as ``_row``, the base measures and the histograms ``_classes`` and ``_common``."""
    languages = list(COMMON_WORDS)
    own = F.when(F.col(lang).isin(languages), F.col(lang)).otherwise("other")
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    out = docs.select(row.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), own.alias("_lang"))
    # Blank and line feed alone, the usual case, need no regular expression.
    plain = F.split(F.replace("_text", F.lit("\n"), F.lit(" ")), " ")
    pieces = F.when(F.col("_text").rlike("[\\x09\\x0B-\\x0D]"), F.split("_text", f"[{_SPACE}]+")).otherwise(plain)
    out = out.withColumn("_words", F.array_remove(pieces, ""))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    out = out.withColumns(
        {
            "_listed": F.filter("_words", lambda w: w.isin(every)),
            "_upper": _kept_chars(F.col("_text"), "\\p{Lu}"),
            "_letters": _kept_chars(F.col("_text"), "\\p{L}"),
            "_symbols": _kept_chars(F.col("_text"), SYMBOLS),
            "_n": F.size("_words").cast("bigint"),
            "_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{_SPACE}]")),
        }
    )
    common = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for name in languages:
        words = F.array(*[F.lit(w) for w in COMMON_WORDS[name]])
        times = F.transform(words, lambda w: F.size(F.filter("_listed", lambda x: x == w)).cast("bigint"))
        common = common.when(F.col("_lang") == name, times)
    rest = F.col("_chars") - F.col("_letters") - F.col("_symbols")
    classes = F.array(F.col("_upper"), F.col("_letters") - F.col("_upper"), F.col("_symbols"), rest)
    out = out.withColumns({"_common": common.otherwise(F.array().cast("array<bigint>")), "_classes": classes})
    return _repeats(out).select(
        "_row",
        "_lang",
        "_classes",
        "_common",
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeat_words").alias("n_repeat_words"),
    )


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Character and word shares of each language over all texts that are long enough.

    One row per word list, and one for all other languages, reaches the driver.
    """
    width = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum("n_words").alias("n"), *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(_CLASSES)]]
    sums += [F.sum(F.coalesce(F.get("_common", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(width)]
    found = {}
    for row in measured.where(F.col("n_words") >= MIN_CLASS_WORDS).groupBy("_lang").agg(*sums).collect():
        words = [row[f"w{i}"] for i in range(len(COMMON_WORDS.get(row["_lang"], [])))]
        words.append(row["n"] - sum(words))
        classes = [row[f"c{i}"] for i in range(_CLASSES)]
        found[row["_lang"]] = tuple([v / max(1, sum(part)) for v in part] for part in (classes, words))
    return found


def _distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts from shares; null without shares."""

    def terms(count: Column, share: Column) -> Column:
        p = count / total
        middle = (p + share) / 2
        own = F.when(count > 0, p * F.log2(p / middle)).otherwise(F.lit(0.0))
        return own + F.when(share > 0, share * F.log2(share / middle)).otherwise(F.lit(0.0))

    sum_ = F.aggregate(F.zip_with(counts, shares, terms), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), sum_ / 2))


def distances(measured: DataFrame) -> DataFrame:
    """Adds class_distance and word_distance; null where the text is too short or nothing to compare with."""
    known = references(measured)

    def of_language(part: int) -> Column:
        case = F.when(F.lit(False), F.array().cast("array<double>"))
        for name, shares in known.items():
            case = case.when(F.col("_lang") == name, F.array(*[F.lit(float(v)) for v in shares[part]]))
        return case

    n = F.col("n_words")
    words = F.concat("_common", F.array(n - _total(F.col("_common"))))
    listed = F.col("_lang").isin(list(COMMON_WORDS)) & (n >= MIN_COMMON_WORDS)
    by_class = _distance(F.col("_classes"), F.col("word_chars"), of_language(0))
    return measured.withColumns(
        {
            "class_distance": F.when(n >= MIN_CLASS_WORDS, F.round(by_class, 9)),
            "word_distance": F.when(listed, F.round(_distance(words, n, of_language(1)), 9)),
        }
    )


def _repeats(split: DataFrame) -> DataFrame:
    """Adds _repeat_words: words inside five-word windows that a text has twice or more.

    Hashes of the windows tell the many texts without repeats; the others compare the windows.
    """
    hashes = F.transform("_words", lambda w, i: F.xxhash64(F.slice("_words", i + 1, F.lit(5))))
    windows = F.greatest(F.size("_words") - 4, F.lit(0))
    out = split.withColumn("_hashes", F.slice(hashes, F.lit(1), windows))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    texts = F.transform(
        "_hashes", lambda h, i: F.struct(F.array_join(F.slice("_words", i + 1, F.lit(5)), " ").alias("w"), i.alias("i"))
    )
    empty = F.array().cast("array<struct<w:string,i:int>>")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(texts)).otherwise(empty))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["w"] == x["w"], F.lit(False))
    again = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("_at", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - i, F.lit(5))))
    return out.withColumn("_repeat_words", _total(F.transform(covered, lambda x: x.cast("bigint"))))


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """_row (the columns to keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    The texts are read once: rows and measures are written to the shared folder, and the references
    and verdicts come from there.
    """
    found = distances(written(measure(docs, keep, text, lang)))
    n = F.col("n_words")
    beyond = [
        F.coalesce(F.col(name) > limit + noise / F.sqrt(n), F.lit(False))
        for name, (limit, noise) in (("class_distance", MAX_CLASS_DISTANCE), ("word_distance", MAX_WORD_DISTANCE))
    ]
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    names = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*names, failed.alias("base_failed"), (~(failed | beyond[0] | beyond[1])).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return judge(docs, docs.columns, text, lang).where("kept").select("_row.*")
