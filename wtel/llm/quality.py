"""Quality rules: hashed n-gram log-likelihood ratio between trusted text and the whole corpus.

DataFrame functions only. The words of a text and their two-word sequences are hashed to a fixed
number of buckets. Counting a bucket over the trusted documents and over all documents gives two
multinomials; the mean over a text's n-grams of the log ratio of its bucket is the score.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.functions.once import with_once
from wtel.llm.common import SPACES, join_small, staged

BUCKETS = 1 << 16
#: Added to a bucket's trusted count and to the count expected of it: rare buckets say little.
SMOOTHING = 50.0
#: Mean log ratio (nats per n-gram) from which a text is kept.
THRESHOLD = -0.06
#: Characters that tables and markup are full of.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

def _replaced(text: Column, characters: str, to: str) -> Column:
    return reduce(lambda done, c: F.replace(done, F.lit(c), F.lit(to)), characters, text)


def words_of(text: Column) -> Column:
    """All words of a text in order; none for null or blank.

    Cutting at one literal character is several times faster than at a pattern.
    """
    plain = _replaced(F.coalesce(text, F.lit("")), SPACES[1:], " ")
    return F.array_remove(F.split(plain, " "), "")


def _bucket(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, corpus (n-grams of all documents), target (of the trusted ones).

    ``trusted`` holds the ids of trusted documents. Each task counts its own buckets before the
    shuffle, so at most tasks x buckets rows move, whatever words are frequent.
    """
    marked = join_small(
        docs.select("doc_id", "text"), trusted.select("doc_id").distinct().withColumn("_trusted", F.lit(1)), "doc_id"
    )
    words = with_once(marked.select("_trusted", "text"), {"words": words_of(F.col("text"))}).drop("text")
    after = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    pairs = words.select("_trusted", F.inline(F.arrays_zip(F.col("words").alias("w"), after.alias("v"))).alias("w", "v"))
    grams = pairs.select(
        "_trusted",
        F.explode(
            F.array(
                _bucket(F.xxhash64("w")),
                F.when(F.col("v").isNotNull(), _bucket(F.xxhash64("w", "v"))),
            )
        ).alias("bucket"),
    )
    return (
        grams.where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("corpus"), F.count("_trusted").alias("target"))
    )


def weights(counts: DataFrame) -> list[float]:
    """Log ratio of each bucket, trusted to expected; ``BUCKETS`` numbers at most reach the driver.

    A bucket is expected to have the share of the trusted n-grams that it has of the corpus. Without
    trusted text every weight is 0, and so is every score.
    """
    found = {r["bucket"]: (r["corpus"], r["target"]) for r in counts.collect()}
    corpus, target = (sum(x[i] for x in found.values()) for i in (0, 1))
    out = []
    for bucket in range(BUCKETS):
        c, t = found.get(bucket, (0, 0))
        expected = target * (c + 1) / (corpus + BUCKETS)
        out.append(log((t + SMOOTHING) / (expected + SMOOTHING)))
    return out


def scored(docs: DataFrame, weight: list[float], *carried: str) -> DataFrame:
    """The carried columns, the base columns and ``score`` of each text: its mean n-gram weight.

    A text without words scores 0.
    """
    # one folded literal: the optimizer turns the text into an array once
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weight)), ",").cast("array<double>")
    body, words = F.coalesce("text", F.lit("")), F.col("words")
    df = with_once(docs.select(*carried, "text"), {"words": words_of(F.col("text"))})

    def weighed(word: Column, i: Column) -> Column:
        after = F.get(words, i + 1)
        pair = F.when(after.isNull(), F.lit(0.0)).otherwise(F.get(table, _bucket(F.xxhash64(word, after))))
        return F.get(table, _bucket(F.xxhash64(word))) + pair

    df = with_once(
        df,
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(_replaced(body, SYMBOLS, ""))).cast("long"),
            "_lines": F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
            "_sum": F.aggregate(F.transform(words, weighed), F.lit(0.0), lambda a, w: a + w),
            "_bits": F.length(F.bin(F.size(words).cast("long"))),
        },
    ).drop("text")
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return _with_repeats(df).select(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("_sum") / n_grams).alias("score"),
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: the words in three-word windows that ``words`` holds twice or more.

    Windows are sorted as plain numbers whose lowest ``_bits`` bits are the position, so that
    equal ones are neighbours; the few that look equal are compared by the whole hash.
    """
    words, bits = F.col("words"), F.col("_bits")
    high = lambda x: F.call_function("shiftright", x, bits)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def neighbours(s: Column, key) -> Column:
        return F.filter(s, lambda e, k: (key(e) == key(F.get(s, k + 1))) | (key(e) == key(F.get(s, k - 1))))

    packed = F.transform(
        words, lambda _, i: F.call_function("shiftleft", high(window(i)), bits).bitwiseOR(i.cast("long"))
    )
    count = F.greatest(F.size(words) - 2, F.lit(0))
    df = with_once(df, {"_s": F.sort_array(F.slice(packed, F.lit(1), count))})
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    like = F.transform(neighbours(F.col("_s"), high), lambda x: x.bitwiseAND(low).cast("int"))
    df = with_once(df, {"_like": like}).drop("_s")
    full = F.sort_array(F.transform("_like", lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    df = with_once(df, {"_s": full}).drop("_like", "words")
    same = F.transform(neighbours(F.col("_s"), lambda e: e["w"]), lambda e: e["i"])
    df = with_once(df, {"_at": same}).drop("_s")
    covered = F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that a label marks as good; null ids and labels count for nothing."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, score, base_failed and kept of every document.

    ``base_failed``: fewer than 50 words, or more than half of the words in three-word windows that
    the text repeats. ``kept``: not failed, and score >= ``threshold``.

    A null, empty or blank text has no words and fails. Null labels mark nothing; without trusted
    documents every score is 0. Repeated rows are judged alike and all stay; null ids are kept.
    Only doc_id and text are read, so other columns cannot clash. Texts of any length are taken
    whole. An empty table gives an empty result.
    """
    return _judged(docs, docs.select("doc_id", "text"), labels, threshold, "doc_id")


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that ``judge`` keeps, all columns and repeated rows as they are.

    Null, empty and blank texts go; null ids stay with their rows; columns beside doc_id and text are passed on whatever their
    names; texts of any length are read whole, equal scores are judged alike, and an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return _judged(docs, rows, labels, threshold, "_row").where("kept").select("_row.*")


def _judged(docs: DataFrame, rows: DataFrame, labels: DataFrame, threshold: float, carried: str) -> DataFrame:
    counts = bucket_counts(docs, staged(trusted_ids(labels), "trusted"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        scored(rows, weights(counts), carried)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
