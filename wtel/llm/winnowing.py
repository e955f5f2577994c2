"""Benchmark decontamination by winnowing, with DataFrame functions only.

The least of the six hashes of five words in ten words in a row is a fingerprint of these ten. Texts that share
ten words share it, so fingerprints of texts and items are joined first; each one found is extended to the ten
words around it, which are compared with the items' windows word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.functions.once import with_once
from wtel.llm.common import ascii_lowered, fits, join_small, staged

#: What lies between words: ASCII that is neither a letter nor a digit.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of a hash of which the least is kept.
WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    """All words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lowered(text), BETWEEN), "")


def windows_of(df: DataFrame, window: int) -> DataFrame:
    """A row for each word of the column ``words``: its position, and the ``print`` of the window that it starts.

    Any ``window`` words hold window - 4 hashes of five words, the least of which is the print; shorter windows,
    of items with fewer words, have the hash of all their words. The print is null where too few words are left;
    a row without words has one row without position. The arithmetic is compiled; no array is made per word.
    """
    df = with_once(df, {"_h": F.transform("words", lambda w: F.xxhash64(w))})
    rows = df.select("*", F.posexplode_outer("_h").alias("start", "_0"))
    at = [F.col("_0"), *(F.get("_h", F.col("start") + k) for k in range(1, window))]
    gram = GRAM if window >= WINDOW else window
    grams = [F.xxhash64(*at[k : k + gram]) for k in range(window - gram + 1)]
    least = F.least(*grams) if len(grams) > 1 else grams[0]
    return rows.withColumn("print", F.when(at[-1].isNotNull(), least)).drop("_h", "_0")


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct windows (n, wh, window, set_id) of the items, names (set_id, names), and fingerprints (n, print).

    ``n`` is the number of words: ``window``, or all of a shorter item. ``names`` are the ids, as text, of the
    items that hold the window; windows of the same items share a ``set_id``.
    """
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name")
    words = with_once(items.select(name, "text"), {"words": words_of(F.col("text"))}).drop("text")
    words = staged(words.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window))), "items")
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("start")
    each = words.select("name", "n", "words", starts).select("name", "n", F.slice("words", F.col("start"), F.col("n")).alias("window"))
    held = each.groupBy("n", "window").agg(F.array_sort(F.collect_set("name")).alias("names"))
    held = held.select("n", F.xxhash64("window").alias("wh"), "window", F.md5(F.to_json("names")).alias("set_id"), "names")
    held = staged(held, "windows")
    names = staged(held.select("set_id", "names").dropDuplicates(["set_id"]), "names")
    prints = words.select(F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("print")).limit(0)
    for n in lengths_of(held):
        own = windows_of(words.where(F.col("n") == n).select("words"), n)
        prints = prints.unionByName(own.where("print is not null").select(F.lit(n).alias("n"), "print"))
    return held.drop("names"), names, staged(prints.distinct(), "prints")


def lengths_of(rows: DataFrame) -> list[int]:
    """The lengths of windows that occur, at most ``WINDOW`` numbers."""
    return sorted(r.n for r in rows.select("n").distinct().collect())


def _found(words: DataFrame, n: int, prints: DataFrame) -> DataFrame:
    """digest, n, start, own: the windows of ``n`` words whose print an item has, with their words."""
    own = F.slice("words", F.col("start") + 1, F.lit(n)).alias("own")
    if fits(prints):
        each = windows_of(words.select("digest", "words"), n)
        found = each.join(F.broadcast(prints), "print", "left_semi")
        return found.select("digest", F.lit(n).alias("n"), "start", own)
    # many items: only numbers are shuffled, and the words are cut again for the texts that have a print
    each = windows_of(words.select("digest", "words"), n).select("digest", "start", "print")
    starts = each.join(prints.hint("merge"), "print", "left_semi").distinct().groupBy("digest")
    starts = staged(starts.agg(F.collect_list("start").alias("starts")), "starts")
    texts = words.select("digest", "words").join(starts, "digest").dropDuplicates(["digest"])
    return texts.select("digest", "words", F.explode("starts").alias("start")).select("digest", F.lit(n).alias("n"), "start", own)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans and items of every document.

    A window is ``window`` words in a row of an item's text, or all words of a shorter one. A word of a document
    is hit if it lies in some occurrence of a window. ``spans`` are the runs of hit words (first, end
    exclusive, counted in words), ``items`` the sorted ids, as text, of the items that have an occurring window.

    A null or empty text has no words and is never hit; an item without words has no windows. Items
    that repeat an id are one item; a null id counts as one with an empty name. Texts of any length
    are taken whole. Rows that repeat give equal rows, and null doc_ids stay. Only doc_id, item_id and text are read,
    so other columns cannot clash. An empty table of items hits nothing, one of documents gives an empty result.

    Work goes by distinct text (its digest), so copies are extended once.
    """
    windows, names, prints = item_windows(items, window)
    key = F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    words = with_once(docs.select("doc_id", key, "text"), {"words": words_of(F.col("text"))}).drop("text")
    counted = words.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "words")
    main = prints.where(F.col("n") == window).select("print")
    if fits(main):
        # one pass over the texts gives their sizes, on the first word's row, and the windows found
        each = windows_of(counted, window).join(F.broadcast(main.withColumn("_in", F.lit(True))), "print", "left")
        first = F.coalesce(F.col("start") == 0, F.lit(True))
        own = F.when(F.col("_in"), F.slice("words", F.col("start") + 1, F.lit(window)))
        each = each.where(first | F.col("_in")).select("doc_id", "digest", "n_words", first.alias("_first"), "start", own.alias("own"))
        each = staged(each, "seen")
        seen = each.where("_first").select("doc_id", "digest", "n_words")
        found = each.where("own is not null").select("digest", F.lit(window).alias("n"), "start", "own")
    else:
        seen = staged(counted.drop("words"), "seen")
        found = _found(words, window, main)
    for n in lengths_of(prints):
        if n < window:
            found = found.unionByName(_found(words, n, prints.where(F.col("n") == n).select("print")))
    found = found.withColumn("wh", F.xxhash64("own"))
    found = join_small(found, windows, ["n", "wh"], "inner").where("own = window")
    hits = staged(found.select("digest", "start", "n", "set_id").distinct(), "hits")

    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    at = F.col("_at")
    firsts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    ends = F.transform(F.filter(at, lambda p, i: ~F.get(at, i + 1).eqNullSafe(p + 1)), lambda p: p + 1)
    spans = hits.groupBy("digest").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    spans = with_once(spans, {"_at": covered}).select(
        "digest", F.size("_at").cast("long").alias("n_hit"), F.arrays_zip(firsts.alias("first"), ends.alias("end")).alias("spans")
    )
    of_items = join_small(hits.select("digest", "set_id").distinct(), names, "set_id", "inner")
    of_items = of_items.select("digest", F.explode("names").alias("name"))
    of_items = of_items.groupBy("digest").agg(F.array_sort(F.collect_set("name")).alias("items"))
    found = staged(spans.join(of_items, "digest"), "contaminated")
    out = join_small(seen.select("doc_id", "digest", "n_words"), found, "digest")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
