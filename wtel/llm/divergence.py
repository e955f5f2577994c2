"""How much the sources of a language differ in their words: run-length columns of term counts.

Terms of a language whose counts agree in every source are put next to each other. Each source's
column of counts is then a few runs; two columns are compared on the pieces between their joint
boundaries, each piece's difference times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wtel.llm.common import byte_table, coded_words, join_small, row_of, runs, slices, staged, word_lists

#: Terms are runs of letters and all characters beyond ASCII.
TERM_BYTES = byte_table("abcdefghijklmnopqrstuvwxyz")
#: Documents of a language that a kept term is in, what is added to a count, terms listed of a source.
MIN_DOCS, ADDED, LISTED = 30, 5, 50
#: Distinct count vectors of a block of the vocabulary, and sources of a strip that meet in one task.
BLOCK, STRIP = 4096, 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents).

    Words are counted by arrays for a few megabytes of text at a time; every task sums its own counts before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, offsets = coded_words(word_lists(part.column("text"), TERM_BYTES))
                names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
                lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
                pairs, group = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
                size = max(len(words), 1)
                row = row_of(offsets)
                keys, n = np.unique(group[row] * size + codes, return_counts=True)
                in_docs = np.unique(row * size + codes)
                d = np.unique(group[in_docs // size] * size + in_docs % size, return_counts=True)[1]
                at = pairs[keys // size]
                yield pa.RecordBatch.from_arrays(
                    [
                        names[0].dictionary.take(pa.array(at // len(names[1].dictionary))),
                        names[1].dictionary.take(pa.array(at % len(names[1].dictionary))),
                        words.take(pa.array(keys % size)).cast(pa.string()),
                        pa.array(n),
                        pa.array(d),
                    ],
                    ["lang", "source", "term", "n", "d"],
                )

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    counts = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), by long division in three steps of 1000.

    Exact in 64 bits while a language has fewer than 9 * 10^15 occurrences.
    """
    whole = total + ADDED * terms
    rest, out = count + ADDED, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return out + 1


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts."""
    whole = total + ADDED * terms
    rest, out = counts.astype(np.int64) + ADDED, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def _tables(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, total, vector of g and n) and groups (lang, source, g, sources, n, terms, total)."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    numbered = named.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("all"))
    numbered = numbered.select("lang", F.size("all").alias("sources"), F.posexplode("all").alias("g", "source"))
    numbered = staged(numbered, "numbered")
    counts = join_small(term_counts(docs), numbered.select("lang", "source", "g"), ["lang", "source"], "inner")
    terms = counts.groupBy("lang", "term").agg(
        F.sum("d").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("g", "n"))).alias("vector")
    )
    terms = staged(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total"))
    of_group = terms.select("lang", F.inline("vector")).groupBy("lang", "g").agg(F.sum("n").alias("own"))
    groups = numbered.join(of_group, ["lang", "g"], "left").join(of_lang, "lang", "left")
    return terms, staged(groups.na.fill(0, ["own", "terms", "total"]), "groups")


def run_columns(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, block, g, ends, counts: each source's column of each block as runs, zeros included.

    ``vectors`` has lang, sources, vector and len, the number of terms with that vector. Sorted by
    vector, they are cut into blocks of ``block``. ``ends`` counts terms from the block's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId() << 32, 0
        for of_lang in runs(batches, ["lang"]):
            for start in range(0, of_lang.num_rows, block):
                part = of_lang.slice(start, block)
                ends = np.cumsum(part.column("len").to_numpy())
                vector = part.column("vector")
                offsets = vector.offsets.to_numpy()
                entries = vector.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                g, n = (entries.field(f).to_numpy() for f in ("g", "n"))
                order = np.argsort(g, kind="stable")
                cuts = np.searchsorted(g[order], np.arange(part.column("sources")[0].as_py() + 1))
                out_ends, out_counts = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    column = np.zeros(part.num_rows, np.int64)
                    column[row[order[a:b]]] = n[order[a:b]]
                    last = np.append(column[1:] != column[:-1], True)
                    out_ends.append(ends[last])
                    out_counts.append(column[last])
                size = len(out_ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("lang")[0].as_py()] * size),
                        pa.array([task + k] * size, pa.int64()),
                        pa.array(np.arange(size), pa.int32()),
                        pa.array(out_ends, pa.list_(pa.int64())),
                        pa.array(out_counts, pa.list_(pa.int64())),
                    ],
                    ["lang", "block", "g", "ends", "counts"],
                )
                k += 1

    rows = vectors.repartitionByRange("lang", "vector").sortWithinPartitions("lang", "vector")
    return rows.mapInArrow(run, "lang string, block long, g int, ends array<long>, counts array<long>")


def difference(ends: tuple[np.ndarray, np.ndarray], values: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over all terms of the difference of two columns, from their runs."""
    joint = np.union1d(*ends)
    a, b = (v[np.searchsorted(e, joint)] for e, v in zip(ends, values, strict=True))
    return int((np.abs(a - b) * np.diff(joint, prepend=0)).sum())


def pair_sums(columns: DataFrame, groups: DataFrame, strip: int = STRIP) -> DataFrame:
    """lang, a, b, value for the pairs a < b of sources of a language: the sums over its blocks.

    Strips of ``strip`` sources meet two at a time, so a task holds two strips of one block, whatever
    the number of sources.
    """
    rows = join_small(columns, groups.select("lang", "g", "sources", "own", "terms"), ["lang", "g"], "inner")
    own = F.floor(F.col("g") / strip).cast("int")
    strips = F.ceil(F.col("sources") / strip).cast("int")
    others = F.transform(F.sequence(F.lit(0), strips - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    keys = ["lang", "block", "i", "j"]
    tasks = rows.select("lang", "block", "g", "own", "terms", "ends", "counts", F.inline(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
            g = group.column("g").to_numpy()
            ends = [x.values.to_numpy() for x in group.column("ends")]
            own, terms = (group.column(c).to_numpy() for c in ("own", "terms"))
            values = [shares(x.values.to_numpy(), own[k], terms[k]) for k, x in enumerate(group.column("counts"))]
            found = [
                (int(g[x]), int(g[y]), difference((ends[x], ends[y]), (values[x], values[y])))
                for x in range(len(g))
                for y in range(len(g))
                if g[x] < g[y] and (i == j or (g[x] // strip == i and g[y] // strip == j))
            ]
            a, b, value = (np.array(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            lang = pa.array([group.column("lang")[0].as_py()] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays(
                [lang, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"]
            )

    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys, "g")
    sums = dealt.mapInArrow(run, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, listed: int = LISTED, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and by which terms.

    Null text, lang and source count as empty, and an empty lang or source is one like any other. Part
    ``pair`` lists every other source of the language by the sum, over the terms in at least ``min_docs``
    documents of the language, of the difference of their shares; 0 where no term is kept. Part ``term`` lists
    the terms that a source holds a larger share of than its language does, ``listed`` at most. Equal values are
    ordered by item. Rows that repeat count as often as they occur. Texts are read whole; other
    columns cannot clash, and an empty table gives an empty result.
    """
    terms, groups = _tables(docs, min_docs)
    vectors = staged(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("len")), "vectors")
    vectors = join_small(vectors, staged(groups.select("lang", "sources").distinct(), "langs"), "lang", "inner")
    columns = staged(run_columns(vectors, block), "columns")
    sums = staged(pair_sums(columns, groups, strip), "sums")

    others = groups.select("lang", "source", "g", F.explode(F.sequence(F.lit(0), F.col("sources") - 1)).alias("h")).where("g <> h")
    others = others.withColumns({"a": F.least("g", "h"), "b": F.greatest("g", "h")})
    pairs = join_small(others, sums, ["lang", "a", "b"])
    pairs = join_small(pairs, groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"], "inner")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    held = terms.select("lang", "term", F.col("total").alias("in_lang"), F.inline("vector")).where("n > 0")
    held = join_small(held, groups, ["lang", "g"], "inner")
    p, q = share(F.col("n"), F.col("own"), F.col("terms")), share(F.col("in_lang"), F.col("total"), F.col("terms"))
    held = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = held.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= listed)
    return pairs.withColumn("rank", rank).unionByName(best)
