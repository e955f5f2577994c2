"""Ranked lexical search: branch and bound on a tree of documents' term vectors.

Each document is the vector of its terms that some item asks for, most frequent term first.
Sorted, vectors with a common beginning are neighbours: a trie, whose nodes are ranges of rows. A node's
greatest count of each term and least length number bound every score below it, so a branch whose bound is
below an item's fiftieth best score so far is left out for that item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wtel.llm.common import byte_table, coded_words, join_small, row_of, slices, staged, text_hashes, word_lists
from wtel.sinks.staging import run_folder

#: Documents listed for an item.
MOST = 50
#: Items, and distinct terms of them, that are searched together; an item with more terms is alone.
ITEMS, TERMS = 256, 8192
#: Documents and vector entries of a tree, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 16_384, 1 << 21, 64
#: Bytes of text that are cut into terms at once.
PART_BYTES = 2 << 20

#: Terms are runs of letters, digits and all characters beyond ASCII.
TERM_BYTES = byte_table("abcdefghijklmnopqrstuvwxyz0123456789")


def vectors_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text the number of terms, and its distinct terms (hashes) with their counts."""
    words, codes, offsets = coded_words(word_lists(texts, TERM_BYTES))
    hashes = text_hashes(words)
    distinct = max(len(hashes), 1)
    keys, counts = np.unique(row_of(offsets) * distinct + codes, return_counts=True)
    cuts = pa.array(np.searchsorted(keys // distinct, np.arange(len(texts) + 1)), pa.int32())
    terms = hashes[keys % distinct].view(np.int64) if len(keys) else np.empty(0, np.int64)
    return (
        np.diff(offsets),
        pa.ListArray.from_arrays(cuts, pa.array(terms, pa.int64())),
        pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int32())),
    )


def index(rows: DataFrame, key: str) -> DataFrame:
    """``key``, n, terms and tfs of every text that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                n, terms, tfs = vectors_of(part.column("text"))
                out = pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), terms, tfs], [key, "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, n long, terms array<long>, tfs array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()


def document_frequencies(vectors: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many vectors each term of the sorted vocabulary is; a task sends one row per term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            flat = batch.column("terms").flatten().to_numpy()
            at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == flat], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "df"])

    sums = vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(vocabulary), np.int64)
    for row in sums.collect():  # a row per term of the block
        out[row.term] = row.df
    return out


class Best:
    """The best documents of each item so far: highest score, then smallest id, null last."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items
        self.nulls = [np.empty(0, bool)] * items
        #: scores below are no use; a score of 0 is none
        self.least = np.ones(items, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores[item], scores), (self.ids[item], ids), (self.nulls[item], nulls)))
        order = np.lexsort((ids, nulls, -scores))[: self.most]
        self.scores[item], self.ids[item], self.nulls[item] = scores[order], ids[order], nulls[order]
        if len(order) == self.most:
            self.least[item] = max(1, self.scores[item][-1])


class Tree:
    """A trie over restricted vectors: terms (by frequency, 0 the most frequent) and counts of each document."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, offsets: np.ndarray, m: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
        keys = terms.astype(">u4").tobytes()
        rows = [keys[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = np.array(sorted(range(len(rows)), key=rows.__getitem__), np.int64)
        self.m, self.ids, self.nulls = m[order], ids[order], nulls[order]
        sizes = np.diff(offsets)[order]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(self.offsets[-1]) + np.repeat(offsets[:-1][order] - self.offsets[:-1], sizes)
        self.terms, self.tfs = terms[at], tfs[at]
        #: terms that a document shares with the one before it, from the first on
        self.shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b, c = self.offsets[i - 1], self.offsets[i], self.offsets[i + 1]
            k = min(b - a, c - b)
            differ = np.flatnonzero(self.terms[a : a + k] != self.terms[b : b + k])
            self.shared[i] = differ[0] if len(differ) else k

    def children(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges of rows below the node of rows a to b: its branches, small neighbours together."""
        inner = self.shared[a + 1 : b]
        cuts = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
        out: list[tuple[int, int]] = []
        start = a
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x >= LEAF and start < x:
                out.append((start, x))
                start = x
            if y - start >= LEAF:
                out.append((start, y))
                start = y
        if start < b:
            out.append((start, b))
        return out


def _gain(tfs: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 20 * m)


class Search:
    """Depth-first branch and bound of a block's items over one tree after another.

    ``wanted`` has a row per term, a column per item: the term's weight where the item has it. Scores are
    sums of whole numbers below 2**53, so products of matrices in doubles are exact.
    """

    def __init__(self, wanted: np.ndarray, most: int):
        self.wanted = wanted
        self.best = Best(wanted.shape[1], most)

    def over(self, tree: Tree) -> None:
        if len(tree.ids):
            self._visit(tree, self._node(tree, 0, len(tree.ids)))

    def _node(self, tree: Tree, a: int, b: int) -> tuple:
        """Bound of each item, greatest counts, range and children of a node."""
        if b - a <= LEAF or (parts := tree.children(a, b)) == [(a, b)]:
            most = np.zeros(len(self.wanted), np.int32)
            x, y = tree.offsets[a], tree.offsets[b]
            np.maximum.at(most, tree.terms[x:y], tree.tfs[x:y])
            below = []
        else:
            below = [self._node(tree, x, y) for x, y in parts]
            most = np.maximum.reduce([n[1] for n in below])
            for n in below:
                n[1] = None
        some = np.flatnonzero(most)
        bound = _gain(most[some], tree.m[a:b].min()).astype(np.float64) @ self.wanted[some]
        return [bound, most, a, b, below]

    def _visit(self, tree: Tree, node: list) -> None:
        bound, _, a, b, below = node
        active = np.flatnonzero(bound >= self.best.least)
        if not len(active):
            return
        if below:
            for child in sorted(below, key=lambda n: -n[0][active].sum()):
                self._visit(tree, child)
            return
        for start in range(a, b, LEAF):
            self._leaf(tree, start, min(start + LEAF, b), active)

    def _leaf(self, tree: Tree, a: int, b: int, active: np.ndarray) -> None:
        x, y = tree.offsets[a], tree.offsets[b]
        row = np.repeat(np.arange(b - a), np.diff(tree.offsets[a : b + 1]))
        gain = _gain(tree.tfs[x:y], tree.m[a:b][row])
        used, at = np.unique(tree.terms[x:y], return_inverse=True)
        own = np.zeros((b - a, len(used)))
        own[row, at] = gain
        scores = own @ self.wanted[used][:, active]
        good = scores >= self.best.least[active]
        for k in np.flatnonzero(good.any(axis=0)):
            rows = np.flatnonzero(good[:, k])
            self.best.offer(active[k], scores[rows, k].astype(np.int64), tree.ids[a:b][rows], tree.nulls[a:b][rows])


def _search_block(vectors: DataFrame, items: list, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """item, doc_id and score: of each task, the best documents of each item of the block."""
    vocabulary = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in items]))
    df = document_frequencies(vectors, vocabulary)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    place = np.empty(len(vocabulary), np.int64)  # 0 for the most frequent term
    place[np.lexsort((vocabulary, -df))] = np.arange(len(vocabulary))
    numbers = [r.item for r in items]
    asked = [np.searchsorted(vocabulary, np.array(r.terms, np.int64)) for r in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros((len(vocabulary), len(numbers)))
        for k, terms in enumerate(asked):
            wanted[place[terms], k] = np.array(weight)[terms]
        search = Search(wanted, most)
        held: list[tuple] = []
        docs = entries = 0

        def grow() -> None:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            terms, tfs, sizes, m, ids, nulls = parts
            search.over(Tree(terms, tfs, np.concatenate([[0], np.cumsum(sizes)]), m, ids, nulls))
            held.clear()

        for batch in batches:
            terms, offsets = _lists(batch.column("terms"))
            tfs, _ = _lists(batch.column("tfs"))
            at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            known = vocabulary[at] == terms
            row, own, tf = row_of(offsets)[known], place[at[known]], tfs[known]
            order = np.lexsort((own, row))
            row, own, tf = row[order], own[order], tf[order]
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
            nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), 0).to_numpy()
            some = np.unique(row)  # a document without any asked term scores 0
            cuts = np.searchsorted(row, some)
            ends = np.append(cuts[1:], len(row))
            start = 0
            while start < len(some):
                room = np.searchsorted(ends, ends[start - 1] * (start > 0) + TREE_ENTRIES - entries, side="right")
                stop = min(max(start + (docs == 0), int(room)), start + TREE_DOCS - docs, len(some))
                if stop > start:
                    x, y, rows = cuts[start], ends[stop - 1], some[start:stop]
                    held.append((own[x:y], tf[x:y], (ends - cuts)[start:stop], m[rows], ids[rows], nulls[rows]))
                    docs, entries, start = docs + stop - start, entries + y - x, stop
                if start < len(some):
                    grow()
                    docs = entries = 0
        if held:
            grow()
        best = search.best
        for k, number in enumerate(numbers):
            if len(best.ids[k]):
                columns = [pa.array([number] * len(best.ids[k]), pa.int64()), pa.array(best.ids[k], mask=best.nulls[k]), pa.array(best.scores[k])]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents with a score above 0 of each item.

    The items are the stated query set: they go through the driver in blocks of at most ``ITEMS`` items and
    ``TERMS`` terms (or one item), each searched against all documents. A document's vector is cut once.

    Equal scores are ordered by doc_id, null last. Null and empty texts have no terms: such a document is not
    counted or found, such an item has no rows. Documents that repeat are each listed; so is every
    row of ``items``, also where it repeats an id or the id is null. Texts are read whole; only doc_id, item_id and
    text are read, so other columns cannot clash. Empty tables give an empty result. A term stands for its 64-bit hash.
    """
    spark = docs.sparkSession
    vectors = staged(index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "vectors")
    numbered = staged(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    path = f"{run_folder(spark)}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], "item long, doc_id long, score long").write.parquet(path)
    block: list = []
    terms: set[int] = set()

    def close() -> None:
        if block and n_docs:
            _search_block(vectors, block, n_docs, n_terms, most).write.mode("append").parquet(path)
        block.clear()
        terms.clear()

    for row in staged(index(numbered, "item"), "asked").toLocalIterator():
        if len(block) >= ITEMS or (block and len(terms.union(row.terms)) > TERMS):
            close()
        block.append(row)
        terms.update(row.terms)
    close()
    found = spark.read.schema("item long, doc_id long, score long").parquet(path)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return join_small(best, numbered.select("item", "item_id"), "item", "inner").select("item_id", "rank", "doc_id", "score")
