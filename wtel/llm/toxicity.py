"""Toxicity by a factorization machine over hashed terms.

A term has a weight and a small vector; the score adds the weights of a text's terms and the inner
products of all their pairs, so that two terms can tell together what neither tells alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import join_small, mixed, remainder_is, sampled, slices, staged, text_hashes

#: Labelled texts of each class that the machine is fitted on at most.
PER_CLASS = 8000
#: Terms of the machine at most, texts a term must be in, least chi-square of a term and the label.
TERMS, MIN_TEXTS, CHI_SQUARE = 1 << 14, 4, 12.0
#: Most frequent terms that the machine gets whatever they tell alone, and the least share of texts they are in.
COMMON, COMMON_SHARE = 256, 0.05
#: Beginnings of words that are terms too, for endings that were not learnt.
PREFIXES = (4, 5, 6)
FACTORS, PENALTY, FACTOR_PENALTY, RATE, ROUNDS = 8, 1e-4, 1e-3, 0.1, 300
MODULUS, REMAINDER, PREDICTED = 3, 1, 0.7
#: Punctuation around words.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`«»„“”‚‘’…¡¿"
PART_BYTES = 4 << 20


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of the texts: hashes of words, stripped of punctuation, and of their beginnings."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES)
    lengths = pc.utf8_length(words).to_numpy()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    codes = coded.indices.to_numpy()
    # each distinct word of a text once
    pairs = np.unique(row.astype(np.int64) * max(len(words), 1) + codes)
    row, codes = pairs // max(len(words), 1), pairs % max(len(words), 1)
    rows, out = [], []
    for k, size in enumerate((None, *PREFIXES)):
        if size is None:
            hashes, used = text_hashes(words), lengths > 0
        else:
            hashes, used = text_hashes(pc.utf8_slice_codeunits(words, 0, size)), lengths >= size
        some = used[codes]
        rows.append(row[some])
        out.append(mixed(hashes[codes[some]] + np.uint64(k)))
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[new], out[new]


def log_odds(a: np.ndarray, k: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Log odds of terms in ``a`` toxic ones of ``k`` texts, two standard errors nearer to 0."""
    a, b = a + 0.5, k - a + 0.5
    odds = np.log(a / (n_toxic + 1)) - np.log(b / (n - n_toxic + 1))
    return np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / a + 1 / b), 0)


def _added(columns: np.ndarray, pick: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of each column's picked values between consecutive cuts."""
    out = np.zeros((len(columns), len(cuts) - 1))
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        for k, column in enumerate(columns):
            out[k, some] = np.add.reduceat(column[pick], cuts[some])
    return out


class Machine:
    """Weights of terms; without terms every text has the share of toxic texts as its score."""

    def __init__(self, hashes: np.ndarray, bias: float):
        self.hashes, self.bias = np.sort(hashes), bias
        self.w = np.zeros(len(hashes))
        self.v = np.random.default_rng(5).normal(0, 0.05, (len(hashes), FACTORS))

    def find(self, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose term is known, as (row, place of the term)."""
        if not len(self.hashes):
            return rows[:0], rows[:0]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[at] == found
        return rows[known], at[known]

    def _sums(self, n: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of n texts before the logistic function, and their summed vectors; ``row`` is sorted."""
        own = self.w - 0.5 * (self.v * self.v).sum(axis=1)
        sums = _added(np.vstack([own, self.v.T]), at, np.searchsorted(row, np.arange(n + 1)))
        return self.bias + sums[0] + 0.5 * (sums[1:] ** 2).sum(axis=0), sums[1:]

    def score(self, n: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(n, row, at)[0], -30, 30)))

    def fit(self, y: np.ndarray, row: np.ndarray, at: np.ndarray, known: np.ndarray) -> None:
        """Logistic loss, all texts in each round, with steps scaled by running moments.

        A term that fewer than ``MIN_TEXTS`` of the texts hold starts at its ``known`` weight and stays
        there unless they speak against it.
        """
        n, t = len(y), len(self.hashes)
        start = np.where(np.bincount(at, minlength=t) < MIN_TEXTS, known, 0.0)
        self.w += start
        by_term = np.argsort(at, kind="stable")
        cuts, by_term = np.searchsorted(at[by_term], np.arange(t + 1)), row[by_term]
        state = [(np.zeros(x), np.zeros(x)) for x in ((1,), (t,), (t, FACTORS))]
        for k in range(1, ROUNDS + 1):
            total, sums = self._sums(n, row, at)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) / n
            pull = _added(np.vstack([error, error * sums]), by_term, cuts)
            grads = (
                np.array([error.sum()]),
                pull[0] + PENALTY * (self.w - start) / t,
                pull[1:].T - self.v * pull[0][:, None] + FACTOR_PENALTY * self.v / t,
            )
            moves = []
            for (first, second), grad in zip(state, grads, strict=True):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                moves.append(RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8))
            self.bias -= float(moves[0][0])
            self.w -= moves[1]
            self.v -= 0.2 * moves[2]


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, toxic and one text of every id; only texts of ids with several rows are shuffled by id."""
    rows = docs.select("doc_id", "text")
    once, again = (join_small(rows, ids.where(x).drop("copies"), "doc_id", "inner") for x in ("copies = 1", "copies > 1"))
    return once.unionByName(again.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))


def learn(docs: DataFrame, labels: DataFrame, most: int = PER_CLASS) -> Machine:
    """The machine of at most ``most`` labelled texts of each class.

    Terms are counted in Spark over all training texts and chosen by chi-square; only the fit reads the
    sample, of whose texts the places of chosen terms reach the driver. Terms that are too rare
    in it have the log odds of the whole counts. An id with both labels counts as toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~remainder_is(F.col("doc_id"), MODULUS, REMAINDER))
    known = staged(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    found = join_small(docs.select("doc_id"), known, "doc_id", "inner")
    found = staged(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("copies")), "found")
    sizes = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    n_toxic, n = sizes.get(1, 0), sum(sizes.values())
    if not n_toxic or n_toxic == n:
        return Machine(np.empty(0, np.uint64), 30.0 if n_toxic else -30.0)
    sample = staged(sampled(found, "toxic", most, "toxic-1", "doc_id"), "sample")
    in_sample = [min(sizes[k], most) for k in (0, 1)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                rows, found = terms(part.column("text"))
                toxic = part.column("toxic").to_numpy()[rows]
                names, place = np.unique(found, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.view(np.int64)),
                        pa.array(np.bincount(place, toxic, len(names)).astype(np.int64)),
                        pa.array(np.bincount(place, minlength=len(names)).astype(np.int64)),
                    ],
                    ["term", "toxic", "n"],
                )

    counts = _texts(docs, found).select("text", "toxic").mapInArrow(explode, "term long, toxic long, n long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("n").alias("k")).where(F.col("k") >= MIN_TEXTS)
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    gap = a * n - k * n_toxic
    counts = counts.withColumn("chi", gap * gap * n / (k * (n - k + 0.5) * n_toxic * (n - n_toxic)))
    counts = staged(counts.where((F.col("chi") >= CHI_SQUARE) | (k >= COMMON_SHARE * n)), "terms")
    telling = counts.where(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(TERMS)
    # two terms can tell together what neither tells alone
    common = counts.where(k >= COMMON_SHARE * n).orderBy(F.desc("k"), "term").limit(COMMON)
    chosen = telling.unionByName(common).select("term", "a", "k").distinct().orderBy("term").toArrow()
    hashes, a, k = (chosen[x].to_numpy() for x in ("term", "a", "k"))
    hashes = hashes.view(np.uint64)
    # the machine's terms are sorted
    weight = log_odds(a, k, n_toxic, n)[np.argsort(hashes)]
    machine = Machine(hashes, float(np.log(in_sample[1] / in_sample[0])))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                rows, at = machine.find(*terms(part.column("text")))
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), lists], ["doc_id", "toxic", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = _texts(docs, sample).select("doc_id", "toxic", "text").mapInArrow(places, f"doc_id {kind}, toxic int, at array<int>")
    got = got.orderBy("doc_id").select("toxic", "at").toArrow().combine_chunks()
    lists = got["at"].combine_chunks()
    row = np.repeat(np.arange(len(got)), pc.list_value_length(lists).to_numpy())
    machine.fit(got["toxic"].to_numpy().astype(float), row, lists.flatten().to_numpy().astype(np.int64), weight)
    return machine


def score(docs: DataFrame, labels: DataFrame, most: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic is likelier) and predicted of every text.

    Learns only from labelled ids whose crc32 mod 3 is not 1. A score reads the text alone, whole.

    A null, empty or blank text has no terms and gets the machine's bias. Null labels, and labels
    of null ids, are not learnt from; where one class is missing, every score is that of the
    other: 0 or 1, and 0 without labels. Every row gives one row, repeated rows and null ids too
    (not held out). Columns other than doc_id and text are not read, so they cannot clash. An empty table
    gives an empty result.
    """
    machine = learn(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found = machine.score(part.num_rows, *machine.find(*terms(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= PREDICTED).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", remainder_is(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
