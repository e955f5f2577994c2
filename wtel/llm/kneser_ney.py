"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read by workers from mapped files.

Tasks count the word pairs of their texts and send them, sorted and packed, to shards by their first
word. A shard adds up its pairs, writes them as arrays sorted by hash to the shared folder and
passes on what they say about single words; shards of words do the same for these. Workers map the
files into memory and look up the words and pairs of their texts by binary search.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import chained, mixed, remainder_is, shared_folder, slices, staged, text_hashes, word_hashes
from wtel.llm.quality import words_of

MODULUS, REMAINDER = 5, 1
#: Characters of training text for each shard; the number of shards grows with the corpus.
SHARD_CHARACTERS = 4 << 20
#: Pairs that a task collects before it sends them.
FLUSH = 3 << 20
#: A first word with more than this share of the sampled words is spread over all shards.
HEAVY, SAMPLE = 1 / 512, 64
PART_BYTES = 2 << 20

#: What starts and ends a text; no word holds a blank.
START_TEXT, END_TEXT = " start", " end"
START, END = text_hashes(pa.array([START_TEXT, END_TEXT]))
#: Per word: tokens, different words before it, tokens after it, different words after it once, twice, more often.
WORD_FIELDS = ("tokens", "before", "after", "once", "twice", "more")


def local_path(path: str) -> str:
    """The path of a folder that tasks open themselves: it must be mounted on all machines."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model's folder must be a file system that workers can map")
    return parsed.path if parsed.scheme else path


def _save(path: str, array: np.ndarray) -> None:
    """Write a whole file under its name, or none: a repeated task replaces it by the same."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return chained(first, second)


def pair_shard(first: np.ndarray, second: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """By the first word; pairs of a heavy one by both."""
    spread = np.isin(first, heavy)
    return (mixed(np.where(spread, first ^ (second * np.uint64(3)), first)) % np.uint64(shards)).astype(np.int64)


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(words ^ np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token with the one before it (a start before the first) and its text's row; an end is the last token."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    tokens = np.empty(len(row), np.uint64)
    ends = np.cumsum(counts) - 1
    is_end = np.zeros(len(row), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, words
    first = np.empty_like(tokens)
    first[1:] = tokens[:-1]
    first[np.concatenate([[0], ends[:-1] + 1])[: len(counts)]] = START
    return first, tokens, row


def added(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs added up, sorted by both words."""
    order = np.lexsort((second, first))
    first, second, count = first[order], second[order], count[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return first[at], second[at], np.add.reduceat(count, at) if len(at) else count


def _pack(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted pairs as bytes; a first word is written once for its run."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(first))).astype(np.uint32)
    head = np.array([len(at), len(first)], np.uint64)
    return b"".join(x.tobytes() for x in (head, first[at], second, runs, count.astype(np.uint32)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, n = (int(x) for x in np.frombuffer(data, np.uint64, 2))
    at, out = 16, []
    for kind, size in ((np.uint64, words), (np.uint64, n), (np.uint32, words), (np.uint32, n)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return np.repeat(out[0], out[2]), out[1], out[3].astype(np.int64)


def _packed_pairs(docs: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            first, second, count = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            shard = pair_shard(first, second, shards, heavy)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            blobs = []
            for s in used:
                own = order[cuts[s] : cuts[s + 1]]
                blobs.append(_pack(first[own], second[own], count[own]))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "pairs"])

        n = 0
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                first, second, _ = token_pairs(part.column("text"))
                held.append(added(first, second, np.ones(len(first), np.int64)))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "shard int, pairs binary")


def _words_of_pairs(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the pairs and their ``WORD_FIELDS``."""
    words, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    a, b, n = place[: len(first)], place[len(first) :], len(words)
    fields = [
        np.bincount(b, count, n),
        np.bincount(b, minlength=n),
        np.bincount(a, count, n),
        np.bincount(a[count == 1], minlength=n),
        np.bincount(a[count == 2], minlength=n),
        np.bincount(a[count > 2], minlength=n),
    ]
    return words, np.stack([f.astype(np.int64) for f in fields], axis=1)


def _count(docs: DataFrame, folder: str, shards: int, heavy: np.ndarray) -> DataFrame:
    """Write the pair shards, and give what they say about words: word shard, packed words and fields, pairs seen 1 to 4 times."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        parts = [_unpack(p.as_py()) for p in group["pairs"]]
        first, second, count = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        keys = pair_key(first, second)
        order = np.argsort(keys)
        _save(f"{folder}/pair-keys-{shard}.npy", keys[order])
        _save(f"{folder}/pair-counts-{shard}.npy", count[order].astype(np.uint32))
        words, fields = _words_of_pairs(first, second, count)
        to = word_shard(words, shards)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(shards + 1))
        used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
        rows = [by[cuts[s] : cuts[s + 1]] for s in used]
        seen = [[int((count == k).sum()) for k in (1, 2, 3, 4)]] + [[0] * 4] * (len(used) - 1)
        return pa.table(
            {
                "shard": pa.array(used, pa.int32()),
                "words": pa.array([words[r].tobytes() for r in rows], pa.binary()),
                "fields": pa.array([fields[r].astype(np.uint32).tobytes() for r in rows], pa.binary()),
                "seen": pa.array(seen, pa.list_(pa.int64())),
            }
        )

    grouped = _packed_pairs(docs, shards, heavy).groupBy("shard")
    return grouped.applyInArrow(run, "shard int, words binary, fields binary, seen array<long>")


def _word_tables(words: DataFrame, folder: str) -> DataFrame:
    """Write the word shards; a row per shard with the sums that the model needs."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        names = np.frombuffer(b"".join(group["words"].to_pylist()), np.uint64)
        fields = np.frombuffer(b"".join(group["fields"].to_pylist()), np.uint32).reshape(-1, len(WORD_FIELDS))
        keys, place = np.unique(names, return_inverse=True)
        sums = np.stack([np.bincount(place, f, len(keys)) for f in fields.T], axis=1).astype(np.int64)
        _save(f"{folder}/word-keys-{shard}.npy", keys)
        _save(f"{folder}/word-fields-{shard}.npy", sums)
        before = sums[:, 1]
        row = {
            "n_tokens": int(sums[:, 0].sum()),
            "n_words": int((sums[:, 0] > 0).sum()),
            "n_pairs": int(before.sum()),
            "words_seen": [int((before == k).sum()) for k in (1, 2, 3, 4)],
            "pairs_seen": [sum(s.as_py()[k] for s in group["seen"]) for k in range(4)],
        }
        return pa.Table.from_pylist([row])

    return words.groupBy("shard").applyInArrow(
        run, "n_tokens long, n_words long, n_pairs long, words_seen array<long>, pairs_seen array<long>"
    )


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from how many have the counts 1 to 4.

    Where a corpus is too small for the formula: 0.5, 1, 1.5.
    """
    n1, n2, n3, n4 = seen
    if min(seen) > 0:
        y = n1 / (n1 + 2 * n2)
        out = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 <= d <= k for k, d in enumerate(out, 1)):
            return out
    return 0.5, 1.0, 1.5


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


class Model:
    """Totals and the place of the mapped tables; small enough to go with every task."""

    def __init__(self, folder: str, shards: int, heavy: np.ndarray, totals: dict):
        self.folder, self.shards, self.heavy = folder, shards, heavy
        self.n_tokens, self.n_words, self.n_pairs = (totals[k] for k in ("n_tokens", "n_words", "n_pairs"))
        self.for_pairs, self.for_words = discounts(totals["pairs_seen"]), discounts(totals["words_seen"])
        d, seen = self.for_words, totals["words_seen"]
        more = self.n_words - seen[0] - seen[1]
        spare = d[0] * seen[0] + d[1] * seen[1] + d[2] * more
        #: Probability that the words' level leaves to all words alike, the unknown one included.
        self.level = (spare / self.n_pairs if self.n_pairs else 1.0) / (self.n_words + 1)

    def _find(self, kind: str, values: str, keys: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, shard))
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for own in np.split(order, cuts[1:]):
            if not len(own):
                continue
            s = shard[own[0]]
            table = _mapped(f"{self.folder}/{kind}-keys-{s}.npy")
            if table is None or not len(table):
                continue
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            hit = table[at] == keys[own]
            found = _mapped(f"{self.folder}/{kind}-{values}-{s}.npy")[at[hit]]
            out[own[hit]] = found.reshape(len(found), width)
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        return self._find("word", "fields", keys, word_shard(keys, self.shards), len(WORD_FIELDS))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        shard = pair_shard(first, second, self.shards, self.heavy)
        return self._find("pair", "counts", pair_key(first, second), shard, 1)[:, 0]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, log10 probability."""
        first, second, row = token_pairs(texts)
        rows = len(texts)
        every, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        fields = self.words(every)
        before, here = fields[place[: len(first)]], fields[place[len(first) :]]
        pair = place[: len(first)].astype(np.int64) * len(every) + place[len(first) :]
        distinct, back = np.unique(pair, return_inverse=True)
        a, b = every[distinct // max(len(every), 1)], every[distinct % max(len(every), 1)]
        count = self.pairs(a, b)[back]
        continued = here[:, 1]
        off = np.array([0.0, *self.for_words])[np.minimum(continued, 3)]
        low = self.level + ((continued - off) / self.n_pairs if self.n_pairs else 0.0)
        total = before[:, 2]
        d = np.array([0.0, *self.for_pairs])
        spare = before[:, 3:6] @ d[1:]
        known = np.maximum(total, 1)
        high = np.where(total > 0, (count - d[np.minimum(count, 3)] + spare * low) / known, low)
        base = np.log10((here[:, 0] + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        return (
            np.bincount(row, minlength=rows),
            np.bincount(row, here[:, 0] > 0, rows).astype(np.int64),
            np.bincount(row, base, rows),
            np.bincount(row, np.log10(high), rows),
        )


def _heavy_words(docs: DataFrame) -> np.ndarray:
    """Hashes of very frequent words of about one text in ``SAMPLE``. Only the shards' layout depends on them."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = staged(some.select(F.explode(words_of(lower)).alias("word")).groupBy("word").count(), "sampled")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.where(F.col("count") > max(50, total * HEAVY)).select("word").collect()
    return np.sort(text_hashes(pa.array([START_TEXT, *(r["word"] for r in found)])))


def learn(docs: DataFrame) -> Model:
    """The model of all texts whose id's crc32 mod 5 is not 1; null ids count too, null texts are empty."""
    spark = docs.sparkSession
    training = docs.where(~remainder_is(F.col("doc_id"), MODULUS, REMAINDER)).select("text")
    characters = training.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(8, math.ceil(characters / SHARD_CHARACTERS))
    heavy = _heavy_words(training)
    folder = local_path(f"{shared_folder(spark).rstrip('/')}/bigrams-{uuid.uuid4().hex}")
    os.makedirs(folder)
    words = staged(_count(training, folder, shards, heavy), "words")
    rows = staged(_word_tables(words, folder), "totals").collect()
    names = ("n_tokens", "n_words", "n_pairs")
    totals: dict = {n: sum(r[n] for r in rows) for n in names}
    totals |= {n: [sum(r[n][k] for r in rows) for k in range(4)] for n in ("words_seen", "pairs_seen")}
    return Model(folder, shards, heavy, totals)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Tokens are the words, A-Z lower-cased, and one end. ``base_score`` adds log10((c + 0.5) / (N +
    0.5 (V + 1))) over the tokens, ``score`` is the bigram model's log10 probability of the text;
    -score / n_tokens is its log10 perplexity.

    A null, empty or blank text has the end as its only token. Without training texts each token
    has probability 1. A null id is not held out. Repeated rows count, and are scored, each time. Only doc_id and
    text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    model = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                n, known, base, log = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                        pa.array(np.full(len(n), model.n_tokens), pa.int64()), pa.array(base), pa.array(log),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", remainder_is(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
