"""Byte-level BPE: chunks of a text are pre-tokenised in parallel, stitched, and their pieces encoded.

A match of the pattern depends only on the text from its start on. Two tokenisations that share a
boundary are therefore equal from there, which is what lets overlapping chunks be joined: a chunk's
boundaries short of its end are right once its start is, and the next chunk takes over at the first
boundary that both have in the overlap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wtel.llm.common import slices, staged

#: Characters of a chunk, and how many of the next chunk it sees.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces whose ids a worker remembers.
REMEMBERED = 150_000
#: Bytes of text that are encoded at once; the arrays over it take some thirty times as much.
PART_BYTES = 512 << 10
#: Code points whose classes are looked up at once; surrogates fill whole steps.
STEP = 0x800
#: Rows that are decoded at once.
ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank, leftmost first, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 100:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == 1 << 60:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over a linked list, for pieces of any length."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one side has been merged meanwhile
        end[i], j = stop, after[middle]
        end[middle] = -1
        after[i] = j
        if j < n:
            before[j] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


#: Classes of characters: letters, numbers, spaces, others, and the place between two texts.
LETTER, NUMBER, SPACE, OTHER, BETWEEN = range(5)
#: Endings that are split off at an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters behind a boundary that can decide about it.
AHEAD = 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
    for start in range(0, 0x110000, STEP):
        if 0xD800 <= start < 0xE000:
            continue
        some = "".join(map(chr, range(start, start + STEP)))
        for kind, pattern in patterns:
            for m in pattern.finditer(some):
                out[start + m.start() : start + m.end()] = kind
    return out


def piece_starts(points: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Where a piece of the pattern starts, for code points of texts with a place between each two.

    A piece is a run of letters, of numbers, or of others, with one blank before it; a run of
    spaces gives its last one up to what follows. At an apostrophe that starts a piece the endings
    split off.
    """
    kind = _classes()[points]
    kind[between] = BETWEEN
    before = np.concatenate([[BETWEEN], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [BETWEEN]]).astype(np.uint8)
    changed = kind != before
    blank = np.concatenate([[False], (points[:-1] == 32) & (kind[:-1] == SPACE)])
    gives_up = (kind == SPACE) & (after != SPACE) & (after != BETWEEN)
    starts = (changed & ~(blank & (kind != BETWEEN))) | gives_up
    marks = np.flatnonzero((points == 39) & starts)
    n = len(points)
    for ending in ENDINGS:
        at = marks[marks + len(ending) < n]
        for j, c in enumerate(ending):
            at = at[(points[at + 1 + j] == ord(c)) & (kind[at + 1 + j] != BETWEEN)]
        starts[at + 1] = False
        ends = at + 1 + len(ending)
        starts[ends[ends < n]] = True
    return starts


class Tokenizer:
    """Pieces by classes of characters, ids by merges; a worker keeps the ids of pieces it has met."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.known: dict[bytes, list[int]] = {}
        table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.binary())

    def ids_of(self, piece: bytes) -> list[int]:
        if (ids := self.known.get(piece)) is None:
            ids = merged(piece, self.ranks)
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, texts: list[str], first: list[int] | None = None, stop: list[int] | None = None) -> pa.Array:
        """A list of ids for each text; ``first`` and ``stop`` are boundaries between which to encode."""
        whole = "\0".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ends = begins + sizes
        starts = piece_starts(points, ends[:-1])
        at = np.flatnonzero(starts)
        data = whole.encode()
        small = len(data) < 1 << 31
        place = (points > 0x7F).astype(np.uint8)  # bytes of a character beyond the first
        place += points > 0x7FF
        place += points > 0xFFFF
        place = np.cumsum(place, dtype=np.int32 if small else np.int64)
        # a piece starts behind the characters before it: their number and their further bytes
        before = np.where(at > 0, place[at - 1], 0)
        cuts = np.append(at + before, len(data)).astype(np.int32 if small else np.int64)
        del points, place, starts
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(at), buffers)
        low = np.searchsorted(at, begins if first is None else begins + np.array(first))
        high = np.searchsorted(at, ends if stop is None else begins + np.array(stop))
        used = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)] or [np.empty(0, np.int64)])
        if len(used) != len(pieces):
            pieces = pieces.take(pa.array(used))
        coded = pieces.dictionary_encode()
        each = [self.ids_of(piece) for piece in coded.dictionary.to_pylist()]
        counts = np.array([len(i) for i in each], np.int64)
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(counts.sum()))
        codes = coded.indices.to_numpy()
        taken = counts[codes]
        until = np.concatenate([[0], np.cumsum(taken)])
        shift = (np.cumsum(counts) - counts)[codes] - until[:-1]
        ids = flat[np.arange(until[-1]) + np.repeat(shift, taken)]
        lists = until[np.concatenate([[0], np.cumsum(high - low)])]
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each list the ids as little-endian 32-bit integers, and the bytes of its tokens."""
        flat = ids.flatten()
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        tokens = self.table.take(flat)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy())])
        raw = b"".join(tokens.to_pylist()) if tokens.offset else tokens.buffers()[2]
        packed = pa.py_buffer(flat.to_numpy().astype("<u4").tobytes())
        rows = len(offsets) - 1
        cut = lambda o, data: pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(o.astype(np.int64)), data])
        return cut(offsets * 4, packed).cast(pa.binary()), cut(ends[offsets], raw or pa.py_buffer(b"")).cast(pa.binary())


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer; read once in each process."""
    return Tokenizer(path)


IDS = pa.list_(pa.int32())


def boundaries(text: str) -> np.ndarray:
    return np.flatnonzero(piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.empty(0, np.int64)))


def _encode_whole(docs: DataFrame, path: str) -> DataFrame:
    """The rows with their last column, text, replaced by ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                ids = own.encode(pc.fill_null(part.column("text"), "").to_pylist())
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, ids], [*part.schema.names[:-1], "ids"])
                del ids, kept
                pa.default_memory_pool().release_unused()

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]
    return docs.mapInArrow(run, ", ".join([*kept, "ids array<int>"]))


def _encode_long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (_row, doc_id, text): chunks first, then the texts that have no common boundary in an overlap."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    chunks = docs.select("_row", "doc_id", "text", F.posexplode(starts).alias("k", "start")).select(
        "_row", "doc_id", "k", "start", (F.length("text") <= F.col("start") + chunk).alias("is_last"),
        F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("text"),
    )
    chunks = staged(chunks.repartition("_row", "k"), "chunks")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "start", "is_last"))
            for text, start, is_last in zip(*columns, strict=True):
                cuts = boundaries(text)
                sure = cuts[(cuts >= chunk) & (cuts <= len(text) - AHEAD)]
                heads.append(start + cuts[cuts < overlap])
                tails.append([start + len(text)] if is_last else start + sure)
            kept = [batch.column(c) for c in ("_row", "k")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(heads, IDS), pa.array(tails, IDS)], ["_row", "k", "head", "tail"]
            )

    marks = chunks.select("_row", "k", "start", "is_last", "text").mapInArrow(
        mark, "_row long, k int, head array<int>, tail array<int>"
    )
    by = Window.partitionBy("_row").orderBy("k")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(by)))
    marks = marks.withColumn("begin", F.when(F.col("k") == 0, F.lit(0)).otherwise(common))
    marks = marks.withColumn("stop", F.lead("begin").over(by)).withColumn("n_open", F.count_if(F.col("begin").isNull()).over(Window.partitionBy("_row")))
    marks = staged(
        marks.select("_row", "k", "begin", F.coalesce("stop", F.array_max("tail")).alias("stop"), "n_open"), "marks"
    )

    def encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                start, begin, stop = (part.column(c).to_numpy() for c in ("start", "begin", "stop"))
                ids = own.encode(part.column("text").to_pylist(), begin - start, stop - start)
                kept = [part.column(c) for c in ("_row", "doc_id", "k")]
                yield pa.RecordBatch.from_arrays([*kept, ids], ["_row", "doc_id", "k", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = chunks.drop("is_last").join(marks.where("n_open = 0"), ["_row", "k"])
    cut = cut.select("_row", "doc_id", "k", "text", "start", "begin", "stop")
    parts = cut.mapInArrow(encode_chunk, f"_row long, doc_id {kind}, k int, ids array<int>")
    stitched = parts.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    stitched = stitched.select("_row", "doc_id", F.flatten(F.col("parts.ids")).alias("ids"))
    open_rows = marks.where("n_open > 0").select("_row").distinct()
    whole = _encode_whole(docs.join(open_rows, "_row", "left_semi").select("_row", "doc_id", "text"), path)
    return stitched.unionByName(whole).drop("_row")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of each text by the ranks in ``path``; each match of the pattern separately.

    The pattern is that of the public rank files: contractions, runs of letters, numbers or other
    characters with a blank before them, and spaces.

    Texts of up to ``chunk`` characters are their only chunk. Longer ones are cut into overlapping
    chunks that any task may take; where two chunks have no boundary in common, as in a run of
    letters longer than ``overlap``, the text is encoded whole.

    A null or empty text has no ids. There are no special tokens. Every row gives one row, repeated
    rows and null ids too; only doc_id and text are read, so other columns cannot clash. An
    empty table gives an empty result. The ids of one text must fit in one row.
    """
    rows = docs.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = _encode_whole(rows.where(size <= chunk), path)
    numbered = rows.where(size > chunk).withColumn("_row", F.monotonically_increasing_id())
    long = staged(numbered.select("_row", "doc_id", "text"), "long")
    return short.unionByName(_encode_long(long, path, chunk, overlap))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, packed (ids as little-endian unsigned 32-bit integers) and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                packed, decoded = own.decode(part.column("ids"))
                sizes = pc.fill_null(pc.list_value_length(part.column("ids")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, packed, decoded], ["doc_id", "n_tokens", "packed", "decoded"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, packed binary, decoded binary"
    )
