"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wtel.sinks.staging import shared_folder, staged

__all__ = ["shared_folder", "staged"]

#: A word is a longest run of other characters than these: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes up to which a side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes of text that a worker handles at once; a single longer text is handled alone.
SLICE_BYTES = 8 << 20
#: Texts that a worker handles at once, however short.
SLICE_ROWS = 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    """The public rank file that the queries use unless they are given another."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; empty for null. Pure ASCII goes the fast way."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def remainder_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has the remainder; false for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def _width(field) -> Column:
    """About how many bytes a row's value takes."""
    kind = field.dataType.simpleString()
    value = F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if kind.startswith("array"):
        element = kind[6:-1]
        if element == "string":
            length = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            return F.coalesce(length, F.lit(0)) + 16
        return F.coalesce(F.size(value), F.lit(0)) * (8 * (1 + element.count(":"))) + 16
    return F.lit(8)


def fits(small: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table has few enough rows and bytes to be sent to every worker."""
    width = sum((_width(f).cast("long") for f in small.schema.fields), F.lit(16).cast("long"))
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= most and size <= most_bytes


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side whose rows and bytes are counted first: broadcast while it ``fits``.

    Beyond that it is a shuffled join, whose hot keys the adaptive skew join splits. ``small``
    should be a staged table, as it is read twice.
    """
    if fits(small, most):
        return df.join(F.broadcast(small), on, how)
    return df.join(small.hint("merge"), on, how)


def sampled(df: DataFrame, by: str, most: int, seed: str, *keys: str) -> DataFrame:
    """At most ``most`` rows of each value of ``by``: those with the least seeded hash of ``keys``.

    The values are few, as classes are. A hash limit, set from the value's count, first leaves about
    twice as many rows as wanted, so that the ranking sees a bounded number of them.
    """
    order = F.xxhash64(F.lit(seed), *keys)
    counts = df.groupBy(by).count()
    share = F.pmod(order, F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = df.join(F.broadcast(counts), by).where(share * F.col("count") <= 2 * most + 100).drop("count")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, *keys))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about ``most`` bytes of text and at most ``most_rows`` rows, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, rows = 0, batch.num_rows
    while start < rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        stop = min(stop, start + most_rows)
        yield batch.slice(start, stop - start)
        start = stop


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys, across the batches of a sorted partition."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        change = np.zeros(max(len(rows) - 1, 0), bool)
        for key in keys:
            column = rows.column(key).combine_chunks()
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(start, stop - start).to_batches()[0]
        held = rows.slice(cuts[-1]) if len(rows) else None
    if held is not None and len(held):
        yield held.combine_chunks().to_batches()[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    raw = values.cast(pa.binary()).to_pylist()
    return np.fromiter((digest(v) for v in raw), np.uint64, len(raw))


def byte_table(kept: str) -> np.ndarray:
    """What each byte becomes where words are made of the ASCII characters ``kept``, A-Z lower-cased, and all beyond ASCII."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in kept:
        out[ord(c)] = out[ord(c.upper())] = ord(c)
    return out


def word_lists(texts: pa.Array, bytes_: np.ndarray) -> pa.Array:
    """The words of each text by a ``byte_table``; a null has none, a blank one may have an empty string."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    plain = bytes_[np.frombuffer(data, np.uint8)] if data else np.empty(0, np.uint8)
    mapped = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(plain)])
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(mapped))


def coded_words(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of lists of words, which of them each word is, and the lists' offsets.

    Empty strings, as a blank text is split into, are no words.
    """
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not filled.all():
        before = np.concatenate([[0], np.cumsum(filled)])
        offsets, flat = before[offsets], flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), offsets.astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and the offsets of each text's words.

    Null and blank texts have no words. Every distinct word of the call is hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    distinct, codes, offsets = coded_words(lists)
    return text_hashes(distinct)[codes], offsets


def chained(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes; the order counts."""
    out = mixed(parts[0] + _GOLDEN)
    for part in parts[1:]:
        out = mixed((out * _GOLDEN) ^ part)
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each element of a flattened list column."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
