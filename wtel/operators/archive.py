"""Planning of log archives: which directories go into which archive.

Entries are log directories ``(dirName, path, size, timestamp, userName)`` as read from a listing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wtel.functions.once import with_once
from wtel.functions.ordered import as_of, running_sum, time_chunk
from wtel.functions.zones import archive_day, archive_path
from wtel.sinks.staging import staged

MINUTE_MS = 60_000


def sort_logsets(entries: DataFrame) -> DataFrame:
    """Entries in time order, path as tie-break."""
    return entries.orderBy("timestamp", "path")


def exclude_today(entries: DataFrame, now_ms: int) -> DataFrame:
    """Entries of other archive days than the day of ``now_ms``; adds the column ``day``.

    Entries of later days, as a clock that runs ahead makes them, stay.
    """
    return with_once(entries, {"day": archive_day("timestamp")}).where(
        F.col("day") != archive_day(F.lit(now_ms).cast("long"))
    )


#: Entries of a block at most, about, and blocks whose summaries one task follows.
BLOCK_ROWS, FAN = 1 << 18, 256


class Summary:
    """What a run of entries does to the archive that is open when it begins.

    Whatever the fill on entry, the open archive is closed at one of the first rows, and from there on everything is
    settled. ``need[j]`` is the least fill on entry that closes the archive before row j at the latest, ``closed[j]`` how many
    archives then begin in the run, and ``left[j]`` the fill at its end. With less than any need the run only adds ``total``.
    """

    def __init__(self, need: np.ndarray, closed: np.ndarray, left: np.ndarray, total: int):
        self.need, self.closed, self.left, self.total = need, closed, left, total

    @classmethod
    def of(cls, sizes: np.ndarray, cap: int) -> Summary:
        until = np.cumsum(sizes)
        n = len(sizes)
        after = next_starts(sizes, until, cap)
        first = min(n, int(np.searchsorted(until, cap, side="left")) + 1)
        # only rows that some first start leads to
        reached, newest = np.zeros(n + 1, bool), np.arange(first)
        reached[n] = True
        while len(newest):
            reached[newest] = True
            newest = np.unique(after[newest])
            newest = newest[~reached[newest]]
        closed, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for j in np.flatnonzero(reached[:n])[::-1]:
            k = after[j]
            closed[j] = 1 + closed[k]
            left[j] = left[k] if k < n else until[-1] - until[j] + sizes[j]
        return cls(cap - until[:first], closed[:first], left[:first], int(until[-1]) if n else 0)

    def after(self, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Archives that begin, and the fill at the end, for each fill on entry."""
        j = np.searchsorted(-self.need, -fill, side="left")
        met = j < len(self.need)
        at = np.minimum(j, max(len(self.need) - 1, 0))
        none = np.zeros(len(fill), np.int64)
        closed = np.where(met, self.closed[at] if len(self.need) else none, 0)
        return closed, np.where(met, self.left[at] if len(self.need) else none, fill + self.total)

    def then(self, other: Summary) -> Summary:
        """This run followed by another one."""
        more, left = other.after(self.left)
        open_ = len(other.need) and (other.need - self.total < (self.need[-1] if len(self.need) else np.inf))
        kept = np.flatnonzero(open_) if len(other.need) else np.empty(0, np.int64)
        return Summary(
            np.concatenate([self.need, other.need[kept] - self.total]),
            np.concatenate([self.closed + more, other.closed[kept]]),
            np.concatenate([left, other.left[kept]]),
            self.total + other.total,
        )


def next_starts(sizes: np.ndarray, until: np.ndarray, cap: int) -> np.ndarray:
    """Where the next archive begins if one begins at each row: it takes entries while its bytes stay below the cap."""
    found = np.searchsorted(until, until - sizes + cap, side="left")
    return np.maximum(found, np.arange(1, len(sizes) + 1))


_SUMMARY = "day string, block int, need array<long>, closed array<long>, left array<long>, total long"


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _row(day: str, block: int, s: Summary) -> pa.RecordBatch:
    lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (s.need, s.closed, s.left)]
    return pa.RecordBatch.from_arrays(
        [pa.array([day], pa.string()), pa.array([block], pa.int32()), *lists, pa.array([s.total], pa.int64())],
        ["day", "block", "need", "closed", "left", "total"],
    )


def _summaries(rows: pa.Table) -> list[Summary]:
    lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("need", "closed", "left")]
    return [Summary(*x, t) for *x, t in zip(*lists, rows.column("total").to_pylist(), strict=True)]


def _entered(summaries: DataFrame, cap: int, starts: DataFrame | None = None) -> DataFrame:
    """day, block, fill and number (archives begun before) with which each block is entered.

    The summaries of up to ``FAN`` blocks are followed in one task. Where a day has more, theirs are first put together
    to summaries of groups, for which the same question is asked. ``starts`` has the fill and number of each group.
    """
    spread = summaries.groupBy("day").agg((F.max("block") - F.min("block")).alias("blocks"))
    most = spread.agg(F.max("blocks")).first()[0]
    if starts is None and most is not None and most >= FAN:
        groups = staged(_grouped(summaries), "block-groups")
        starts = _entered(groups, cap).withColumnRenamed("block", "group")
    group = F.floor(F.col("block") / FAN).cast("int") if starts is not None else F.lit(0)
    rows = summaries.withColumn("group", group)
    if starts is None:
        rows = rows.withColumns({"fill": F.lit(cap).cast("long"), "number": F.lit(0).cast("long")})
    else:
        rows = rows.join(starts, ["day", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["day", "group"]):
            fill, number = part.column("fill")[0].as_py(), part.column("number")[0].as_py()
            out = []
            for s in _summaries(part):
                out.append((fill, number))
                closed, left = s.after(np.array([fill]))
                fill, number = int(left[0]), number + int(closed[0])
            fills, numbers = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).combine_chunks() for c in ("day", "block")), fills, numbers], ["day", "block", "fill", "number"]
            )

    dealt = rows.repartition("day", "group").sortWithinPartitions("day", "group", "block")
    return staged(dealt.mapInArrow(run, "day string, block int, fill long, number long"), "entered")


def _grouped(summaries: DataFrame) -> DataFrame:
    """One summary for each ``FAN`` blocks of a day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["day", "group"]):
            whole = reduce(Summary.then, _summaries(part))
            yield _row(part.column("day")[0].as_py(), part.column("group")[0].as_py(), whole)

    rows = summaries.withColumn("group", F.floor(F.col("block") / FAN).cast("int"))
    dealt = rows.repartition("day", "group").sortWithinPartitions("day", "group", "block")
    return dealt.mapInArrow(run, _SUMMARY)


def _pack_by_blocks(entries: DataFrame, cap: int, parts: int | None = None) -> DataFrame:
    """Blocks of about equal row count in time order; a pass over each for its summary, one for its numbers."""
    if parts is None:
        known = staged(entries, "entries")
        parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), known.count() // BLOCK_ROWS + 1)
        entries = known
    place = ["day", "timestamp", "path"]
    ranged = entries.repartitionByRange(parts, *place).withColumn("block", F.spark_partition_id())
    rows = staged(ranged, "blocks")
    block = ["day", "block"]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, block):
            yield _row(part.column("day")[0].as_py(), part.column("block")[0].as_py(), Summary.of(part.column("size").to_numpy(), cap))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*block).sortWithinPartitions(*block, "timestamp", "path")

    summaries = staged(dealt(rows.select(*place, "size", "block")).mapInArrow(sum_up, _SUMMARY), "summaries")
    entered = _entered(summaries, cap)

    names = entries.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, block):
            sizes = part.column("size").to_numpy()
            until = np.cumsum(sizes)
            fill, begun = part.column("fill")[0].as_py(), part.column("number")[0].as_py()
            after = next_starts(sizes, until, cap)
            starts = np.zeros(len(sizes), np.int64)
            at = int(np.searchsorted(until, cap - fill, side="left")) if fill < cap else 0
            while at < len(sizes):
                starts[at] = 1
                at = int(after[at])
            out = part.select(names)
            yield from out.append_column("archive_no", pa.array(begun + np.cumsum(starts))).to_batches()

    schema = T.StructType([*entries.schema.fields, T.StructField("archive_no", T.LongType())])
    return dealt(rows.join(entered, block)).mapInArrow(number, schema)


def _pack_by_jumps(entries: DataFrame, cap: int) -> DataFrame:
    """The same packing without bringing a day to one task.

    With running totals, the archive that starts at a row ends before the first row whose total
    reaches the bytes ahead of the start plus the cap. So every row knows where the next archive
    would start if one started there. The real starts follow from the first row of the day; doubling
    the length of the jumps in every round finds n archives in log2(n) rounds.
    """
    day, minute = ["day"], time_chunk("timestamp", MINUTE_MS)
    place = ["timestamp", "path"]
    rows = running_sum(entries.withColumn("_one", F.lit(1)), day, place, minute, "_one", "idx")
    rows = staged(running_sum(rows.drop("_one"), day, place, minute, "size", "total"), "entries")

    reach = F.col("total") - F.col("size") + cap
    size = F.floor(F.col("value") / cap)
    wanted = rows.select("day", "idx", "size", (-reach).alias("value"), F.lit(0).alias("tie"))
    totals = rows.select(
        "day", (-F.col("total")).alias("value"), (-F.col("idx")).alias("tie"), F.col("idx").alias("next")
    )
    found = as_of(wanted, totals, day, ["value", "tie"], size, ["next"])
    jump = found.select(
        "day",
        "idx",
        F.when(F.col("size") >= cap, F.col("idx") + 1).otherwise(F.col("next")).alias("next"),
    ).where("next is not null")
    jump = staged(jump, "jumps")

    newest = rows.where("idx = 1").select("day", "idx")
    starts = newest = staged(newest, "starts")
    while not newest.isEmpty():
        newest = staged(
            starts.join(jump, ["day", "idx"])
            .select("day", F.col("next").alias("idx"))
            .join(rows.select("day", "idx"), ["day", "idx"], "left_semi")
            .join(starts, ["day", "idx"], "left_anti"),
            "starts",
        )
        starts = starts.unionByName(newest)
        ahead = jump.select("day", F.col("idx").alias("next"), F.col("next").alias("far"))
        jump = staged(
            jump.join(ahead, ["day", "next"]).select("day", "idx", F.col("far").alias("next")), "jumps"
        )
    opened = rows.join(starts.withColumn("_start", F.lit(1)), ["day", "idx"], "left").withColumn(
        "_start", F.coalesce("_start", F.lit(0))
    )
    numbered = running_sum(opened, day, place, minute, "_start", "archive_no")
    return numbered.select(*entries.columns, F.col("archive_no").cast("long").alias("archive_no"))


def pack_archives(entries: DataFrame, max_bytes: int, by_joins: bool = False) -> DataFrame:
    """Add ``archive_no``: in time order within each day, an archive takes entries while their bytes
    stay below half of ``max_bytes``; an entry too large for that stands alone.

    ``entries`` has the column ``day``. A day is cut into blocks that are packed on their own once it is known, from
    summaries of the blocks before, how full the open archive is; with ``by_joins`` it is packed by joins. Both
    give the same numbers at any size.
    """
    pack = _pack_by_jumps if by_joins else _pack_by_blocks
    return pack(entries, max_bytes // 2)


def archive_manifest(packed: DataFrame, archive_root: str = "/archive") -> DataFrame:
    """One row per archive: destination, first and last time, number of entries and bytes."""
    totals = packed.groupBy("day", "archive_no").agg(
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
        F.count("*").alias("entry_count"),
        F.sum("size").alias("total_bytes"),
    )
    dest = F.concat(F.lit(archive_root + "/"), archive_path("first_ms", "last_ms"))
    return totals.withColumn("dest_path", dest)


def already_archived(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Archives whose destination is listed already."""
    return manifest.join(existing, "dest_path", "left_semi")


def pending_archives(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Archives that still have to be made."""
    return manifest.join(existing, "dest_path", "left_anti")


def archive_report(done: DataFrame) -> DataFrame:
    """Compression ratio, megabytes per second and shown size of finished archives.

    ``done`` has ``total_bytes``, ``compressed_bytes`` and ``millis``. Runs under a second have no
    rate.
    """
    total = F.col("total_bytes")
    seconds = F.floor(F.col("millis") / 1000)
    kb = F.floor(total / 1024)
    rate = F.floor(kb / F.when(seconds > 0, seconds)) / 1024
    gb, mb = F.floor(total / 1024**3), F.floor(total / 1024**2)
    shown = F.when(gb > 0, gb).when(mb > 0, mb).otherwise(kb)
    unit = F.when(gb > 0, "GB").when(mb > 0, "MB").otherwise("KB")
    return done.select(
        "dest_path",
        (total.cast("float") / F.col("compressed_bytes").cast("float")).alias("compress_ratio"),
        rate.alias("mb_per_sec"),
        shown.alias("size_shown"),
        unit.alias("unit"),
    )
