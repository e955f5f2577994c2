"""Ordered-series helpers that stay distributed when one key is very large.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task.
The helpers here cut each key's series into chunks along its order column, work inside
the chunks, and pass only one summary row per chunk across chunk borders.
Keys, chunk and order columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wtel.sinks.staging import staged

POLL_CHUNK = 512


def time_chunk(ts_ms: str | Column, width_ms: int = 3_600_000) -> Column:
    """Chunk number of an epoch-millisecond column; one hour wide by default."""
    return F.floor(F.col(ts_ms) / width_ms if isinstance(ts_ms, str) else ts_ms / width_ms)


def position_chunk(pos: str, width: int = 4096) -> Column:
    """Chunk number of a position column such as a walk order or a stage number."""
    return F.floor(F.col(pos) / width)


def with_previous_poll(
    df: DataFrame, keys: Sequence[str], poll: str = "poll_no", chunk: int = POLL_CHUNK
) -> DataFrame:
    """Add ``prev``: the struct of this key's row at poll ``poll - 1``, null if it was absent then.

    A row on the last poll of a chunk is also copied into the next chunk, where it only serves as
    the previous row. So one shuffle on (keys, chunk) is enough and no window partition holds more
    than ``chunk + 1`` rows of a key.
    """
    own = F.floor(F.col(poll) / chunk)
    at_border = F.pmod(F.col(poll), F.lit(chunk)) == chunk - 1
    carried = [c for c in df.columns if c not in keys]
    spread = df.withColumn(
        "_chunk", F.explode(F.when(at_border, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(poll)
    before = F.lag(F.struct(*carried)).over(w)
    return (
        spread.withColumn("_before", before)
        .where(F.col("_chunk") == own)
        .withColumn("prev", F.when(F.col(f"_before.{poll}") == F.col(poll) - 1, F.col("_before")))
        .drop("_chunk", "_before")
    )


def _earlier_chunks(keys: Sequence[str]):
    by = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return by.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _later_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    upto: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """Add the nearest non-null value of a column along each key's series, as ``{new: column}``.

    ``upto`` looks back and includes the row itself, ``before`` leaves it out, ``after`` gives the
    next value behind the row.
    """
    upto, before, after = upto or {}, before or {}, after or {}
    src = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    at = F.struct(*order)
    here, heads, across = {}, [], []
    for new, c in {**upto, **before}.items():
        end = Window.currentRow if new in upto else -1
        here[new] = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
        heads.append(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_h_{new}"))
        across.append(F.last(f"_h_{new}", ignorenulls=True).over(_earlier_chunks(keys)))
    for new, c in after.items():
        here[new] = F.first(c, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        heads.append(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_h_{new}"))
        across.append(F.first(f"_h_{new}", ignorenulls=True).over(_later_chunks(keys)))
    carried = src.groupBy(*keys, "_chunk").agg(*heads)
    carried = carried.select(*keys, "_chunk", *[c.alias(f"_c_{n}") for n, c in zip(here, across)])
    carried = carried.where(" or ".join(f"`_c_{n}` is not null" for n in here))
    local = src.select("*", *[c.alias(f"_l_{n}") for n, c in here.items()])
    return local.join(carried, [*keys, "_chunk"], "left").select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in here]
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
    once: bool = False,
) -> DataFrame:
    """Add to each left row the values of the latest right row of its key at or before its order.

    Both sides have the key and order columns; ``chunk`` is computed from them. A left row sees a
    right row with the same order. Inside a chunk one window over both sides finds the value. Every
    chunk of either side also learns the last right row of the chunks before it, and the rows meet that
    summary on key and chunk, so that no row is compared with more than one. With ``once`` the windowed rows
    are staged, which pays where the sides cost more to compute than to write.
    """
    names = left.columns
    packed = F.struct(*values)
    r = right.select(*keys, *order, F.lit(0).alias("_side"), packed.alias("_v"))
    r = r.withColumn("_chunk", chunk)
    both = left.withColumns(
        {"_side": F.lit(1), "_v": F.lit(None).cast(r.schema["_v"].dataType), "_chunk": chunk}
    ).unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order, "_side")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what the last row of a chunk sees is what the chunk hands on
    seen = both.withColumns({"_here": F.last("_v", ignorenulls=True).over(upto), "_more": F.lead("_side").over(inside)})
    seen = seen.where("_side = 1 or _more is null").drop("_v")
    if once:
        seen = staged(seen, "as-of")
    heads = seen.where("_more is null").select(*keys, "_chunk", F.col("_here").alias("_head"))
    before = F.last("_head", ignorenulls=True).over(_earlier_chunks(keys)).alias("_before")
    carried = heads.select(*keys, "_chunk", before).where("_before is not null")
    value = F.coalesce("_here", "_before")
    return seen.where("_side = 1").join(carried, [*keys, "_chunk"], "left").select(
        *names, *[value[v].alias(v) for v in values]
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """Number the rows of each key 1, 2, ... in order."""
    src = df.withColumn("_chunk", chunk)
    return _numbered(src, keys, order, name).select(*df.columns, name)


def number_all(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows of the frame 1, 2, ... in order.

    The rows are cut into ranges of about equal size, whatever their times are, and written once, so
    that the counts per range and the numbers inside the ranges see the same cut.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_chunk", F.spark_partition_id())
    return _numbered(staged(ranged, "ranges"), [], order, name).select(*df.columns, name)


def _numbered(src: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    offsets = (
        src.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_chunk", F.sum("_n").over(_earlier_chunks(keys)).alias("_offset"))
        .where("_offset is not null")
    )
    out = src.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_chunk"], "left")
    number = F.col("_rn").cast("long") + F.coalesce("_offset", F.lit(0).cast("long"))
    return out.withColumn(name, number)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, name: str
) -> DataFrame:
    """Add the running total of ``value`` over each key, current row included."""
    src = df.withColumn("_chunk", chunk)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        src.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_n"))
        .select(*keys, "_chunk", F.sum("_n").over(_earlier_chunks(keys)).alias("_offset"))
        .where("_offset is not null")
    )
    out = src.withColumn("_sum", F.sum(value).over(inside)).join(offsets, [*keys, "_chunk"], "left")
    return out.select(*df.columns, (F.col("_sum") + F.coalesce("_offset", F.lit(0))).alias(name))
