"""What a job remembers between micro-batches.

A poll is only ever compared with the poll before it, and a completed event only with the latest start,
so a job need not keep state per key in a store: it keeps a small table, written once per batch. Rows
of one key are never gathered; they go through the same chunked helpers as in batch. A poll
must not be split over micro-batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel.sinks import versions


class Kept:
    """A table beside a job's checkpoint, a version per batch.

    Batch n reads the version of batch n - 1 and writes its own, so a batch that is repeated after a
    failure finds what it found before.
    """

    def __init__(self, checkpoint: str, name: str):
        self.path = f"{checkpoint.rstrip('/')}-{name}"

    def read(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The table as batch ``number`` finds it; none for the first."""
        return versions.read(spark, self.path, number - 1) if number else None

    def remember(self, rows: DataFrame, number: int) -> None:
        versions.publish(rows, self.path, number, replace=True)

    def with_remembered(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows and those remembered, told apart by ``_remembered``."""
        own = rows.withColumn("_remembered", F.lit(False))
        before = self.read(rows.sparkSession, number)
        return own if before is None else own.unionByName(before.withColumn("_remembered", F.lit(True)))


def last_polls(rows: DataFrame, source: Sequence[str], horizon: int) -> DataFrame:
    """Rows of the last poll of each source, unless it lies ``horizon`` polls behind the latest one.

    ``source`` names what is polled on its own, as a node; without it all rows come from one.
    """
    last = rows.groupBy(*source).agg(F.max("poll_no").alias("_last"))
    latest = rows.agg((F.max("poll_no") - horizon).alias("_least"))
    near = last.join(F.broadcast(latest), F.col("_last") > F.col("_least")).drop("_least")
    same = F.col("poll_no") == F.col("_last")
    for c in source:
        same = same & rows[c].eqNullSafe(near[c])
    return rows.join(near, same, "left_semi")


def finished_apps(apps: DataFrame, before: DataFrame | None) -> DataFrame:
    """id, finished (first poll that shows it) and seen (last poll with it) of finished applications."""
    seen = apps.groupBy("id").agg(
        F.min(F.when(F.col("state") == "FINISHED", F.col("poll_no"))).alias("finished"), F.max("poll_no").alias("seen")
    )
    if before is not None:
        seen = seen.unionByName(before).groupBy("id").agg(F.min("finished").alias("finished"), F.max("seen").alias("seen"))
    return seen.where("finished is not null")


def still_seen(finished: DataFrame, apps: DataFrame, horizon: int) -> DataFrame:
    """Those of ``finished_apps`` whose last poll lies less than ``horizon`` polls behind the latest one."""
    polls = finished.select("seen").unionByName(apps.select(F.col("poll_no").alias("seen")))
    latest = polls.agg((F.max("seen") - horizon).alias("_least"))
    return finished.join(F.broadcast(latest), F.col("seen") > F.col("_least")).drop("_least")


def last_starts(events: DataFrame, longest_ms: int | None) -> DataFrame:
    """The latest start of each run and level whose run goes on, and that is not too old."""
    started = F.when(F.col("kind") == "started", F.struct("ts", "key"))
    rest = [c for c in events.columns if c not in ("run", "level")]
    starts = events.groupBy("run", "level").agg(F.max_by(F.struct(*rest), started).alias("_start"))
    starts = starts.where("_start is not null").select("run", "level", "_start.*").select(*events.columns)
    ended = events.where("level = 'workflow' and kind = 'completed'").groupBy("run").agg(F.max("ts").alias("_ended"))
    live = starts.join(ended, "run", "left").where("_ended is null or ts > _ended").drop("_ended")
    if longest_ms is None:
        return live
    latest = events.agg((F.max("ts") - longest_ms).alias("_least"))
    return live.join(F.broadcast(latest), F.col("ts") > F.col("_least")).drop("_least")
