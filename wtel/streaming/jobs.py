"""Structured Streaming jobs over landed telemetry.

Every job takes a streaming frame and writes to ``out``; ``checkpoint`` keeps its progress. By default
a job takes what has landed and ends, so that it can be run again and again; pass another trigger to
keep it running at the collector's pace.

Jobs that compare polls write a part per micro-batch, which a repeated batch replaces; read them with
``parts``. What they remember lies beside the checkpoint as a table per batch (``state``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wtel.functions.ordered import with_previous_poll
from wtel.operators import changes, counters, layout, runs, workload
from wtel.sinks import versions
from wtel.sinks.staging import staged
from wtel.sources import logs, snapshots
from wtel.streaming.state import Kept, finished_apps, last_polls, last_starts, still_seen

# How often the collector polls and writes.
POLL_INTERVAL = "250 milliseconds"
NODE_POLL_INTERVAL = "500 milliseconds"
TAG_INTERVAL = "450 milliseconds"

LANDED = {"availableNow": True}
# A backlog is worked off in micro-batches of so many files.
MAX_FILES = 64
# Polls for which a source that sends nothing, or a finished application, is remembered.
HORIZON = 4 * 3600
# Batches after which the parts of query states are merged.
COMPACT_EVERY = 10


def landed(spark: SparkSession, path: str, schema, max_files: int = MAX_FILES) -> DataFrame:
    """Stream over the parquet files that arrive in a folder, at most ``max_files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _each(df: DataFrame, write: Callable, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**trigger)
        .start()
    )


def _part(df: DataFrame, out: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/part={number}")


def parts(spark: SparkSession, out: str) -> DataFrame:
    """All rows that a job has written by batch."""
    return spark.read.parquet(out).drop("part")


def _compared(
    docs: DataFrame, read: Callable, compare: Callable, keys: Sequence[str], source: Sequence[str],
    out: str, checkpoint: str, trigger: dict, horizon: int,
) -> StreamingQuery:
    """Rows of each batch compared with their previous poll by the batch helper, which cuts series into chunks.

    Only the last poll of each ``source`` is remembered: it is all that a later row can be compared with.
    """
    kept = Kept(checkpoint, "polls")

    def write(batch: DataFrame, number: int) -> None:
        own = read(batch)
        both = kept.with_remembered(own, number)
        compared = with_previous_poll(both, keys).where("not _remembered").drop("_remembered")
        _part(compare(compared), out, number)
        kept.remember(last_polls(both.drop("_remembered"), source, horizon), number)

    return _each(docs, write, checkpoint, trigger)


def cluster_changes(docs: DataFrame, out: str, checkpoint: str, trigger=LANDED) -> StreamingQuery:
    """Cluster fields as they change."""
    return _compared(docs, snapshots.read_cluster_metrics, changes.compare_cluster, [], [], out, checkpoint, trigger, HORIZON)


def app_changes(docs: DataFrame, out: str, checkpoint: str, trigger=LANDED) -> StreamingQuery:
    """Application fields as they change."""
    return _compared(docs, snapshots.read_apps, changes.compare_apps, ["id"], [], out, checkpoint, trigger, HORIZON)


def queue_changes(docs: DataFrame, out: str, checkpoint: str, trigger=LANDED) -> StreamingQuery:
    """Queue fields as they change."""
    read = lambda batch: changes.flat_queues(snapshots.read_queues(batch))
    return _compared(docs, read, changes.compare_queues, ["queueName"], [], out, checkpoint, trigger, HORIZON)


def node_app_changes(
    docs: DataFrame, first_poll: int, out: str, checkpoint: str, trigger=LANDED, horizon: int = HORIZON
) -> StreamingQuery:
    """Applications on nodes as they appear, get containers and finish.

    Nothing is written of an application that is finished at the first poll, nor behind the first poll
    that shows it finished. That poll holds for its whole micro-batch, and later ones remember it until the
    application was absent for ``horizon`` polls; should it come back after that, it is a new one.
    """
    kept, ended = Kept(checkpoint, "polls"), Kept(checkpoint, "finished")

    def write(batch: DataFrame, number: int) -> None:
        own = snapshots.read_node_apps(batch)
        finished = staged(finished_apps(own, ended.read(own.sparkSession, number)), "finished")
        ended.remember(still_seen(finished, own, horizon), number)
        live = own.join(finished.select("id", "finished"), "id", "left")
        live = live.where(F.expr(f"finished is null or (finished > {first_poll} and poll_no <= finished)")).select(*own.columns)
        both = kept.with_remembered(live, number)
        compared = with_previous_poll(both, ["node", "id"]).where("not _remembered").drop("_remembered")
        _part(changes.compare_node_apps(compared), out, number)
        kept.remember(last_polls(both.drop("_remembered"), ["node"], horizon), number)

    return _each(docs, write, checkpoint, trigger)


def container_changes(docs: DataFrame, out: str, checkpoint: str, trigger=LANDED, horizon: int = HORIZON) -> StreamingQuery:
    """Containers on nodes as they appear and change."""
    read = lambda batch: snapshots.read_containers(batch, ["poll_no", "record_time", "node"])
    return _compared(docs, read, changes.compare_containers, ["node", "id"], ["node"], out, checkpoint, trigger, horizon)


def _snapshot(df: DataFrame, out: str, checkpoint: str, trigger: dict, shape=None, by: Sequence[str] = ()) -> StreamingQuery:
    """Publish the whole current result after each batch; read it with ``versions.current``. Only for results of bounded size."""

    def write(batch: DataFrame, number: int) -> None:
        versions.publish(shape(batch) if shape else batch, out, number, by)

    return _each(df, write, checkpoint, trigger, "complete")


def tag_values(packets: DataFrame, prefix: str, out: str, checkpoint: str, trigger=LANDED) -> StreamingQuery:
    """Current counter totals and gauge values; as many rows as there are names."""
    values = counters.tag_values(logs.parse_statsd(packets, prefix))
    return _snapshot(values, out, checkpoint, trigger)


def registry_snapshot(
    packets: DataFrame, registry: DataFrame, prefix: str, out: str, checkpoint: str, trigger=LANDED
) -> StreamingQuery:
    """The tables of registered tags, renewed in every batch."""
    values = counters.tag_values(logs.parse_statsd(packets, prefix))
    return _snapshot(values, out, checkpoint, trigger, lambda batch: counters.current_tags(registry, batch))


def class_counts(log: DataFrame, out: str, checkpoint: str, trigger=LANDED) -> StreamingQuery:
    """How many queries of each class were seen so far; three rows."""
    return _snapshot(workload.class_counts(log), out, checkpoint, trigger)


def paired_events(
    events: DataFrame, out: str, checkpoint: str, trigger=LANDED, longest_ms: int | None = None
) -> StreamingQuery:
    """Completed events with their start.

    Remembered is the latest start of each run and level, until the run's workflow has completed or, with
    ``longest_ms``, until it lies so far behind the latest event.
    """
    kept = Kept(checkpoint, "starts")

    def write(batch: DataFrame, number: int) -> None:
        both = kept.with_remembered(batch, number)
        _part(runs.pair_events(both.drop("_remembered")), out, number)
        kept.remember(last_starts(both.drop("_remembered"), longest_ms), number)

    return _each(events, write, checkpoint, trigger)


def query_states(
    files: DataFrame, out: str, checkpoint: str, trigger=LANDED, every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Queries whose state changed, a part per batch; read them with ``latest_states``.

    After ``every`` batches the parts are merged into a base, which names the last batch in it.
    """
    root = out.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        _part(batch.withColumn("batch", F.lit(number)), root, number)
        if number % every == every - 1:
            compact_states(batch.sparkSession, root, number)

    return _each(layout.query_state(files), write, checkpoint, trigger, "update")


def _tail(spark: SparkSession, root: str, base: int | None) -> list[str]:
    """Folders of the parts that are not in the base."""
    found = {int(n.removeprefix("part=")): n for n in versions.names(spark, root) if n.startswith("part=")}
    return [f"{root}/{found[k]}" for k in sorted(found) if base is None or k > base]


def _with_base(spark: SparkSession, root: str) -> DataFrame:
    base = versions.latest(spark, f"{root}/base")
    schema = "top string, query_id string, state string, batch int"
    out = spark.createDataFrame([], schema) if base is None else versions.current(spark, f"{root}/base")
    tail = _tail(spark, root, base)
    return out.unionByName(spark.read.parquet(*tail).select(*out.columns)) if tail else out


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("top", "query_id").agg(F.max_by("state", "batch").alias("state"), F.max("batch").alias("batch"))


def compact_states(spark: SparkSession, out: str, number: int) -> None:
    """Merge base and parts up to batch ``number`` into a new base, then drop these parts.

    Parts go only after the new base is published, so that a reader always finds every state once at least.
    """
    root = out.rstrip("/")
    before = versions.latest(spark, f"{root}/base")
    if before is None or before < number:
        versions.publish(_newest(_with_base(spark, root)), f"{root}/base", number)
    for name in versions.names(spark, root):
        if name.startswith("part=") and int(name.removeprefix("part=")) <= number:
            versions.drop(spark, f"{root}/{name}")


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """Current state per query: the base and the parts behind it."""
    return _newest(_with_base(spark, out.rstrip("/"))).drop("batch")
