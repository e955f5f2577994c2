"""What changed between two polls of the cluster.

"Previous" always means the previous poll: an entity that was absent from it counts as new.
Rows are compared while still wide, and only changed fields are unfolded into long rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel import schemas
from wtel.functions.ordered import POLL_CHUNK, with_previous_poll

CLUSTER_FIELDS = schemas.names(schemas.CLUSTER)
APP_FIELDS = schemas.names(schemas.APP)
QUEUE_FIELDS = [n for n in schemas.names(schemas.QUEUE) if n != "resourcesUsed"]
CONTAINER_FIELDS = schemas.names(schemas.CONTAINER)
# What is written for a new container, and what is never compared.
NEW_CONTAINER_FIELDS = ["nodeId", "totalMemoryNeededMB", "totalVCoresNeeded", "state", "user"]
UNCOMPARED_CONTAINER_FIELDS = ["exitCode", "containerLogsLink"]


def to_long_metrics(df: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Every field as ``(ids, MetricsName, RecordTime, Value)``; a null value is the text ``null``."""
    text = df.select(
        *ids,
        F.col("record_time").alias("RecordTime"),
        *[F.coalesce(F.col(f).cast("string"), F.lit("null")).alias(f) for f in fields],
    )
    return text.unpivot([*ids, "RecordTime"], list(fields), "MetricsName", "Value").select(
        *ids, "MetricsName", "RecordTime", "Value"
    )


def _unfold(df: DataFrame, ids: Sequence[str], entries: Column) -> DataFrame:
    """Long rows from an array of (MetricsName, Value) whose nulls mean "not written"."""
    rows = df.select(*ids, F.col("record_time").alias("RecordTime"), F.explode(entries).alias("_e"))
    return rows.where("_e is not null").select(*ids, "_e.MetricsName", "RecordTime", "_e.Value")


def _entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("MetricsName"), value.cast("string").alias("Value"))


def _both_and_differ(new: Column, old: Column) -> Column:
    return new.isNotNull() & old.isNotNull() & (new != old)


def cluster_changes(
    polls: DataFrame, keys: Sequence[str] = (), chunk: int = POLL_CHUNK
) -> DataFrame:
    """Cluster fields that differ from the previous poll; the first poll gives no rows."""
    return compare_cluster(with_previous_poll(polls, keys, chunk=chunk), keys)


def compare_cluster(both: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``cluster_changes`` of rows that carry their previous row in ``prev``."""
    both = both.where("prev is not null")
    entries = F.array(
        *[
            F.when(_both_and_differ(F.col(f), F.col("prev")[f]), _entry(f, F.col(f)))
            for f in CLUSTER_FIELDS
        ]
    )
    return _unfold(both, keys, entries)


def app_changes(apps: DataFrame, chunk: int = POLL_CHUNK) -> DataFrame:
    """A new application gives all its fields; a known one the changed fields and its elapsed time.

    A value that becomes null is not a change; a null that becomes a value is.
    """
    return compare_apps(with_previous_poll(apps, ["id"], chunk=chunk))


def compare_apps(both: DataFrame) -> DataFrame:
    """``app_changes`` of rows that carry their previous row in ``prev``."""
    is_new = F.col("prev").isNull()
    compared = [f for f in APP_FIELDS if f != "elapsedTime"]

    def differs(f: str) -> Column:
        if f == "id":
            return F.lit(False)
        new, old = F.col(f), F.col("prev")[f]
        return new.isNotNull() & (old.isNull() | (new != old))

    changed = F.array(*[F.when(differs(f), _entry(f, F.col(f))) for f in compared])
    all_fields = F.array(
        *[_entry(f, F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in APP_FIELDS]
    )
    some = F.exists("_changed", lambda e: e.isNotNull())
    elapsed = F.array(F.when(some, _entry("elapsedTime", F.col("elapsedTime"))))
    rows = both.withColumns({"AppId": F.col("id"), "_is_new": is_new, "_changed": changed})
    # unchanged rows get no array at all; a filter on all the fields would cost the optimizer dear
    entries = F.when(F.col("_is_new"), all_fields).when(some, F.concat("_changed", elapsed))
    return _unfold(rows, ["AppId"], entries)


def queue_changes(queues: DataFrame, chunk: int = POLL_CHUNK) -> DataFrame:
    """Queue fields present in both polls and different, used resources as two fields of their own."""
    return compare_queues(with_previous_poll(flat_queues(queues), ["queueName"], chunk=chunk))


def flat_queues(queues: DataFrame) -> DataFrame:
    return queues.select(
        "poll_no",
        "record_time",
        *QUEUE_FIELDS,
        F.col("resourcesUsed.memory").alias("resourcesUsed_memory"),
        F.col("resourcesUsed.vCores").alias("resourcesUsed_vCores"),
    )


def compare_queues(both: DataFrame) -> DataFrame:
    """``queue_changes`` of flat rows that carry their previous row in ``prev``."""
    both = both.where("prev is not null")
    fields = [f for f in QUEUE_FIELDS if f != "queueName"]
    fields += ["resourcesUsed_memory", "resourcesUsed_vCores"]
    entries = F.array(
        *[F.when(_both_and_differ(F.col(f), F.col("prev")[f]), _entry(f, F.col(f))) for f in fields]
    )
    return _unfold(both.withColumn("QueueName", F.col("queueName")), ["QueueName"], entries)


def app_entries() -> Column:
    """State, user and one entry per container id of a node application."""
    fixed = F.array(_entry("state", F.col("state")), _entry("user", F.col("user")))
    ids = F.coalesce(F.col("containerids"), F.array().cast("array<string>"))
    return F.concat(fixed, F.transform(ids, lambda c: _entry("containerId", c)))


def container_entries() -> Column:
    return F.array(*[_entry(f, F.col(f)) for f in NEW_CONTAINER_FIELDS])


def selected_app_metrics(apps: DataFrame) -> DataFrame:
    """What is written when an application is first seen on a node."""
    rows = apps.select(
        F.col("node").alias("nodeAddress"), F.col("id").alias("appId"), "record_time",
        "state", "user", "containerids",
    )
    return _unfold(rows, ["nodeAddress", "appId"], app_entries())


def selected_container_metrics(containers: DataFrame) -> DataFrame:
    """What is written when a container is first seen on a node."""
    rows = containers.withColumns({"nodeAddress": F.col("node"), "containerId": F.col("id")})
    return _unfold(rows, ["nodeAddress", "containerId"], container_entries())


def new_containers(old: Column, new: Column) -> Column:
    """Container ids to write for a known application.

    None if there are none now; all of them if there were none before or the count differs;
    otherwise those that were not there before, repeats included.
    """
    none = F.array().cast("array<string>")
    fresh = F.filter(new, lambda c: ~F.array_contains(old, c))
    return (
        F.when(new.isNull(), none)
        .when(old.isNull() | (F.size(old) == 0) | (F.size(old) != F.size(new)), new)
        .otherwise(fresh)
    )


def container_delta(apps: DataFrame, chunk: int = POLL_CHUNK) -> DataFrame:
    """New container ids of applications that were also there in the previous poll."""
    both = with_previous_poll(apps, ["node", "id"], chunk=chunk).where("prev is not null")
    ids = new_containers(F.col("prev.containerids"), F.col("containerids"))
    rows = both.withColumns({"nodeAddress": F.col("node"), "appId": F.col("id")})
    entries = F.transform(ids, lambda c: _entry("containerId", c))
    return _unfold(rows, ["nodeAddress", "appId"], entries)


def suppress_finished(apps: DataFrame, first_poll: int | None = None) -> DataFrame:
    """Leave out applications already finished at the first poll, and polls after the first FINISHED.

    The rule is per application id, across nodes. Without ``first_poll`` it is the smallest one.
    """
    finished = (
        apps.where("state = 'FINISHED'").groupBy("id").agg(F.min("poll_no").alias("_fin"))
    )
    if first_poll is None:
        first = apps.agg(F.min("poll_no")).scalar()
    else:
        first = F.lit(first_poll)
    finished = finished.withColumn("_first", first)
    return (
        apps.join(finished, "id", "left")
        .where("_fin is null or (_fin > _first and poll_no <= _fin)")
        .select(*apps.columns)
    )


def node_app_changes(
    apps: DataFrame, first_poll: int | None = None, chunk: int = POLL_CHUNK
) -> DataFrame:
    """New on a node, or finished: state, user and containers. Otherwise new containers only."""
    return compare_node_apps(
        with_previous_poll(suppress_finished(apps, first_poll), ["node", "id"], chunk=chunk)
    )


def compare_node_apps(both: DataFrame) -> DataFrame:
    """``node_app_changes`` of rows that carry their previous row in ``prev``."""
    in_full = F.col("prev").isNull() | (F.col("state") == "FINISHED")
    fresh = new_containers(F.col("prev.containerids"), F.col("containerids"))
    entries = F.when(in_full, app_entries()).otherwise(
        F.transform(fresh, lambda c: _entry("containerId", c))
    )
    rows = both.withColumns({"nodeAddress": F.col("node"), "appId": F.col("id")})
    return _unfold(rows, ["nodeAddress", "appId"], entries)


def container_changes(containers: DataFrame, chunk: int = POLL_CHUNK) -> DataFrame:
    """New on a node: the selected fields. Otherwise fields that differ, bar the uncompared ones."""
    return compare_containers(with_previous_poll(containers, ["node", "id"], chunk=chunk))


def compare_containers(both: DataFrame) -> DataFrame:
    """``container_changes`` of rows that carry their previous row in ``prev``."""
    compared = [f for f in CONTAINER_FIELDS if f not in UNCOMPARED_CONTAINER_FIELDS and f != "id"]
    changed = F.array(
        *[F.when(_both_and_differ(F.col(f), F.col("prev")[f]), _entry(f, F.col(f))) for f in compared]
    )
    entries = F.when(F.col("prev").isNull(), container_entries()).otherwise(changed)
    rows = both.withColumns({"nodeAddress": F.col("node"), "containerId": F.col("id")})
    return _unfold(rows, ["nodeAddress", "containerId"], entries)
