"""Registered queries over snapshots, change capture, packets and the query log."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel import schemas
from wtel.fixtures.views import view
from wtel.operators import changes, counters, workload
from wtel.sinks import tables
from wtel.sinks.staging import shared_folder
from wtel.sources import logs, snapshots

Query = Callable[[SparkSession, str], DataFrame]
PREFIX = "my.prefix"


def _cluster(s: SparkSession, d: str) -> DataFrame:
    return snapshots.read_cluster_metrics(view(s, d, "cluster_docs"))


def _apps(s: SparkSession, d: str) -> DataFrame:
    return snapshots.read_apps(view(s, d, "apps_docs"))


def _queues(s: SparkSession, d: str) -> DataFrame:
    return snapshots.read_queues(view(s, d, "scheduler_docs"))


def _node_apps(s: SparkSession, d: str) -> DataFrame:
    return snapshots.read_node_apps(view(s, d, "node_apps_docs"))


def _containers(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "container_docs")
    return snapshots.read_containers(docs, ["poll_no", "record_time", "node"])


def _packets(s: SparkSession, d: str) -> DataFrame:
    return logs.parse_statsd(view(s, d, "packets"), PREFIX)


def _log(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "query_log")


def _src3(s: SparkSession, d: str) -> DataFrame:
    return _queues(s, d).select(
        "poll_no", "record_time", "queueName", "state", "usedResources", "capacity", "usedCapacity",
        "numApplications", "numActiveApplications", "numContainers", "maxApplications",
        F.col("resourcesUsed.memory").alias("used_memory"),
        F.col("resourcesUsed.vCores").alias("used_vcores"),
    )


def _snk4(s: SparkSession, d: str) -> DataFrame:
    """The tag tables after two snapshots: the registered tags with 0, then their current values."""
    root = f"{shared_folder(s).rstrip('/')}/tags-{uuid.uuid4().hex}"
    registry = view(s, d, "registry")
    tables.write_tags(tables.initial_tags(registry), root)
    tables.write_tags(counters.current_tags(registry, counters.tag_values(_packets(s, d))), root)
    return tables.read_tags(s, root).select("table_name", "tag", "value")


def _snk3(s: SparkSession, d: str) -> DataFrame:
    """Rows of a metric table after they were appended to it."""
    long_value = F.repeat(F.concat("id", F.lit(";")), 20)
    rows = _containers(s, d).select(
        F.col("node").alias("nodeAddress"), F.col("id").alias("containerId"),
        F.lit("diagnostics").alias("MetricsName"), F.col("record_time").alias("RecordTime"),
        long_value.alias("Value"),
    )
    root, name = f"{shared_folder(s).rstrip('/')}/metrics-{uuid.uuid4().hex}", "nodes_containers_metrics"
    tables.append_metric(rows, root, name)
    return s.read.schema(schemas.TABLES[name]).parquet(tables.table_path(root, name))


QUERIES: dict[str, Query] = {
    "src1_read_cluster_metrics": _cluster,
    "src2_read_apps": _apps,
    "src3_read_queues": _src3,
    "src4_read_nodes": lambda s, d: snapshots.read_nodes(view(s, d, "nodes_docs")),
    "src5_read_node_apps": lambda s, d: _node_apps(s, d).select(
        "poll_no", "record_time", "node", "id", F.col("user").alias("user_name"), "state",
        F.array_join("containerids", ",").alias("containers"),
    ),
    "src6_read_containers": lambda s, d: snapshots.read_containers(
        view(s, d, "container_docs").drop("record_time")
    ).withColumnRenamed("user", "user_name"),
    "src7_scan_query_log": lambda s, d: logs.scan_query_log(
        _log(s, d), "1997-01-01", "1998-12-31"
    ).select("query_id", "query_string"),
    "src8_parse_statsd": _packets,
    "snk3_append_metric": _snk3,
    "snk4_upsert_tags": _snk4,
    "prj1_to_long_metrics": lambda s, d: changes.to_long_metrics(
        _apps(s, d).withColumn("AppId", F.col("id")), ["AppId"], changes.APP_FIELDS
    ),
    "prj2_selected_app_metrics": lambda s, d: changes.selected_app_metrics(_node_apps(s, d)),
    "prj2_selected_container_metrics": lambda s, d: changes.selected_container_metrics(
        _containers(s, d)
    ),
    "flt1_classify_query": lambda s, d: workload.classify(_log(s, d)).select("query_id", "class"),
    "flt2_explain_rewrite": lambda s, d: workload.explain_rewrite(_log(s, d)).select(
        "query_id", "query_string"
    ),
    "flt6_suppress_finished": lambda s, d: changes.suppress_finished(_node_apps(s, d)).select(
        "poll_no", "node", "id", "state"
    ),
    "jn6_container_delta": lambda s, d: changes.container_delta(_node_apps(s, d)),
    "jn7_registry_values": lambda s, d: counters.registry_values(
        view(s, d, "registry"), counters.tag_values(_packets(s, d))
    ),
    "agg1_counter_totals": lambda s, d: counters.counter_totals(_packets(s, d)),
    "agg1_counter_totals_first_counts_one": lambda s, d: counters.counter_totals(
        _packets(s, d), first_counts_one=True
    ),
    "agg2_gauge_latest": lambda s, d: counters.gauge_latest(_packets(s, d)),
    "agg3_scheduler_totals": lambda s, d: counters.scheduler_totals(_queues(s, d)),
    "agg4_class_counts": lambda s, d: workload.class_counts(_log(s, d)),
    "sem1_queries": lambda s, d: workload.register_queries(_log(s, d), last_id=100),
    "win4_cluster_changes": lambda s, d: changes.cluster_changes(_cluster(s, d)),
    "win5_app_changes": lambda s, d: changes.app_changes(_apps(s, d)),
    "win6_queue_changes": lambda s, d: changes.queue_changes(_queues(s, d)),
    "win7_node_app_changes": lambda s, d: changes.node_app_changes(_node_apps(s, d)),
    "win8_container_changes": lambda s, d: changes.container_changes(_containers(s, d)),
}
