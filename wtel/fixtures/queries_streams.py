"""Registered streaming jobs: the derived input lands in two parts, the job runs after each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel import schemas
from wtel.fixtures.queries_polls import PREFIX
from wtel.fixtures.views import view
from wtel.operators import runs
from wtel.sinks import tables, versions
from wtel.sinks.staging import shared_folder
from wtel.sources import logs
from wtel.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(s: SparkSession, rows: DataFrame, order: str, start: Callable) -> str:
    """Land the rows in two parts by the order column and run the job after each; gives its output.

    A stream keeps the number of state partitions it starts with: here one per core.
    """
    setting = "spark.sql.shuffle.partitions"
    given = s.conf.get(setting)
    s.conf.set(setting, str(min(int(given), s.sparkContext.defaultParallelism)))
    try:
        return _replay(s, rows, order, start)
    finally:
        s.conf.set(setting, given)


def _replay(s: SparkSession, rows: DataFrame, order: str, start: Callable) -> str:
    root = folder(s, "stream")
    landing, out, checkpoint = (f"{root}/{d}" for d in ("landing", "out", "checkpoint"))
    # looked up once: an approximate middle depends on the order in which partial results meet
    middle = rows.agg(F.percentile_approx(order, 0.5)).first()[0]
    early = F.coalesce(F.col(order) <= F.lit(middle), F.lit(False))
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(landing)
        # the files of one landing are in no order, so they are one micro-batch and no poll is split
        files = len(versions.names(s, landing))
        query = start(jobs.landed(s, landing, rows.schema, max_files=files), out, checkpoint)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return out


def _job(name: str, order: str, job: Callable, read: Callable = jobs.parts) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return read(s, replay(s, view(s, d, name), order, job))

    return run


def _str2_apps(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "node_apps_docs")
    first = docs.agg(F.min("poll_no")).first()[0]
    out = replay(
        s, docs, "poll_no", lambda df, o, c: jobs.node_app_changes(df, first, o, c)
    )
    return jobs.parts(s, out)


def _str3(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        job = lambda df, o, c: jobs.tag_values(df, PREFIX, o, c)
        rows = versions.current(s, replay(s, view(s, d, "packets"), "seq", job))
        return rows.where(F.col("table_name") == kind).select(F.col("tag").alias("name"), "value")

    return run


def _str4(s: SparkSession, d: str) -> DataFrame:
    registry = view(s, d, "registry")
    job = lambda df, o, c: jobs.registry_snapshot(df, registry, PREFIX, o, c)
    return versions.current(s, replay(s, view(s, d, "packets"), "seq", job))


def _str7(s: SparkSession, d: str) -> DataFrame:
    files = view(s, d, "query_files").withColumn("seq", F.length("state") + F.length("file"))
    return jobs.latest_states(s, replay(s, files, "seq", jobs.query_states))


def _snk1(s: SparkSession, d: str) -> DataFrame:
    """Create the fact tables, fill one from the tables, and count the rows of each."""
    root = folder(s, "tables")
    tables.ensure_tables(s, root)
    log = view(s, d, "query_log").select(
        F.col("query_id").alias("queryId"), F.col("query_string").alias("queryString")
    )
    tables.append_rows(log, root, "queries")
    tables.ensure_tables(s, root)
    counts = [
        tables.read_table(s, root, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t in schemas.TABLES
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _snk2(s: SparkSession, d: str) -> DataFrame:
    """Rows of the query log after two appends to the ``queries`` table."""
    root = folder(s, "tables")
    log = view(s, d, "query_log").select(
        F.col("query_id").alias("queryId"), F.col("query_string").alias("queryString")
    )
    for batch, rest in (("a", 0), ("b", 1), ("a", 0)):  # one append is repeated, as after a failure
        tables.append_rows(log.where(F.col("queryId") % 2 == rest), root, "queries", batch=batch)
    return tables.read_table(s, root, "queries")


def _stored(s: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows of a fact table after they were appended to it."""
    root = folder(s, "tables")
    tables.append_rows(rows, root, name)
    return tables.read_table(s, root, name)


def _run_queries(s: SparkSession, d: str) -> DataFrame:
    events = view(s, d, "lifecycle_events")
    started = events.where("level = 'query' and kind = 'started'")
    ids = runs.assign_ids(events).where("level = 'query'")
    return started.select("run", "key", F.col("ts").alias("start")).join(ids.drop("level"), "key")


def _spark_stages(s: SparkSession, d: str) -> DataFrame:
    lines = view(s, d, "event_lines")
    run = F.substring("app", 4, 10).cast("long")  # each application belongs to a run
    stages = runs.stage_to_job(logs.stage_completed(lines), logs.job_start(lines)).withColumn("run", run)
    return _stored(s, runs.spark_stages(stages, _run_queries(s, d)), "sparkStages")


def _hive_stages(s: SparkSession, d: str) -> DataFrame:
    first = _run_queries(s, d).where("key % 100 = 1")  # a component's first query
    ids = first.select(F.floor(F.col("key") / 100).alias("query_id"), "wid", "cid", "qid")
    times = runs.stage_end_times(view(s, d, "stages"), view(s, d, "jobs"))
    return _stored(s, runs.hive_stages(times, ids), "hiveStages")


def _snk5(s: SparkSession, d: str) -> DataFrame:
    """Query records as written, read back from their files."""
    root = folder(s, "records")
    files = view(s, d, "query_files").where("file like 'Hive%'")
    path = tables.record_path("top", "state", "query_id", F.col("file") == tables.PRELIMINARY_FILE)
    records = files.select(
        "state", F.col("query_id").alias("queryId"), path.alias("path"), F.col("record").alias("queryString")
    )
    tables.write_query_info(records, root)
    rows = s.read.schema("path string, record string, state string").json(root)
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return rows.select(
        field("queryId").alias("query_id"), "state", "path", field("queryString").alias("record")
    )


QUERIES: dict[str, Query] = {
    "snk5_write_query_info": _snk5,
    "tbl_spark_stages": _spark_stages,
    "tbl_hive_stages": _hive_stages,
    "snk1_ensure_tables": _snk1,
    "snk2_append_rows": _snk2,
    "str1_cluster_changes": _job("cluster_docs", "poll_no", jobs.cluster_changes),
    "str1_app_changes": _job("apps_docs", "poll_no", jobs.app_changes),
    "str1_queue_changes": _job("scheduler_docs", "poll_no", jobs.queue_changes),
    "str2_node_app_changes": _str2_apps,
    "str2_container_changes": _job("container_docs", "poll_no", jobs.container_changes),
    "str3_counters": _str3("counts"),
    "str3_gauges": _str3("gauges"),
    "str4_registry_snapshot": _str4,
    "str5_class_counts": _job("query_log", "start_time", jobs.class_counts, versions.current),
    "str6_paired_events": _job("lifecycle_events", "ts", jobs.paired_events),
    "str7_query_states": _str7,
}

# A stream must give what its batch twin gives.
TWINS = {
    "str1_cluster_changes": "win4_cluster_changes",
    "str1_app_changes": "win5_app_changes",
    "str1_queue_changes": "win6_queue_changes",
    "str2_node_app_changes": "win7_node_app_changes",
    "str2_container_changes": "win8_container_changes",
    "str3_counters": "agg1_counter_totals",
    "str3_gauges": "agg2_gauge_latest",
    "str4_registry_snapshot": "snk4_upsert_tags",
    "str5_class_counts": "agg4_class_counts",
    "str6_paired_events": "win2_pair_events",
    "str7_query_states": "agg17_query_state",
}
