"""Registered queries over plans, runs, archives and record directories."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel.fixtures.views import view
from wtel.functions.text import full_table_name, joined_or_empty, last_alias
from wtel.functions.zones import archive_path
from wtel.operators import archive, layout, runs
from wtel.plans import plan_nodes, records
from wtel.sinks import tables
from wtel.sinks.staging import shared_folder, staged
from wtel.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
BASE = "/base/analyzed"
MAX_BYTES = 2_000_000


def _v(name: str) -> Query:
    return lambda s, d: view(s, d, name)


ops, attrs, aliases, stages = _v("plan_ops"), _v("op_attrs"), _v("stage_aliases"), _v("stages")
events, files = _v("lifecycle_events"), _v("query_files")


def _entries(s: SparkSession, d: str) -> DataFrame:
    return logs.parse_du_listing(view(s, d, "du_lines"), BASE)


def _before_now(s: SparkSession, d: str) -> DataFrame:
    """Entries as seen on the listing's last day."""
    now = _entries(s, d).agg(F.max("timestamp")).first()[0]
    return archive.exclude_today(_entries(s, d), now)


def _packed(s: SparkSession, d: str) -> DataFrame:
    return archive.pack_archives(_before_now(s, d), MAX_BYTES)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return archive.archive_manifest(_packed(s, d))


def _existing(manifest: DataFrame) -> DataFrame:
    return manifest.where("entry_count % 2 = 0").select("dest_path")


def _arc4(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d)
    existing = _existing(m)
    done = archive.already_archived(m, existing).withColumn("archived", F.lit(True))
    rest = archive.pending_archives(m, existing).withColumn("archived", F.lit(False))
    return done.unionByName(rest).select("day", "archive_no", "dest_path", "archived")


def _arc5(s: SparkSession, d: str) -> DataFrame:
    done = _manifest(s, d).withColumns(
        {
            "compressed_bytes": F.floor(F.col("total_bytes") / (F.col("entry_count") + 2)) + 1,
            "millis": F.col("entry_count") * 700,
        }
    )
    return archive.archive_report(done).select(
        "dest_path",
        F.round(F.col("compress_ratio").cast("double"), 3).alias("compress_ratio"),
        F.round("mb_per_sec", 3).alias("mb_per_sec"),
        F.col("size_shown").cast("long").alias("size_shown"),
        "unit",
    )


def _named_queries(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "orders_as_queries")


def _profile(s: SparkSession, d: str) -> DataFrame:
    record = plan_nodes.query_profile(
        _named_queries(s, d), ops(s, d), attrs(s, d), aliases(s, d), stages(s, d), view(s, d, "outputs"),
        view(s, d, "exceptions"), view(s, d, "lineage_edges"),
    )

    def size(c: str) -> F.Column:
        return F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).alias("n_" + c)

    comments = F.transform(
        F.flatten(F.transform("stages", lambda x: x["operators"])), lambda o: o["comment"]
    )
    return record.select(
        "query_id",
        "query_string",
        "end_time",
        size("stages"),
        size("edges"),
        size("const_filters"),
        F.array_join("tables", ",").alias("tables"),
        F.array_join(F.transform("stages", lambda x: x["join_type"]), ",").alias("join_types"),
        F.array_join(F.array_compact(comments), "\n").alias("comments"),
        F.array_join("roots", ",").alias("roots"),
        "stack",
        "details",
        "output_type",
        "named_output",
        "fail_code",
    )


def _records(s: SparkSession, d: str) -> DataFrame:
    """Whole query records, written as documents and read back."""
    known = staged(stages(s, d), "stages")
    times = runs.stage_end_times(known, view(s, d, "jobs")).select(
        "query_id", F.col("stageId").alias("stage_id"), "startTime", "endTime"
    )
    made = records.query_records(
        _named_queries(s, d), ops(s, d), attrs(s, d), aliases(s, d), known, view(s, d, "outputs"),
        view(s, d, "exceptions"), view(s, d, "lineage_edges"), view(s, d, "table_columns"), times,
    )
    state = F.when(F.get_json_object("record", "$.endTime").isNull(), "executing").otherwise("completed")
    root = f"{shared_folder(s).rstrip('/')}/records-{uuid.uuid4().hex}"
    tables.write_documents(made.withColumn("state", state), root)
    return records.read_records(tables.read_documents(s, root))


def _record_operators(s: SparkSession, d: str) -> DataFrame:
    return records.record_operators(_records(s, d)).select(
        F.col("queryId").cast("long").alias("query_id"), "stageId", "taskId", "operatorId", "operatorType", "parentId", "comment"
    )


def _record_stages(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.coalesce(c, F.array()), ",").alias(c)
    return records.record_stages(_records(s, d)).select(
        F.col("queryId").cast("long").alias("query_id"), "stageId", "stageType", "hadoopJobId", "isRoot", "joinType",
        text("dependentChildren"), text("conditionalChildren"), text("backupChildren"),
        F.size("hiveTaskInfos").alias("n_tasks"), F.coalesce(F.size("constFilters"), F.lit(0)).alias("n_filters"),
        F.array_join(F.transform("joinKeys", lambda k: F.concat_ws(".", k["tableAlias"], k["columnName"])), ",").alias("join_keys"),
    )


def _record_queries(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d)
    return rows.select(
        F.col("queryId").cast("long").alias("query_id"), "state", "queryString", "startTime", "endTime", "numMRJobs", "namedOutput",
        "outputType", "failRetCode", "failTID", "failJID", "failTaskKind", F.array_join("failExStack", "\n").alias("stack"),
        "version", "details", F.array_join(F.array_sort(F.map_keys("fullTableNameToInfos")), ",").alias("tables"),
    )


def _run_queries(s: SparkSession, d: str) -> DataFrame:
    """Starts of the numbered queries, with the run they belong to."""
    started = events(s, d).where("level = 'query' and kind = 'started'")
    ids = runs.assign_ids(events(s, d)).where("level = 'query'")
    return started.select("run", "key", F.col("ts").alias("start")).join(ids.drop("level"), "key")


def _run_table(name: str) -> Query:
    return lambda s, d: runs.run_tables(events(s, d))[name]


def _written(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = runs.run_tables(events(s, d))
    # the newest workflow is still running, so its own row is not written yet
    newest = t["workflows"].agg(F.max("wid").alias("wid"))
    return t["workflows"].join(newest, "wid", "left_anti"), t["components"], t["executedQueries"]


QUERIES: dict[str, Query] = {
    "src9_parse_du_listing": _entries,
    "src9_rejected_du_lines": lambda s, d: logs.rejected_du_lines(view(s, d, "du_lines"), BASE),
    "src10_read_query_info": lambda s, d: logs.query_info_stages(
        logs.read_query_info(view(s, d, "query_docs"))
    ),
    "src11_stage_completed": lambda s, d: logs.stage_completed(view(s, d, "event_lines")),
    "src11_job_start": lambda s, d: logs.job_start(view(s, d, "event_lines")).select(
        "app", "jobId", "startTime",
        F.array_join(F.col("stageIds").cast("array<string>"), ",").alias("stageIds"),
    ),
    "prj3_last_alias": lambda s, d: aliases(s, d).select(
        "query_id", "alias", last_alias("alias").alias("last_alias")
    ),
    "prj4_full_table_name": lambda s, d: view(s, d, "outputs").select(
        "query_id", "seq", full_table_name("db", "target").alias("full_name")
    ),
    "prj5_archive_path": lambda s, d: _entries(s, d).select(
        "path", archive_path("timestamp", F.col("timestamp") + 5_400_000).alias("archive_path")
    ),
    "prj6_dependent_children": lambda s, d: stages(s, d).select(
        "query_id", "stage_id", joined_or_empty("children").alias("dependentChildren"),
        F.coalesce("job_id", F.lit("")).alias("hadoopJobId"),
    ),
    "flt3_const_filters": lambda s, d: plan_nodes.const_filters(ops(s, d), attrs(s, d), aliases(s, d)),
    "flt4_mapred_stages": lambda s, d: plan_nodes.mapred_stages(stages(s, d)).select(
        "query_id", "stage_id"
    ),
    "flt5_complete_stages": lambda s, d: plan_nodes.complete_stages(stages(s, d)).select(
        "query_id", "stage_id", "job_id"
    ),
    "flt7_exclude_today": lambda s, d: _before_now(s, d).select("path", "day"),
    "jn1_resolve_alias": lambda s, d: plan_nodes.resolve_alias(
        attrs(s, d).where("kind = 'column'"), aliases(s, d)
    ).select("query_id", "stage_id", "op_id", "attr", "pos", "alias", "value", "full_table"),
    "jn3_stage_to_job": lambda s, d: runs.stage_to_job(
        logs.stage_completed(view(s, d, "event_lines")), logs.job_start(view(s, d, "event_lines"))
    ),
    "jn4_attribute_to_query": lambda s, d: runs.attribute_to_query(
        view(s, d, "run_stages"), _run_queries(s, d)
    ),
    "jn5_stage_job_start": lambda s, d: runs.stage_job_start(stages(s, d), view(s, d, "jobs")).select(
        "query_id", "stage_id", "job_id", "job_start"
    ),
    "jn8_root_stages": lambda s, d: plan_nodes.root_stages(stages(s, d)),
    "jn9_stage_edges": lambda s, d: plan_nodes.stage_edges(stages(s, d)),
    "jn10_reachable_stages": lambda s, d: plan_nodes.reachable_stages(
        stages(s, d), plan_nodes.root_stages(stages(s, d))
    ),
    "agg5_last_ids": lambda s, d: runs.last_ids(*_written(s, d)),
    "agg6_current_query_id": lambda s, d: runs.current_query_id(*_written(s, d)),
    "agg7_stages_with_common_join": lambda s, d: plan_nodes.stages_with_common_join(ops(s, d)),
    "agg8_stages_with_map_join": lambda s, d: plan_nodes.stages_with_map_join(ops(s, d)),
    "agg9_stages_with_map_aggregation": lambda s, d: plan_nodes.stages_with_map_aggregation(
        ops(s, d)
    ),
    "agg10_table_profile": lambda s, d: plan_nodes.table_profile(view(s, d, "table_columns")),
    "agg11_stage_keys": lambda s, d: plan_nodes.stage_keys(ops(s, d), attrs(s, d)),
    "agg12_named_output": lambda s, d: plan_nodes.named_output(
        _named_queries(s, d), view(s, d, "outputs")
    ),
    "agg13_failure_summary": lambda s, d: plan_nodes.failure_summary(stages(s, d)),
    "agg14_error_chain": lambda s, d: plan_nodes.error_chain(view(s, d, "exceptions")),
    "agg15_labelled_comment": lambda s, d: plan_nodes.attribute_comment(attrs(s, d)),
    "agg16_log_dir_valid": lambda s, d: layout.log_dir_valid(files(s, d)),
    "agg17_query_state": lambda s, d: layout.query_state(files(s, d)),
    "agg18_lineage_report": lambda s, d: plan_nodes.lineage_report(view(s, d, "lineage_edges")),
    "win1_assign_ids": lambda s, d: runs.assign_ids(events(s, d), last_wid=7),
    "win2_pair_events": lambda s, d: runs.pair_events(events(s, d)),
    "win3_stage_end_times": lambda s, d: runs.stage_end_times(stages(s, d), view(s, d, "jobs")).drop(
        "stage_no"
    ),
    "tbl_workflows": _run_table("workflows"),
    "tbl_components": _run_table("components"),
    "tbl_executed_queries": _run_table("executedQueries"),
    "arc1_sort_logsets": lambda s, d: archive.sort_logsets(_entries(s, d)),
    "arc2_pack_archives": lambda s, d: _packed(s, d).select("path", "day", "archive_no"),
    "arc2_pack_archives_by_joins": lambda s, d: archive.pack_archives(
        _before_now(s, d), MAX_BYTES, by_joins=True
    ).select("path", "day", "archive_no"),
    "arc3_archive_manifest": _manifest,
    "arc4_already_archived": _arc4,
    "arc5_archive_report": _arc5,
    "pln1_plan_nodes": lambda s, d: plan_nodes.plan_nodes(ops(s, d)),
    "pln2_operator_comment": lambda s, d: plan_nodes.operator_comment(ops(s, d), attrs(s, d)),
    "pln3_query_profile": _profile,
    "src10_record_operators": _record_operators,
    "src10_record_stages": _record_stages,
    "src10_record_queries": _record_queries,
    "pln4_preferred_record": lambda s, d: layout.preferred_record(files(s, d)),
}
