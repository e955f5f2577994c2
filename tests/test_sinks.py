"""Writers, staging, pushdown and a real event log."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from wtel import schemas
from wtel.fixtures import queries_polls
from wtel.operators import runs
from wtel.sinks import staging, tables
from wtel.sources import logs


def test_ensure_append_and_reject(spark, tmp_path):
    root = str(tmp_path)
    tables.ensure_tables(spark, root)
    rows = spark.createDataFrame([("q", 1)], "queryString string, queryId long")
    tables.append_rows(rows, root, "queries")
    tables.ensure_tables(spark, root)
    stored = spark.read.schema(schemas.TABLES["queries"]).parquet(tables.table_path(root, "queries"))
    assert [tuple(r) for r in stored.collect()] == [(1, "q")]
    assert len(os.listdir(root)) == 16
    with pytest.raises(Exception):
        tables.append_rows(rows.withColumn("queryId", F.lit("x")), root, "queries")
    missing = rows.drop("queryId")
    stored_missing = tables.conform(missing, "queries")
    assert stored_missing.columns == ["queryId", "queryString"]


def test_container_values_are_whole_unless_asked(spark, tmp_path):
    row = [("n", "c", "diagnostics", 1, "x" * 300), ("n", "c", "state", 1, "y" * 255)]
    df = spark.createDataFrame(
        row, "nodeAddress string, containerId string, MetricsName string, RecordTime long, Value string"
    )
    for folder, longest, sizes in (("whole", None, [255, 300]), ("cut", 255, [255, 255])):
        root = str(tmp_path / folder)
        tables.append_metric(df, root, "nodes_containers_metrics", longest=longest)
        got = spark.read.parquet(f"{root}/nodes_containers_metrics").collect()
        assert sorted(len(r.Value) for r in got) == sizes


def test_metric_query_reads_the_appended_table(spark):
    df = queries_polls.QUERIES["snk3_append_metric"](spark, "/root/testdata/sf0.001")
    folder = staging.shared_folder(spark).removeprefix("file:")
    files = [f.removeprefix("file:") for f in df.inputFiles()]
    assert files and all(folder in f and "/nodes_containers_metrics/" in f for f in files)


def test_tags_start_at_zero_and_are_replaced(spark, tmp_path):
    registry = spark.createDataFrame([("counts", "a"), ("gauges", "b")], "table_name string, tag string")
    tables.write_tags(tables.initial_tags(registry), str(tmp_path))
    tables.write_tags(
        spark.createDataFrame([("counts", "a", "7")], "table_name string, tag string, value string"),
        str(tmp_path),
    )
    got = tables.read_tags(spark, str(tmp_path)).collect()
    assert [(r.table_name, r.tag, r.value) for r in got] == [("counts", "a", "7")]


def test_query_info_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("completed", "q1", "top/completed/q1/HiveQueryInfo.json", "select 1")],
        "state string, queryId string, path string, queryString string",
    )
    tables.write_query_info(df, str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert rows[0].state == "completed" and '"queryId":"q1"' in rows[0].record
    stored = spark.read.json(str(tmp_path / "out")).select(F.col("record").alias("doc"))
    assert logs.read_query_info(stored).collect()[0].queryString == "select 1"


def test_query_log_range_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.sql(
        "select timestamp_ntz'1997-01-01' as start_time, 'select 1' as query_string, 1L as other"
    ).write.parquet(path)
    df = logs.scan_query_log(spark.read.parquet(path), "1997-01-01", "1997-12-31")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df.select("query_string")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(start_time" in plan and "LessThanOrEqual(start_time" in plan
    assert "other" not in plan.split("ReadSchema")[-1]
    assert df.count() == 1


def test_staged_lies_in_the_shared_folder(spark):
    df = staging.staged(spark.range(5), "x")
    assert df.count() == 5
    assert staging.shared_folder(spark).rstrip("/") in df.inputFiles()[0].replace("file://", "file:")


SCRIPT = """
import sys
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1])
     .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
     .getOrCreate())
s.range(1000).groupBy("id").count().count()
s.stop()
"""


def test_real_event_log(spark, tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], check=True, timeout=120,
                   capture_output=True)
    files = [f for f in glob.glob(str(tmp_path / "*")) if not os.path.basename(f).startswith(".")]
    lines = logs.read_event_lines(spark, files[0])
    stages, jobs = logs.stage_completed(lines), logs.job_start(lines)
    assert stages.count() >= 2 and jobs.count() >= 1
    found = runs.stage_to_job(stages, jobs).collect()
    assert found and all(r.jobId >= 0 and r.completionTime >= r.submissionTime > 0 for r in found)


def test_staged_tables_of_a_run(spark):
    table = staging.staged(spark.range(3), "numbers")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2]
    assert all("/run-" in f and "numbers-" in f for f in table.inputFiles())
