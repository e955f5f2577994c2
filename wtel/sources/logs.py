"""Readers for text logs: query log, metric packets, directory listings, Spark event logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wtel import schemas
from wtel.functions import zones
from wtel.functions.once import with_once


def scan_query_log(log: DataFrame, start: str, end: str) -> DataFrame:
    """Queries that started between the two times, both included, except ``use default``."""
    t = F.col("start_time")
    within = (t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz"))
    return log.where(within & (F.col("query_string") != "use default"))


def parse_statsd(packets: DataFrame, prefix: str, line: str = "line") -> DataFrame:
    """``(…, name, value, kind)`` of well-formed counter (``c``) and gauge (``g``) packets.

    The prefix is cut by length and not compared.
    """
    ids = [c for c in packets.columns if c != line]
    rest = F.substring(line, len(prefix) + 2, 2**31 - 1 - len(prefix) - 2)
    parsed = packets.select(*ids, rest.alias("_rest")).select(
        *ids,
        F.split(F.expr("substring(_rest, 1, length(_rest) - 2)"), ":").alias("_part"),
        F.expr("right(_rest, 1)").alias("kind"),
    )
    text = F.get("_part", F.lit(1))
    number = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))
    return (
        parsed.where(F.col("kind").isin("c", "g"))
        .select(*ids, F.get("_part", F.lit(0)).alias("name"), number.alias("value"), "kind")
        .where("value is not null")
    )


# Formats of a listing line and of a log-directory name.
LISTING_HEAD = r"([0-9]+)[ ]+(hdfs://)?([0-9a-z\.:]*)?"
LISTING_TAIL = r"([/a-zA-Z0-9_-]*)"
DIRECTORY = r"([a-zA-Z0-9-]+)_([0-9]{12})([/a-fA-F0-9_-]*)"


def _matched(lines: DataFrame, base: str, line: str) -> DataFrame:
    listing = rf"^{LISTING_HEAD}{re.escape(base)}/{LISTING_TAIL}\z"
    directory = rf"^{DIRECTORY}\z"
    found = with_once(
        lines.where(~F.startswith(line, F.lit("Found "))),
        {
            "_name": F.when(F.col(line).rlike(listing), F.regexp_extract(line, listing, 4)),
            "_size": F.regexp_extract(line, listing, 1),
        },
    )
    return with_once(
        found,
        {
            "_ok": F.coalesce(F.col("_name").rlike(directory), F.lit(False)),
            "_stamp": F.regexp_extract("_name", directory, 2),
            "_user": F.regexp_extract("_name", directory, 1),
        },
    )


def parse_du_listing(lines: DataFrame, base: str, line: str = "line") -> DataFrame:
    """``(dirName, path, size, timestamp, userName)`` of the log directories in a listing.

    ``timestamp`` is in epoch milliseconds; the 12 digits in the name are log-zone local time.
    """
    entries = _matched(lines, base, line).where("_ok")
    entries = with_once(entries, {"_local": zones.stamp_to_local(F.col("_stamp"))})
    utc = zones.local_to_utc(F.col("_local"), zones.LOG_ZONE)
    return with_once(entries, {"timestamp": zones.epoch_ms(utc)}).select(
        F.col("_name").alias("dirName"),
        F.concat(F.lit(base + "/"), "_name").alias("path"),
        F.coalesce(F.expr("try_cast(_size as bigint)"), F.lit(0)).alias("size"),
        "timestamp",
        F.col("_user").alias("userName"),
    )


def rejected_du_lines(lines: DataFrame, base: str, line: str = "line") -> DataFrame:
    """Lines that are neither a heading nor a log directory."""
    return _matched(lines, base, line).where("not _ok").select(*lines.columns)


_STAGE = T.StructType(
    [
        T.StructField("Stage ID", T.IntegerType()),
        T.StructField("Stage Name", T.StringType()),
        T.StructField("Number of Tasks", T.IntegerType()),
        T.StructField("Submission Time", T.LongType()),
        T.StructField("Completion Time", T.LongType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("Event", T.StringType()),
        T.StructField("Job ID", T.IntegerType()),
        T.StructField("Submission Time", T.LongType()),
        T.StructField("Stage IDs", T.ArrayType(T.IntegerType())),
        T.StructField("Stage Info", _STAGE),
    ]
)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event-log lines with the file they came from as the application id."""
    return spark.read.text(path, wholetext=False).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("app"),
        F.col("value").alias("line"),
    )


def stage_completed(lines: DataFrame) -> DataFrame:
    """Finished stages of an event log; missing times are 0."""
    info = F.col("_e")["Stage Info"]
    return (
        lines.where(F.contains("line", F.lit("SparkListenerStageCompleted")))
        .select("app", F.from_json("line", EVENT).alias("_e"))
        .where(F.col("_e")["Event"] == "SparkListenerStageCompleted")
        .select(
            "app",
            info["Stage ID"].alias("stageId"),
            info["Stage Name"].alias("name"),
            info["Number of Tasks"].alias("numTasks"),
            F.coalesce(info["Submission Time"], F.lit(0)).alias("submissionTime"),
            F.coalesce(info["Completion Time"], F.lit(0)).alias("completionTime"),
        )
    )


def job_start(lines: DataFrame) -> DataFrame:
    """Started jobs of an event log with the stages they list."""
    e = F.col("_e")
    return (
        lines.where(F.contains("line", F.lit("SparkListenerJobStart")))
        .select("app", F.from_json("line", EVENT).alias("_e"))
        .where(e["Event"] == "SparkListenerJobStart")
        .select(
            "app",
            e["Job ID"].alias("jobId"),
            e["Submission Time"].alias("startTime"),
            e["Stage IDs"].alias("stageIds"),
        )
    )


_OPERATOR = T.StructType(
    [T.StructField("operatorId", T.StringType()), T.StructField("operatorType", T.StringType())]
)
_TASK = T.StructType(
    [
        T.StructField("taskId", T.StringType()),
        T.StructField("taskType", T.StringType()),
        T.StructField("hiveOperatorInfos", T.ArrayType(_OPERATOR)),
    ]
)
_STAGE_INFO = T.StructType(
    [
        T.StructField("stageId", T.StringType()),
        T.StructField("stageType", T.StringType()),
        T.StructField("hadoopJobId", T.StringType()),
        T.StructField("dependentChildren", T.ArrayType(T.StringType())),
        T.StructField("hiveTaskInfos", T.ArrayType(_TASK)),
    ]
)
# Field names of a stored query record.
QUERY_INFO = T.StructType(
    [
        T.StructField("queryId", T.StringType()),
        T.StructField("queryString", T.StringType()),
        T.StructField("startTime", T.LongType()),
        T.StructField("endTime", T.LongType()),
        T.StructField("namedOutput", T.StringType()),
        T.StructField("outputType", T.StringType()),
        T.StructField("failRetCode", T.IntegerType()),
        T.StructField("version", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("hiveStageInfos", T.ArrayType(_STAGE_INFO)),
    ]
)


def read_query_info(docs: DataFrame) -> DataFrame:
    """Stored query records. Unknown fields are ignored, documents that are not JSON are dropped."""
    ids = [c for c in docs.columns if c != "doc"]
    schema = T.StructType([*QUERY_INFO.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = docs.select(
        *ids, F.from_json("doc", schema, {"mode": "PERMISSIVE"}).alias("_q")
    ).where("_q is not null and _q._corrupt_record is null")
    return parsed.select(*ids, *[F.col("_q." + n) for n in schemas.names(QUERY_INFO)])


def query_info_stages(records: DataFrame) -> DataFrame:
    """One row per stage of every query record, with the numbers of children and tasks."""
    return records.select("queryId", F.explode("hiveStageInfos").alias("_s")).select(
        "queryId",
        "_s.stageId",
        "_s.stageType",
        "_s.hadoopJobId",
        F.array_join("_s.dependentChildren", ",").alias("dependentChildren"),
        F.size(F.coalesce("_s.hiveTaskInfos", F.array())).alias("numTasks"),
    )
