"""Workflow runs: identifiers, start and end times, and which query a stage belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.functions.ordered import as_of, fill, number_all, number_rows, position_chunk, time_chunk
from wtel.functions.text import joined_or_empty
from wtel.plans.plan_nodes import mapred_stages

NO_JOB = -1
#: A day, the width of the chunks of a stage's jobs: an application lists one stage in few jobs an hour.
DAY_MS = 86_400_000


def assign_ids(events: DataFrame, last_wid: int = 0) -> DataFrame:
    """Identifiers of everything that started: ``(level, key, wid, cid, qid)``.

    Workflows are numbered after ``last_wid``, components from 1 in their workflow, queries from 1 in
    their component, all in order of start.
    """
    started = events.where("kind = 'started'").select("level", "key", "parent", "ts")
    hour = time_chunk("ts")

    def numbered(level: str, keys: list[str], name: str) -> DataFrame:
        return number_rows(started.where(F.col("level") == level), keys, ["ts", "key"], hour, name)

    flows = number_all(started.where("level = 'workflow'"), ["ts", "key"], "n").select(
        F.col("key").alias("flow"), (F.col("n") + F.lit(last_wid)).alias("wid")
    )
    parts = (
        numbered("component", ["parent"], "cid")
        .select(F.col("key").alias("part"), F.col("parent").alias("flow"), "cid")
        .join(flows, "flow")
    )
    queries = (
        numbered("query", ["parent"], "qid")
        .select("key", F.col("parent").alias("part"), "qid")
        .join(parts, "part")
    )
    absent = F.lit(None).cast("long")
    return (
        flows.select(
            F.lit("workflow").alias("level"), F.col("flow").alias("key"), "wid",
            absent.alias("cid"), absent.alias("qid"),
        )
        .unionByName(
            parts.select(
                F.lit("component").alias("level"), F.col("part").alias("key"), "wid", "cid",
                absent.alias("qid"),
            )
        )
        .unionByName(queries.select(F.lit("query").alias("level"), "key", "wid", "cid", "qid"))
    )


def pair_events(events: DataFrame) -> DataFrame:
    """Completed events with their start: the latest one of the same level in the run."""
    chunk = time_chunk("ts")
    done = events.where("kind = 'completed'")
    started = events.where("kind = 'started'").select(
        "run", "level", "ts", F.col("ts").alias("startTime")
    )
    paired = as_of(done, started, ["run", "level"], ["ts"], chunk, ["startTime"])
    return paired.select(
        "run", "level", "key", "name", "engine", "user_name", "startTime", F.col("ts").alias("endTime")
    )


def run_tables(events: DataFrame, last_wid: int = 0) -> dict[str, DataFrame]:
    """The tables ``workflows``, ``components`` and ``executedQueries`` of finished runs.

    Each table reads only the events of its own level and the columns it shows.
    """
    ids = assign_ids(events, last_wid)

    def level(name: str, *cols: str | Column) -> DataFrame:
        own = pair_events(events.where(F.col("level") == name))
        numbers = ids.where(F.col("level") == name)
        return own.join(numbers, ["level", "key"]).select(*cols, "startTime", "endTime")

    return {
        "workflows": level("workflow", "wid", "name", F.col("user_name").alias("userName")),
        "components": level("component", "cid", "wid", "name", "engine"),
        "executedQueries": level(
            "query", "qid", "cid", "wid", F.col("name").alias("queryString"), "engine"
        ),
    }


def last_ids(workflows: DataFrame, components: DataFrame, queries: DataFrame) -> DataFrame:
    """Largest identifier in use: of workflows, of components per workflow, of queries per component."""
    absent = F.lit(None).cast("long")
    top = workflows.agg(F.coalesce(F.max("wid"), F.lit(0)).alias("last_id"))
    mid = components.groupBy("wid").agg(F.max("cid").alias("last_id"))
    low = queries.groupBy("wid", "cid").agg(F.max("qid").alias("last_id"))
    return (
        top.select(F.lit("workflow").alias("level"), absent.alias("wid"), absent.alias("cid"), "last_id")
        .unionByName(mid.select(F.lit("component").alias("level"), "wid", absent.alias("cid"), "last_id"))
        .unionByName(low.select(F.lit("query").alias("level"), "wid", "cid", "last_id"))
    )


def current_query_id(
    workflows: DataFrame, components: DataFrame, queries: DataFrame
) -> DataFrame:
    """Identifiers of what is running now: one past the last written workflow, then one past the last
    written component of that workflow, then one past the last written query of that component."""

    def following(last: str) -> Column:
        return (F.coalesce(last, F.lit(0)) + 1).cast("long")

    top = workflows.agg(F.max("wid").alias("_w")).select(following("_w").alias("wid"))
    mid = components.groupBy("wid").agg(F.max("cid").alias("_c"))
    low = queries.groupBy("wid", "cid").agg(F.max("qid").alias("_q"))
    running = top.join(mid, "wid", "left").select("wid", following("_c").alias("cid"))
    return running.join(low, ["wid", "cid"], "left").select("wid", "cid", following("_q").alias("qid"))


def stage_to_job(stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Finished stages with the latest job, started by then, that lists them; -1 if there is none."""
    listed = jobs.select(
        "app", F.explode("stageIds").alias("stageId"), F.col("startTime").alias("ts"),
        F.col("jobId").alias("tie"), "jobId",
    )
    last = F.lit(2**31 - 1)
    left = stages.withColumns({"ts": F.col("completionTime"), "tie": last})
    found = as_of(left, listed, ["app", "stageId"], ["ts", "tie"], time_chunk("ts", DAY_MS), ["jobId"], once=True)
    return found.select(*stages.columns, F.coalesce("jobId", F.lit(NO_JOB)).alias("jobId"))


def attribute_to_query(stages: DataFrame, queries: DataFrame) -> DataFrame:
    """Finished stages with the identifiers of the query that ran in their run at that time.

    ``queries`` has ``(run, start, wid, cid, qid)``.
    """
    left = stages.withColumn("ts", F.col("completionTime"))
    right = queries.withColumn("ts", F.col("start"))
    ids = ["wid", "cid", "qid"]
    return as_of(left, right, ["run"], ["ts"], time_chunk("ts"), ids, once=True).select(*stages.columns, *ids)


def spark_stages(stages: DataFrame, queries: DataFrame) -> DataFrame:
    """The table ``sparkStages``: finished stages with their job and the query of their run.

    ``stages`` are those of ``stage_to_job`` with the column ``run``; ``queries`` as above.
    """
    return attribute_to_query(stages, queries).select(
        "qid", "cid", "wid", "stageId", "jobId", "name", "numTasks", "submissionTime", "completionTime"
    )


def hive_stages(times: DataFrame, ids: DataFrame) -> DataFrame:
    """The table ``hiveStages``: the stages of ``stage_end_times`` with the ids (query_id, wid, cid, qid).

    What the stage's tasks did is not recorded; the column is empty text.
    """
    return times.join(ids, "query_id").select(
        "qid", "cid", "wid", "stageId", "hadoopJobId", "dependentChildren",
        F.lit("").alias("hiveTaskInfos"), "startTime", "endTime",
    )


def stage_job_start(stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stages with the start time of their job; null if the job is unknown.

    Stages without a job do not take part in the join: they would all meet in one task.
    """
    starts = jobs.withColumnRenamed("start_time", "job_start")
    found = stages.where("job_id is not null").join(starts, "job_id", "left")
    return found.unionByName(stages.where("job_id is null"), allowMissingColumns=True)


def stage_end_times(stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Start and end of the map-reduce stages of each query, as the ``hiveStages`` times.

    The first stage starts with the query. A later one starts with its job, or if that is unknown
    with the latest known job before it. A stage ends where the next known job starts, the last one
    with the query.
    """
    rows = stage_job_start(mapred_stages(stages), jobs)
    first = rows.groupBy("query_id").agg(F.min("stage_no").alias("_first"))
    rows = rows.join(first, "query_id").withColumn(
        "_start", F.when(F.col("stage_no") != F.col("_first"), F.col("job_start"))
    )
    timed = fill(
        rows, ["query_id"], ["stage_no"], position_chunk("stage_no"),
        upto={"_own": "_start"}, after={"_next": "_start"},
    )
    return timed.select(
        "query_id",
        "stage_no",
        F.col("stage_id").alias("stageId"),
        F.coalesce("job_id", F.lit("")).alias("hadoopJobId"),
        joined_or_empty("children").alias("dependentChildren"),
        F.coalesce("_own", "query_start").alias("startTime"),
        F.coalesce("_next", "query_end").alias("endTime"),
    )
