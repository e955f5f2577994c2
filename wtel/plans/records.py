"""Whole query records: put together from node rows, and taken apart into rows again.

A record is one JSON document per query. Its operators are nested to any depth, so they are neither read
nor written by a schema: forests are written as the depth-first series of their operators, for many queries
at a time, and every document is walked once from its roots down.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wtel.plans import forests, plan_nodes
from wtel.plans.plan_nodes import OP, STAGE
from wtel.plans.tree_walk import whole_queries

# Field names and types of a stored query record and of what it holds.
TEXTS = T.ArrayType(T.StringType())
NAMED_TEXTS = T.MapType(T.StringType(), T.StringType())


def _struct(text: str, **more: T.DataType) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    fields = [f.partition(":") for f in text.split()]
    made = [T.StructField(n, kinds.get(k, T.StringType())) for n, _, k in fields]
    return T.StructType(made + [T.StructField(n, k) for n, k in more.items()])


TABLE_INFO = _struct(
    "database baseTableName fullTableName numBuckets:int path", bucketCols=TEXTS, partitionCols=TEXTS, sortCols=TEXTS, sortProps=TEXTS
)
COLUMN_INFO = _struct("tableAlias fullTableName columnName")
STAGE_INFO = _struct(
    "stageId stageType hadoopJobId isRoot:boolean startTime:long endTime:long recommendation joinType",
    inputPaths=TEXTS, aliasToPath=NAMED_TEXTS, aliasToFullTableName=NAMED_TEXTS, dependentChildren=TEXTS,
    conditionalChildren=TEXTS, backupChildren=TEXTS, partitionColumns=T.ArrayType(COLUMN_INFO), joinKeys=T.ArrayType(COLUMN_INFO),
    constFilters=T.ArrayType(_struct("expr")), hiveTaskInfos=T.ArrayType(_struct("taskId taskType")),
)
QUERY_FIELDS = _struct(
    "queryId queryString startTime:long endTime:long queryRecommendation numMRJobs:int totalMapTasks:int totalReduceTasks:int"
    " totalMapSlotDuration:long totalReduceSlotDuration:long userName totalDfsBytesRead:long totalDfsBytesWritten:long namedOutput"
    " outputType failRetCode:int failTID failJID failTaskKind version comments details hiveVersion hiveCompiledBy hiveCompileDate"
    " hiveRevision",
    outputPartitions=NAMED_TEXTS, failExStack=TEXTS,
)
RECORD = T.StructType(
    [
        *QUERY_FIELDS.fields,
        T.StructField("fullTableNameToInfos", T.MapType(T.StringType(), TABLE_INFO)),
        T.StructField("hiveStageInfos", T.ArrayType(STAGE_INFO)),
    ]
)
CHILDREN = "childHiveOperatorInfos"


# --- taking records apart ------------------------------------------------------------------------
def read_records(docs: DataFrame) -> DataFrame:
    """All fields of stored records but the operators, with ``doc``; documents that are not JSON are dropped."""
    ids = [c for c in docs.columns if c != "doc"]
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = docs.select(*ids, "doc", F.from_json("doc", schema, {"mode": "PERMISSIVE"}).alias("_q"))
    parsed = parsed.where("_q is not null and _q._corrupt_record is null")
    return parsed.select(*ids, *[F.col("_q." + f.name) for f in RECORD.fields], "doc")


def record_queries(records: DataFrame) -> DataFrame:
    """One row per query with its own fields."""
    return records.select(*[f.name for f in QUERY_FIELDS.fields])


def record_tables(records: DataFrame) -> DataFrame:
    """One row per query and table that its record describes."""
    rows = records.select("queryId", F.explode("fullTableNameToInfos").alias("name", "info"))
    return rows.select("queryId", "name", "info.*")


def record_stages(records: DataFrame) -> DataFrame:
    """One row per stage of each record, with all its fields."""
    return records.select("queryId", F.inline("hiveStageInfos"))


def record_operators(records: DataFrame) -> DataFrame:
    """One row per operator: queryId, stageId, taskId, operatorId, operatorType, comment, parentId, path, depth.

    Every document is read once and its forests are walked from the roots down; ``path`` holds the positions from the task down.
    """
    fields = "stageId string, taskId string, operatorId string, operatorType string, comment string, parentId string, path array<int>"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.list_(pa.int32()) if n == "path" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                owners, rows = [], []
                for k, doc in enumerate(part.column("doc").to_pylist()):
                    found = list(_operators(doc))
                    owners += [k] * len(found)
                    rows += found
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                ids = part.column("queryId").take(pa.array(owners, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *arrays], ["queryId", *names])

    out = records.select("queryId", "doc").mapInArrow(run, f"queryId string, {fields}")
    return out.withColumn("depth", F.size("path"))


#: Documents whose operators are handed on together.
DOCUMENTS = 1024


def _objects(holder: dict, name: str) -> list[dict]:
    """The members of a list in an object, with an empty object for what is none."""
    held = holder.get(name)
    return [x if isinstance(x, dict) else {} for x in held] if isinstance(held, list) else []


def _shown(value: object) -> str | None:
    """A value as text; numbers are read as they are written."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _operators(doc: str) -> Iterator[tuple]:
    """stageId, taskId, operatorId, operatorType, comment, parentId and path of a document's operators, depth first."""
    try:
        record = json.loads(doc, parse_int=str, parse_float=str)
    except ValueError:
        return
    for stage in _objects(record, "hiveStageInfos") if isinstance(record, dict) else ():
        for task in _objects(stage, "hiveTaskInfos"):
            ids = _shown(stage.get("stageId")), _shown(task.get("taskId"))
            waiting = [(node, None, [i]) for i, node in enumerate(_objects(task, "hiveOperatorInfos"))][::-1]
            while waiting:
                node, parent, path = waiting.pop()
                own = _shown(node.get("operatorId"))
                yield (*ids, own, _shown(node.get("operatorType")), _shown(node.get("comment")), parent, path)
                below = _objects(node, CHILDREN)
                waiting += [(x, own, [*path, i]) for i, x in enumerate(below)][::-1]


# --- putting records together --------------------------------------------------------------------
def _json(*fields: Column) -> Column:
    """A JSON object of the fields without its closing brace; nulls are left out."""
    return F.regexp_replace(F.to_json(F.struct(*fields)), r"\}\z", "")


def _with_member(head: Column, name: str, value: Column) -> Column:
    """``head`` of ``_json`` closed with one more member, whose value is JSON text."""
    comma = F.when(head == "{", F.lit("")).otherwise(F.lit(","))
    return F.concat(head, comma, F.lit(f'"{name}":'), value, F.lit("}"))


def operator_forest(ops: DataFrame) -> DataFrame:
    """query_id, stage_id, task_type and ``forest``: the JSON array of each task's operators with those below them.

    ``ops`` has OP, task_type, parent_op_id, seq, op_type and comment. The operators of a query meet by one shuffle, and the
    forests of many queries are put together at a time (``forests.texts``). An operator whose parent is not in its task is a root.
    """
    rows = ops.select(*OP, "task_type", "parent_op_id", F.col("seq").cast("long").alias("seq"), "op_type", "comment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_queries(batches):
            yield forests.texts(table, CHILDREN)

    kind = ops.schema["query_id"].dataType.simpleString()
    dealt = rows.where("query_id is not null").repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(run, f"query_id {kind}, stage_id string, task_type string, forest string")


def _listed(columns: Sequence[str], order: str, value: Column) -> Column:
    """Values of the rows of a group, in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, *columns, value.alias("v")))), lambda e: e["v"])


def query_records(
    queries: DataFrame,
    ops: DataFrame,
    attrs: DataFrame,
    aliases: DataFrame,
    stages: DataFrame,
    outputs: DataFrame,
    frames: DataFrame,
    lineage: DataFrame,
    columns: DataFrame,
    times: DataFrame | None = None,
) -> DataFrame:
    """query_id and ``record``: the whole stored document of each query.

    ``queries`` has ``(query_id, query_string, start_time, end_time, version)``, ``columns`` describes tables as
    ``plan_nodes.table_profile`` takes them, ``times`` has ``(query_id, stage_id, startTime, endTime)``. A table without a
    description is a name; a preliminary record has no end. ``stages`` are read several times: stage those that are
    costly to compute.
    """
    known_ops = ops.where("stage_id is not null and op_id is not null and task_type is not null")
    # texts of forests are most of a record: they stay with their query and meet its stages there
    forest = plan_nodes.per_plan(
        known_ops, attrs, "forests array<struct<stage_id string, task_type string, forest string>>",
        lambda told: forests.by_query(forests.texts(pa.Table.from_batches([told]), CHILDREN)), ("task_type", "parent_op_id"),
    )
    text = F.col("query_id").cast("string")

    def task(t: Column) -> Column:
        ids = _json(F.concat(t["stage_id"], t["task_type"]).alias("taskId"), t["task_type"].alias("taskType"))
        return _with_member(ids, "hiveOperatorInfos", t["forest"])

    is_empty = F.array().cast("array<string>")
    one = aliases.where("alias is not null").groupBy(*STAGE, "alias").agg(F.max_by("full_table", "pos").alias("full_table"))
    named = one.groupBy(*STAGE).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "full_table")))).alias("aliasToFullTableName")
    )
    constant = plan_nodes.const_filters(ops, attrs, aliases).groupBy(*STAGE).agg(
        F.array_sort(F.collect_list(F.struct("expr"))).alias("constFilters")
    )
    keys = plan_nodes.stage_keys(ops, attrs)
    roots = plan_nodes.root_stages(stages).withColumn("isRoot", F.lit(True))
    if times is None:
        times = stages.select(*STAGE, F.lit(0).cast("long").alias("startTime"), F.lit(0).cast("long").alias("endTime"))
    # a stage is in the record whether the plan or the run tells of it
    known = stages.select(*STAGE).unionByName(ops.select(*STAGE)).distinct()
    rows = known.join(stages.select(*STAGE, "stage_type", "job_id", "children", "backup", "conditional"), STAGE, "left")
    for part in (named, constant, keys, roots, times):
        rows = rows.join(part, STAGE, "left")

    def column_infos(listed: str) -> Column:
        names = F.filter(F.split(F.coalesce(listed, F.lit("")), ","), lambda x: x != "")
        alias = lambda x: F.when(F.contains(x, F.lit(".")), F.substring_index(x, ".", 1))
        return F.transform(names, lambda x: F.struct(alias(x).alias("tableAlias"), F.substring_index(x, ".", -1).alias("columnName")))

    head = _json(
        F.col("stage_id").alias("stageId"), F.col("stage_type").alias("stageType"), F.col("job_id").alias("hadoopJobId"),
        F.coalesce("isRoot", F.lit(False)).alias("isRoot"), F.col("startTime"), F.col("endTime"), F.col("join_type").alias("joinType"),
        "aliasToFullTableName",
        *[F.coalesce(c, is_empty).alias(n) for c, n in (("children", "dependentChildren"), ("conditional", "conditionalChildren"), ("backup", "backupChildren"))],
        column_infos("partition_columns").alias("partitionColumns"), column_infos("join_keys").alias("joinKeys"), "constFilters",
    )
    heads = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("stage_id", head.alias("head")))).alias("heads"))

    def stage(h: Column) -> Column:
        own = F.filter(F.coalesce("forests", F.array()), lambda t: t["stage_id"] == h["stage_id"])
        tasks = F.concat(F.lit("["), F.array_join(F.transform(own, task), ","), F.lit("]"))
        return _with_member(h["head"], "hiveTaskInfos", tasks)

    plan = heads.join(forest, "query_id", "left").select("query_id", F.array_join(F.transform("heads", stage), ",").alias("plan"))

    described = plan_nodes.table_profile(columns)
    cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "").alias
    info = F.struct(
        F.coalesce("db", F.substring_index("full_table", ".", 1)).alias("database"),
        F.coalesce("table_name", F.substring_index("full_table", ".", -1)).alias("baseTableName"),
        F.col("full_table").alias("fullTableName"),
        cut("bucket_cols")("bucketCols"), F.col("num_buckets").alias("numBuckets"), cut("partition_cols")("partitionCols"),
        cut("sort_cols")("sortCols"), cut("sort_props")("sortProps"), F.col("path"),
    )
    used = aliases.where("full_table is not null").select("query_id", "full_table").distinct()
    tables = used.join(described, used["full_table"] == described["full_name"], "left").groupBy("query_id")
    tables = tables.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("full_table").alias("key"), info.alias("value"))))).alias("tables"))

    stack = plan_nodes.error_chain(frames)
    out = queries
    for part in (plan, tables, plan_nodes.failure_summary(stages), stack, plan_nodes.lineage_report(lineage), plan_nodes.named_output(queries, outputs)):
        out = out.join(part, "query_id", "left")
    jobs = stages.groupBy("query_id").agg(F.count(F.when(F.col("stage_type") == plan_nodes.MAPRED, 1)).cast("int").alias("n_jobs"))
    out = out.join(jobs, "query_id", "left")
    has = lambda c: F.col(c) if c in queries.columns else F.lit(None).cast("string")
    head = _json(
        text.alias("queryId"), F.col("query_string").alias("queryString"), F.col("start_time").alias("startTime"),
        F.col("end_time").alias("endTime"), F.coalesce("n_jobs", F.lit(0)).alias("numMRJobs"), has("user_name").alias("userName"),
        F.col("named_output").alias("namedOutput"), F.col("output_type").alias("outputType"),
        F.coalesce("fail_code", F.lit(0)).alias("failRetCode"), F.col("fail_task").alias("failTID"), F.col("fail_job").alias("failJID"),
        F.col("fail_kind").alias("failTaskKind"), F.when(F.col("stack").isNotNull(), F.split("stack", "\n")).alias("failExStack"),
        F.col("version"), F.col("details"), F.col("tables").alias("fullTableNameToInfos"),
    )
    stages_text = F.concat(F.lit("["), F.coalesce("plan", F.lit("")), F.lit("]"))
    return out.select("query_id", _with_member(head, "hiveStageInfos", stages_text).alias("record"))
