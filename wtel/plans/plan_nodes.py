"""Facts about query plans: operators, stages, outputs, errors and lineage.

Inputs are node tables: operators ``(query_id, stage_id, task_type, op_id, parent_op_id, op_type,
variant, seq)``, their attributes ``(query_id, stage_id, op_id, attr, pos, value, kind, alias)``, the
aliases of a stage ``(query_id, stage_id, alias, full_table, pos)``, and stages with their
``children``, ``backup`` and ``conditional`` successors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wtel.functions.text import full_table_name, last_alias
from wtel.plans import comments
from wtel.plans.comments import AFTER_POSITION, AS_IS, IF_POSITIVE, MADE, OF_KIND, OPERATOR
from wtel.plans.dealing import whole_keys
from wtel.plans.tree_walk import BATCH_NODES, whole_queries
from wtel.sinks.staging import staged

STAGE = ["query_id", "stage_id"]
OP = [*STAGE, "op_id"]
# Names of operator types and stage types.
SORTED_JOIN = "SMBMAPJOIN"
MAPRED = "MAPRED"


def plan_nodes(ops: DataFrame) -> DataFrame:
    """A map and a reduce task per stage with their operators; a task may have none."""
    tasks = ops.select(*STAGE).distinct().select(
        *STAGE, F.explode(F.array(F.lit("MAP"), F.lit("REDUCE"))).alias("task_type")
    )
    return tasks.join(ops, [*STAGE, "task_type"], "left").select(
        *STAGE,
        F.concat("stage_id", "task_type").alias("task_id"),
        "task_type",
        "op_id",
        "parent_op_id",
        _shown_type().alias("op_type"),
    )


def _is_sorted() -> Column:
    return (F.col("op_type") == "MAPJOIN") & F.contains("variant", F.lit("sorted"))


def _shown_type() -> Column:
    """Operator type, sorted-merge joins under a name of their own."""
    return F.when(_is_sorted(), SORTED_JOIN).otherwise(F.col("op_type"))


def resolve_alias(cols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add the full table name of each column's alias within its stage; null if it has none."""
    tables = (
        aliases.groupBy(*STAGE, last_alias("alias").alias("alias"))
        .agg(F.max_by("full_table", "pos").alias("full_table"))
        .where("alias is not null")
    )
    return cols.join(tables, [*STAGE, "alias"], "left")


def const_filters(ops: DataFrame, attrs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Filters that compare one column with one constant, in either order."""
    mine = attrs.join(ops.where("op_type = 'FILTER'").select(*OP), OP, "left_semi")
    is_operand = F.col("attr") == "operand"
    sides = mine.where("attr in ('operand', 'predicate')").groupBy(*OP).agg(
        F.count(F.when(is_operand, 1)).alias("n"),
        *[
            F.max(F.when(is_operand & (F.col("pos") == i), F.struct("kind", "value", "alias"))).alias(
                f"side{i}"
            )
            for i in (0, 1)
        ],
        F.max(F.when(F.col("attr") == "predicate", F.col("value"))).alias("expr"),
    )
    swap = F.col("side1.kind") == "column"
    ordered = sides.where("n = 2").select(
        *OP,
        "expr",
        F.when(swap, F.col("side1")).otherwise(F.col("side0")).alias("first"),
        F.when(swap, F.col("side0")).otherwise(F.col("side1")).alias("second"),
    )
    found = ordered.where("first.kind = 'column' and second.kind = 'constant'").select(
        *OP, F.col("first.alias").alias("alias"), F.col("first.value").alias("column_name"), "expr"
    )
    return resolve_alias(found, aliases)


def _stages_with(ops: DataFrame, condition: Column) -> DataFrame:
    return ops.where(condition).select(*STAGE).distinct()


def stages_with_common_join(ops: DataFrame) -> DataFrame:
    """Stages where a top-level operator of a task is a common join."""
    return _stages_with(ops, F.col("parent_op_id").isNull() & (F.col("op_type") == "JOIN"))


def stages_with_map_join(ops: DataFrame) -> DataFrame:
    """Stages with a map join in their map task; sorted-merge joins do not count."""
    return _stages_with(ops, (F.col("task_type") == "MAP") & (_shown_type() == "MAPJOIN"))


def stages_with_map_aggregation(ops: DataFrame) -> DataFrame:
    """Stages that group in their map task."""
    return _stages_with(ops, (F.col("task_type") == "MAP") & (F.col("op_type") == "GROUPBY"))


def _typed(ops: DataFrame, attrs: DataFrame) -> DataFrame:
    return attrs.join(ops.select(*OP, "op_type", "variant", "seq"), OP)


def stage_keys(ops: DataFrame, attrs: DataFrame) -> DataFrame:
    """Partition columns, join keys and join type of each stage, columns as ``alias.column`` text.

    A common join takes the partition columns as its keys. Map joins add their own, but those walked
    before a common join are replaced by it.
    """
    is_col = F.col("kind") == "column"
    part = (F.col("op_type") == "REDUCESINK") & (F.col("attr") == "partitionCol") & is_col
    mapped = (F.col("op_type") == "MAPJOIN") & (F.col("attr") == "joinExpr") & is_col
    place = F.struct("seq", "pos", F.concat_ws(".", "alias", "value").alias("col"))
    cols = _typed(ops, attrs).where(part | mapped).groupBy(*STAGE).agg(
        F.array_sort(F.collect_list(F.when(part, place))).alias("parts"),
        F.array_sort(F.collect_list(F.when(mapped, place))).alias("maps"),
    )
    join_seq = F.when(F.col("op_type").isin("JOIN", "MAPJOIN"), F.col("seq"))
    joins = ops.groupBy(*STAGE).agg(
        F.max(F.when(F.col("op_type") == "JOIN", F.col("seq"))).alias("common"),
        F.max_by(_shown_type(), join_seq).alias("join_type"),
    )
    both = joins.join(cols, STAGE, "left")
    after = F.filter("maps", lambda m: F.coalesce(m["seq"] > F.col("common"), F.lit(True)))
    keys = F.when(F.col("common").isNotNull(), F.concat("parts", after)).otherwise(after)

    def text(entries: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(entries, lambda e: e["col"]), ","), F.lit(""))

    return both.select(
        *STAGE, text(F.col("parts")).alias("partition_columns"), text(keys).alias("join_keys"),
        "join_type",
    )


# Titles of an operator's comment, in order, for each operator type. The third item
# says how a value is shown: as it is, after its position, only if positive, or (of a select item) by its kind;
# an attribute may also be made from others.
_JOIN = [
    ("cond", "condition map", AS_IS),
    ("filterString", "condition expressions", AFTER_POSITION),
    ("skew", "handleSkewJoin", AS_IS),
    ("outputCol", "outputCols", AS_IS),
    ("filterString", "filter predicates", AFTER_POSITION),
    ("filterMap", "filter mappings", AFTER_POSITION),
    ("nullSafe", "nullSafes", AS_IS),
]
TITLES = {
    "JOIN": [*_JOIN, ("joinKey", "joinKeys", MADE)],
    "MAPJOIN": [
        *_JOIN,
        ("mapKey", "keys", AFTER_POSITION),
        ("bigTablePos", "Position of Big Table", AS_IS),
        ("joinVariant", "Map Join Variant", MADE),
    ],
    "GROUPBY": [
        ("key", "keys", AS_IS),
        ("outputCol", "outputCols", AS_IS),
        ("aggregation", "aggregations", AS_IS),
        ("implied", "distinct", MADE),
        ("explicit", "distinct", MADE),
    ],
    "SELECT": [("expr", "select", OF_KIND), ("outputCol", "outputCols", AS_IS)],
    "TABLESCAN": [
        ("alias", "alias", AS_IS),
        ("partitionCol", "partitionCols", AS_IS),
        ("filterExpr", "FilterExpr", AS_IS),
        ("rowLimit", "rowLimit", IF_POSITIVE),
    ],
    "FILESINK": [
        ("dirName", "dirName", AS_IS),
        ("otherDirName", "finalDirName", MADE),
        ("numFiles", "numFiles", AS_IS),
        ("partitionCol", "partitionCols", AS_IS),
    ],
    "REDUCESINK": [
        ("key", "key expressions", AS_IS),
        ("value", "value expressions", AS_IS),
        ("partitionCol", "Map-reduce partition columns", AS_IS),
        ("outputKey", "outputKey", AS_IS),
        ("outputCol", "outputCols", AS_IS),
        ("numReducers", "numReducers", IF_POSITIVE),
    ],
}
# The attribute and the words around it of operators that are told in one line.
PLAIN = {
    "EXTRACT": ("expr", "extract: ", ""),
    "FILTER": ("predicate", "", ""),
    "LIMIT": ("limit", "limit: ", ""),
    "SCRIPT": ("command", "", ""),
    "UNION": ("inputs", "union of ", " inputs"),
    "UDTF": ("name", "UDTF: ", ""),
}
# The attribute of which all values are told in one line, and the words before them.
SPACED = {"LATERALVIEWJOIN": ("outputCol", "Lateral View Join: "), "HASHTABLESINK": ("cond", "conditions: ")}


def per_plan(
    ops: DataFrame, attrs: DataFrame, columns: str, step: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, carried: Sequence[str] = ()
) -> DataFrame:
    """The described operators of whole queries, or what ``step`` makes of them.

    Operators and the attributes that some rule names meet by one shuffle on the query (``dealing``), and ``comments.written`` applies
    the rules to many queries at a time; ``step`` takes its batch. ``columns`` are the result's after query_id, ``carried`` are
    columns of the operators that it needs.
    """
    rules = comments.Rules(TITLES, PLAIN, SPACED, SORTED_JOIN)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    rows = ops.select(
        *OP, F.lit(True).alias("is_op"), F.col("op_type").alias("name"), F.col("variant").alias("value"), F.col("seq").cast("long").alias("number"),
        none.alias("kind"), *[text(c).alias(c) for c in carried],
    ).unionByName(
        attrs.where(F.col("attr").isin(*rules.attributes())).select(
            *OP, F.lit(False).alias("is_op"), F.col("attr").alias("name"), "value", F.col("pos").cast("long").alias("number"),
            "kind", *[none.alias(c) for c in carried],
        )
    )

    def told(table: pa.Table) -> pa.RecordBatch:
        made = comments.written(table, rules, carried)
        return step(made) if step else made

    kind = ops.schema["query_id"].dataType.simpleString()
    return whole_keys(rows, "query_id", told, f"query_id {kind}, {columns}", BATCH_NODES)


def operator_comment(ops: DataFrame, attrs: DataFrame) -> DataFrame:
    """The text that describes each operator, by its type; null for types that have none."""
    out = per_plan(ops, attrs, "stage_id string, op_id string, seq long, op_type string, comment string")
    return out.withColumn("seq", F.col("seq").cast(ops.schema["seq"].dataType))


def attribute_comment(attrs: DataFrame) -> DataFrame:
    """All attributes of each operator as labelled text, titles in first-seen order.

    The attributes of an operator meet by one shuffle on a hash of its ids; the lines of many operators are made together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_queries(batches, key="at"):
            yield comments.labelled(table)

    kinds = ", ".join(f"{c} {attrs.schema[c].dataType.simpleString()}" for c in OP)
    rows = attrs.select(F.xxhash64(*OP).alias("at"), *OP, "attr", F.col("pos").cast("long").alias("pos"), "value")
    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, f"{kinds}, comment string")


def mapred_stages(stages: DataFrame) -> DataFrame:
    return stages.where(F.col("stage_type") == MAPRED)


def complete_stages(stages: DataFrame) -> DataFrame:
    """Stages that have a job."""
    return stages.where("job_id is not null")


def stage_edges(stages: DataFrame) -> DataFrame:
    """``(query_id, from_stage, to_stage, kind)`` for the three kinds of successor."""
    kinds = {"children": "dependency", "backup": "backup", "conditional": "conditional"}

    def edges(successors: str, kind: str) -> Column:
        to = F.coalesce(successors, F.array().cast("array<string>"))
        return F.transform(to, lambda t: F.struct(t.alias("to_stage"), F.lit(kind).alias("kind")))

    all_edges = F.concat(*[edges(c, k) for c, k in kinds.items()])
    return stages.select(
        "query_id", F.col("stage_id").alias("from_stage"), F.explode(all_edges).alias("_e")
    ).select("query_id", "from_stage", "_e.to_stage", "_e.kind")


def root_stages(stages: DataFrame) -> DataFrame:
    """Stages that no other stage names as a dependent child."""
    child = stages.select("query_id", F.explode("children").alias("stage_id")).distinct()
    return stages.join(child, STAGE, "left_anti").select(*STAGE)


#: Edges above which a query's stages are not followed in one task.
LONG_QUERY = 1 << 20


def reachable_stages(stages: DataFrame, roots: DataFrame, long_query: int = LONG_QUERY) -> DataFrame:
    """Stages reached from the roots along any edge, each once.

    The edges of a query meet in one task, which follows those of many queries at a time, so that the number of
    jobs does not depend on the length of a path. Queries with more than ``long_query`` edges go by a
    join per step.
    """
    edges = staged(stage_edges(stages).select("query_id", "from_stage", "to_stage").distinct(), "edges")
    counts = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    long = staged(counts.where(F.col("n") > long_query).select("query_id"), "long-queries")
    if long.isEmpty():
        return _followed(stages, edges, roots)
    split = lambda df, how: df.join(long, "query_id", how)
    short = _followed(*(split(df, "left_anti") for df in (stages, edges, roots)))
    return short.unionByName(_by_steps(*(split(df, "left_semi") for df in (stages, edges, roots))))


def _followed(stages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``reachable_stages`` by one shuffle on the query."""
    none = F.lit(None).cast("string")
    rows = (
        edges.select("query_id", F.lit("edge").alias("what"), F.col("from_stage").alias("a"), F.col("to_stage").alias("b"))
        .unionByName(roots.select("query_id", F.lit("root").alias("what"), F.col("stage_id").alias("a"), none.alias("b")))
        .unionByName(stages.select("query_id", F.lit("stage").alias("what"), F.col("stage_id").alias("a"), none.alias("b")))
        .where("query_id is not null and a is not null")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_queries(batches):
            yield _reached(table)

    kind = stages.schema["query_id"].dataType.simpleString()
    dealt = rows.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(run, f"query_id {kind}, stage_id string")


def _reached(table: pa.Table) -> pa.RecordBatch:
    """Stages of whole queries that their roots lead to; every round follows the edges of all newest stages."""
    query = table.column("query_id").combine_chunks().dictionary_encode()
    names = pa.concat_arrays([table.column(c).combine_chunks() for c in ("a", "b")]).dictionary_encode()
    codes = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size, width = len(table), max(len(names.dictionary), 1)
    q = query.indices.to_numpy().astype(np.int64)
    a, b = q * width + codes[:size], np.where(codes[size:] < 0, -1, q * width + codes[size:])
    what = table.column("what").combine_chunks()
    edge, root, stage = (pc.equal(what, w).to_numpy(zero_copy_only=False) for w in ("edge", "root", "stage"))
    edge &= b >= 0
    nodes = np.unique(np.concatenate([a, b[edge]]))
    start, to = np.searchsorted(nodes, a[edge]), np.searchsorted(nodes, b[edge])
    order = np.argsort(start, kind="stable")
    start, to = start[order], to[order]
    cuts = np.searchsorted(start, np.arange(len(nodes) + 1))
    seen = np.zeros(len(nodes), bool)
    newest = np.unique(np.searchsorted(nodes, a[root]))
    while len(newest):
        seen[newest] = True
        counts = cuts[newest + 1] - cuts[newest]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(cuts[newest] - (ends - counts), counts)
        newest = np.unique(to[at])
        newest = newest[~seen[newest]]
    found = np.unique(a[stage & seen[np.searchsorted(nodes, a)]])
    return pa.RecordBatch.from_arrays(
        [query.dictionary.take(pa.array(found // width)), names.dictionary.take(pa.array(found % width)).cast(pa.string())],
        ["query_id", "stage_id"],
    )


def _by_steps(stages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``reachable_stages`` by joins: every round follows the edges out of the newest stages.

    Each round's result is written to the shared folder, so the plan does not grow, and the test for an
    empty round reads only that.
    """
    edges = edges.withColumnRenamed("to_stage", "stage_id")
    newest = staged(roots.select(*STAGE).distinct(), "reached")
    seen = newest
    while not newest.isEmpty():
        step = edges.join(
            newest.withColumnRenamed("stage_id", "from_stage"), ["query_id", "from_stage"], "left_semi"
        )
        newest = staged(step.select(*STAGE).distinct().join(seen, STAGE, "left_anti"), "reached")
        seen = seen.unionByName(newest)
    return seen.join(stages.select(*STAGE).distinct(), STAGE, "left_semi")


def named_output(queries: DataFrame, outputs: DataFrame) -> DataFrame:
    """Output type and name of every query; a table beats a directory, the last of its kind counts."""
    is_table = F.col("kind").isin("load_table", "create_table")
    rank = F.when(is_table, 2).when(F.col("kind") == "load_file", 1)
    name = F.when(
        F.col("kind") == "create_table", full_table_name("db", "target")
    ).otherwise(F.col("target"))
    best = outputs.withColumn("_rank", rank).where("_rank is not null").groupBy("query_id").agg(
        F.max_by(F.struct("_rank", name.alias("name")), F.struct("_rank", "seq")).alias("best")
    )
    kind = F.when(F.col("best._rank") == 2, "TABLE").when(F.col("best._rank") == 1, "DIRECTORY")
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.coalesce(kind, F.lit("FETCH")).alias("output_type"),
        F.col("best.name").alias("named_output"),
    )


def failure_summary(stages: DataFrame) -> DataFrame:
    """Of the stages that ended with an error, the last one's task, job, kind and code."""
    failed = stages.where("not running and exit_code <> 0")
    error = F.struct("stage_id", "job_id", "task_kind", "exit_code")
    return failed.groupBy("query_id").agg(F.max_by(error, "stage_no").alias("e")).select(
        "query_id",
        F.col("e.stage_id").alias("fail_task"),
        F.col("e.job_id").alias("fail_job"),
        F.col("e.task_kind").alias("fail_kind"),
        F.col("e.exit_code").alias("fail_code"),
    )


def error_chain(frames: DataFrame) -> DataFrame:
    """Stack frames of each query's error as lines, every cause under a heading of its own.

    A part of a heading that is missing reads null. A cause without frames is one row with a null
    frame and has its heading only.
    """
    part = {c: F.coalesce(c, F.lit("null")) for c in ("class", "text", "message")}
    heading = F.concat(
        F.lit("Caused By: "), part["class"], F.lit(", "), part["text"], F.lit(" ("), part["message"], F.lit(")")
    )
    rows = frames.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("chain_no", "frame_no", heading.alias("heading"), "frame"))
        ).alias("f")
    )

    def lines(x: Column, i: Column) -> Column:
        before = F.get("f", i - 1)["chain_no"]
        starts = (i == 0) | (before != x["chain_no"])
        return F.when(starts, F.array(x["heading"], x["frame"])).otherwise(F.array(x["frame"]))

    text = F.array_join(F.flatten(F.transform("f", lines)), "\n")
    return rows.select("query_id", text.alias("stack"))


def table_profile(cols: DataFrame) -> DataFrame:
    """One row per table: bucket, partition and sort columns, as text in position order."""
    # The two sort directions.
    direction = F.when(F.col("sort_order") == 1, "ASC").otherwise("DSC")

    def listed(role: str, value: Column) -> Column:
        entry = F.when(F.col("role") == role, F.struct("pos", value.alias("v")))
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]), ","
        )

    name = F.col("column_name")
    return cols.groupBy(
        F.concat_ws(".", "db", "table_name").alias("full_name"), "db", "table_name"
    ).agg(
        listed("bucket", name).alias("bucket_cols"),
        F.max("num_buckets").alias("num_buckets"),
        listed("partition", name).alias("partition_cols"),
        listed("sort", name).alias("sort_cols"),
        listed("sort", direction).alias("sort_props"),
        F.max("path").alias("path"),
    )


def lineage_report(edges: DataFrame) -> DataFrame:
    """Where each written column comes from, one text per query with a line per target column.

    A missing part of a source reads null.
    """
    parts = ("src_table", "src_alias", "src_col", "src_type", "comment")
    table, alias, column, kind, comment = (F.coalesce(c, F.lit("null")) for c in parts)
    source = F.concat(
        F.lit("("), table, F.lit(")"), alias, F.lit("."), column, F.lit(" "), kind, F.lit(" "), comment
    )
    target = ["query_id", "target_table", "partition_spec", "target_col"]
    lines = edges.groupBy(*target).agg(
        F.max("dep_type").alias("dep_type"),
        F.array_sort(F.collect_list(F.struct("base_pos", source.alias("s")))).alias("b"),
    )
    known = F.col("dep_type").isin("SIMPLE", "SCRIPT", "EXPRESSION")
    text = F.concat(
        "target_table",
        F.coalesce(F.concat(F.lit(" PARTITION("), "partition_spec", F.lit(")")), F.lit("")),
        F.lit("."), "target_col", F.lit(" "),
        F.when(known, F.col("dep_type")).otherwise("unknown"),
        F.lit(" ["), F.array_join(F.transform("b", lambda e: e["s"]), ", "), F.lit("]"),
    )
    place = F.struct(
        "target_table", F.col("partition_spec").isNotNull().alias("is_part"),
        F.coalesce("partition_spec", F.lit("")).alias("part"), "target_col", text.alias("line"),
    )
    report = F.array_join(
        F.transform(F.array_sort(F.collect_list(place)), lambda e: e["line"]), "\n"
    )
    return lines.groupBy("query_id").agg(F.concat(F.lit("Lineage: "), report).alias("details"))


def query_profile(
    queries: DataFrame,
    ops: DataFrame,
    attrs: DataFrame,
    aliases: DataFrame,
    stages: DataFrame,
    outputs: DataFrame,
    frames: DataFrame,
    lineage: DataFrame,
) -> DataFrame:
    """One nested record per query: plan stages with their operators, tables, edges and root stages,
    output, error with its stack, and where written columns come from.

    ``queries`` has ``(query_id, query_string, start_time, end_time, version)``; a preliminary record
    has no end time.
    """
    by = "query_id"
    stages = staged(stages, "stages")
    known = ops.where("stage_id is not null and op_id is not null")
    fields = " string, ".join(OPERATOR[1:]) + " string"
    listed = per_plan(
        known, attrs, f"operators array<struct<stage_id string, operators array<struct<seq long, {fields}>>>>", comments.by_stage, ("task_type", "parent_op_id")
    )
    keys = stage_keys(known, attrs).groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("stage_id", F.struct("join_type", "join_keys")))).alias("keys")
    )
    stage = lambda x: F.struct(
        x["stage_id"].alias("stage_id"), F.col("keys")[x["stage_id"]]["join_type"].alias("join_type"),
        F.col("keys")[x["stage_id"]]["join_keys"].alias("join_keys"), x["operators"].alias("operators"),
    )
    plan = listed.join(keys, by).select(by, F.transform("operators", stage).alias("stages"))
    tables = aliases.groupBy(by).agg(F.array_sort(F.collect_set("full_table")).alias("tables"))
    constant = const_filters(ops, attrs, aliases).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("stage_id", "op_id", "expr"))).alias("const_filters")
    )
    edges = stage_edges(stages).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("from_stage", "to_stage", "kind"))).alias("edges")
    )
    roots = root_stages(stages).groupBy(by).agg(F.array_sort(F.collect_list("stage_id")).alias("roots"))
    out = queries
    parts = (plan, tables, constant, edges, roots, failure_summary(stages), error_chain(frames), lineage_report(lineage))
    for part in parts:
        out = out.join(part, by, "left")
    return out.join(named_output(queries, outputs), by, "left")
