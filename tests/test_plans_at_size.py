"""Steps over plans, records and event logs do their work once, however deep the input; odd rows keep their results."""

import json

from wtel.operators import runs
from wtel.plans import plan_nodes, records
from wtel.sources import logs

OPS = "query_id long, stage_id string, task_type string, op_id string, parent_op_id string, op_type string, variant string, seq int"
ATTRS = "query_id long, stage_id string, op_id string, attr string, pos int, value string, kind string, alias string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, "")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_a_forest(spark):
    """A chain of a hundred operators takes as many jobs as one of three, to write and to read."""

    def chain(n):
        rows = [(1, "S", f"o{k:03}", "MAP", f"o{k - 1:03}" if k else None, k, "T", None) for k in range(n)]
        schema = "query_id long, stage_id string, op_id string, task_type string, parent_op_id string, seq int, op_type string, comment string"
        forest = records.operator_forest(spark.createDataFrame(rows, schema)).first().forest
        tasks = [{"taskId": "SMAP", "hiveOperatorInfos": json.loads(forest)}]
        doc = json.dumps({"queryId": "1", "hiveStageInfos": [{"stageId": "S", "hiveTaskInfos": tasks}]})
        read = records.read_records(spark.createDataFrame([(doc,)], "doc string"))
        assert max(r.depth for r in records.record_operators(read).collect()) == n

    assert jobs_of(spark, "short", lambda: chain(3)) == jobs_of(spark, "long", lambda: chain(100))


def test_odd_records_have_rows(spark):
    """Numbers are read as they are written; what is no object or no list has no operators below it."""
    nodes = [{"operatorId": 7, "comment": 1.50, "childHiveOperatorInfos": [{"operatorId": "b", "childHiveOperatorInfos": "x"}]}, 5]
    stage = {"stageId": "S", "hiveTaskInfos": [{"taskId": "T", "hiveOperatorInfos": nodes}, None]}
    docs = [json.dumps({"queryId": "q", "hiveStageInfos": [stage, {"stageId": "U"}]}), json.dumps({"queryId": "r", "hiveStageInfos": 3}), "[1]"]
    rows = spark.createDataFrame([("q", d) for d in docs], "queryId string, doc string")
    got = [(r.taskId, r.operatorId, r.comment, r.parentId, r.path) for r in records.record_operators(rows).collect()]
    assert got == [("T", "7", "1.5", None, [0]), ("T", "b", None, "7", [0, 0]), ("T", None, None, None, [1])]


def test_circles_hang_below_no_root(spark):
    rows = [(1, "S", o, "MAP", p, 0, "T", None) for o, p in (("a", "b"), ("b", "a"), ("c", None))]
    schema = "query_id long, stage_id string, op_id string, task_type string, parent_op_id string, seq int, op_type string, comment string"
    forest = records.operator_forest(spark.createDataFrame(rows, schema)).collect()
    assert [[n["operatorId"] for n in json.loads(r.forest)] for r in forest] == [["c"]]


def test_labelled_comments_without_lists(spark):
    """No operator's attributes are collected by an aggregate; null and empty values and titles are left out."""
    rows = [
        (1, "S", "a", "y", 1, "2"), (1, "S", "a", "x", 0, "é"), (1, "S", "a", "y", 0, "1"), (1, "S", "a", "z", None, "0"),
        (1, "S", "b", "x", 0, ""), (1, "S", "b", "x", 1, None), (1, None, "a", "x", 0, "n"), (None, "S", "a", "x", 0, "m"), (2, "S", "a", None, 0, "t"),
    ]
    attrs = spark.createDataFrame([(*r, None, None) for r in rows], ATTRS)
    out = plan_nodes.attribute_comment(attrs)
    assert "collect_list" not in optimized(out)
    got = {(r.query_id, r.stage_id, r.op_id): r.comment for r in out.collect()}
    assert got == {
        (1, "S", "a"): "z: 0\nx: é\ny: 1, 2", (1, "S", "b"): "", (1, None, "a"): "x: n", (None, "S", "a"): "x: m", (2, "S", "a"): "",
    }
    assert plan_nodes.attribute_comment(attrs.limit(0)).count() == 0


def test_operators_and_attributes_share_their_columns(spark):
    """What is shuffled for comments is a row of eight columns."""
    ops = spark.createDataFrame([(1, "S", "MAP", "a", None, "FILTER", "", 0)], OPS)
    attrs = spark.createDataFrame([(1, "S", "a", "predicate", 0, "(k > 1)", None, None)], ATTRS)
    out = plan_nodes.operator_comment(ops, attrs)
    assert [r.comment for r in out.collect()] == ["(k > 1)"]
    step = out._jdf.queryExecution().analyzed().toString().split("MapInArrow run(")[1]
    assert len(step.split(")")[0].split(",")) == 8


def test_profile_describes_operators_by_one_shuffle(spark):
    """Described operators are not joined with the operators again, and stages are computed once."""
    ops = spark.createDataFrame([(1, "S", "MAP", "a", None, "FILTER", "", 0), (1, "R", "MAP", "b", None, "LIMIT", "", 1)], OPS)
    attrs = spark.createDataFrame([(1, "S", "a", "predicate", 0, "(k > 1)", None, None)], ATTRS)
    empty = lambda schema: spark.createDataFrame([], schema)
    out = plan_nodes.query_profile(
        spark.createDataFrame([(1, "q", 0, 1, "1"), (2, "r", 0, 1, "1")], "query_id long, query_string string, start_time long, end_time long, version string"),
        ops, attrs, empty("query_id long, stage_id string, alias string, full_table string, pos int"),
        empty("query_id long, stage_id string, stage_no long, job_id string, children array<string>, backup array<string>, conditional array<string>,"
              " running boolean, exit_code int, task_kind string"),
        empty("query_id long, seq long, kind string, db string, target string"),
        empty("query_id long, chain_no int, frame_no int, class string, text string, message string, frame string"),
        empty("query_id long, target_table string, partition_spec string, target_col string, dep_type string, base_pos int, src_table string,"
              " src_alias string, src_col string, src_type string, comment string"),
    )
    joins = [line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "Join " in line and "op_id#" in line]
    assert len(joins) == 2  # attributes with their operators, for keys and for constant filters
    got = {r.query_id: r.stages for r in out.collect()}
    assert got[2] is None
    assert [(s.stage_id, [(o.op_id, o.comment) for o in s.operators]) for s in got[1]] == [("R", [("b", None)]), ("S", [("a", "(k > 1)")])]


def test_event_lines_are_parsed_once(spark):
    """Jobs of stages are found from rows that are written once; the latest job counts across days."""
    day = runs.DAY_MS
    job = lambda j, t: json.dumps({"Event": "SparkListenerJobStart", "Job ID": j, "Submission Time": t, "Stage IDs": [1]})
    stage = lambda t: json.dumps(
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Name": "s", "Number of Tasks": 1, "Completion Time": t}}
    )
    lines = [job(1, day - 5), job(2, day + 5), *[stage(t) for t in (1, day - 5, day, day + 5, 9 * day)]]
    frame = spark.createDataFrame([("a", x) for x in lines], "app string, line string")
    out = runs.stage_to_job(logs.stage_completed(frame), logs.job_start(frame))
    assert "from_json" not in optimized(out)
    assert sorted((r.completionTime, r.jobId) for r in out.collect()) == [(1, -1), (day - 5, 1), (day, 1), (day + 5, 2), (9 * day, 2)]
