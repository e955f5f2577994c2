"""Hand-made rows for the rules that are easy to get wrong."""

from pyspark.sql import functions as F

from wtel import schemas
from wtel.fixtures import registry
from wtel.functions import text, zones
from wtel.operators import changes, counters, layout, runs, workload
from wtel.plans import plan_nodes, semantics
from wtel.sources import logs, snapshots


def test_last_alias(spark):
    df = spark.createDataFrame([("a:b:c",), ("a:",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(text.last_alias("s")).collect()] == ["c", "a", "x", None]


def test_query_class(spark):
    queries = {
        "create table t (a int)": "ddl",
        "EXPLAIN select 1": "explain",
        "\nexplain select 1": "explain",
        "\n\nExplain select 1": "explain",
        "\n\n\nEXPLAIN select 1": "ignored",
        "\n\n\nEXPLAIN select 1 from rtbids": "retrieval",
        "insert 'select' into impressions": "retrieval",
        "SELECT 1 FROM other": "ignored",
    }
    df = spark.createDataFrame([(q,) for q in queries], "query_string string")
    got = {r.query_string: r["class"] for r in workload.classify(df).collect()}
    assert got == queries


def test_statsd_packets(spark):
    lines = {
        "my.prefix.a:5|c": ("a", 5, "c"),
        "your_pref.a:7|g": ("a", 7, "g"),  # the prefix is cut by length
        "my.prefix.a:-3|c": ("a", -3, "c"),
        "my.prefix.a:1:9|c": ("a", 1, "c"),
        "my.prefix.a5|c": None,
        "my.prefix.a: 5|c": None,
        "my.prefix.a:5|ms": None,
        "my.prefix.a:99999999999|c": None,
        "": None,
        "x|c": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = {r.seq: (r["name"], r.value, r.kind) for r in logs.parse_statsd(df, "my.prefix").collect()}
    assert got == {i: v for i, v in enumerate(lines.values()) if v}


def test_counter_modes(spark):
    df = spark.createDataFrame(
        [(1, "a", 10, "c"), (2, "a", 5, "c"), (3, "b", 7, "c")],
        "seq long, name string, value int, kind string",
    )
    assert {r["name"]: r.value for r in counters.counter_totals(df).collect()} == {"a": 15, "b": 7}
    literal = counters.counter_totals(df, first_counts_one=True)
    assert {r["name"]: r.value for r in literal.collect()} == {"a": 6, "b": 1}


def test_local_times(spark):
    stamps = {
        "201312031411": "2013-12-03 19:11:00",
        "201303100230": "2013-03-10 07:30:00",  # no such time: clocks go forward
        "201311030130": "2013-11-03 06:30:00",  # twice: the second one
        "201313320000": "2014-02-01 05:00:00",  # month 13 and day 32 roll over
    }
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    utc = zones.local_to_utc(zones.stamp_to_local(F.col("s")), zones.LOG_ZONE)
    got = {r.s: str(r.t) for r in df.select("s", utc.alias("t")).collect()}
    assert got == stamps


def _apps(spark, rows):
    names = schemas.names(schemas.APP)
    full = [
        (p, p * 10, *[row.get(n, 0 if f.dataType.typeName() != "string" else None)
                      if f.dataType.typeName() != "float" else 0.0
                      for n, f in zip(names, schemas.APP.fields)])
        for p, row in rows
    ]
    schema = "poll_no long, record_time long, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.APP.fields
    )
    return spark.createDataFrame(full, schema)


def test_app_changes_null_rules(spark):
    df = _apps(
        spark,
        [
            (1, {"id": "a", "state": "NEW", "queue": None, "name": "x", "elapsedTime": 1}),
            (2, {"id": "a", "state": "NEW", "queue": "q", "name": "x", "elapsedTime": 2}),
            (3, {"id": "a", "state": "NEW", "queue": "q", "name": None, "elapsedTime": 3}),
            (4, {"id": "a", "state": "NEW", "queue": "q", "name": None, "elapsedTime": 4}),
            (6, {"id": "a", "state": "NEW", "queue": "q", "name": None, "elapsedTime": 6}),
        ],
    )
    got = changes.app_changes(df).collect()
    by_poll = {}
    for r in got:
        by_poll.setdefault(r.RecordTime // 10, {})[r.MetricsName] = r.Value
    assert len(by_poll[1]) == 19 and by_poll[1]["queue"] == "null"
    assert by_poll[2] == {"queue": "q", "elapsedTime": "2"}
    assert 3 not in by_poll and 4 not in by_poll
    assert len(by_poll[6]) == 19  # absent from poll 5, so new again


def _node_apps(spark, rows):
    return spark.createDataFrame(
        [(p, p, n, i, "u", s, c) for p, n, i, s, c in rows],
        "poll_no long, record_time long, node string, id string, user string, state string,"
        " containerids array<string>",
    )


def test_finished_applications(spark):
    df = _node_apps(
        spark,
        [
            (1, "n1", "old", "FINISHED", None), (2, "n1", "old", "FINISHED", None),
            (1, "n1", "a", "RUNNING", ["c1"]), (2, "n1", "a", "FINISHED", ["c1"]),
            (2, "n2", "a", "RUNNING", ["c2"]), (3, "n2", "a", "RUNNING", ["c2"]),
            (3, "n1", "late", "FINISHED", []), (4, "n1", "late", "FINISHED", []),
        ],
    )
    kept = sorted((r.id, r.node, r.poll_no) for r in changes.suppress_finished(df).collect())
    assert kept == [("a", "n1", 1), ("a", "n1", 2), ("a", "n2", 2), ("late", "n1", 3)]
    rows = sorted(
        (r.appId, r.nodeAddress, r.RecordTime, r.MetricsName, r.Value)
        for r in changes.node_app_changes(df).collect()
    )
    assert [r for r in rows if r[0] == "a" and r[2] == 2 and r[1] == "n1"] == [
        ("a", "n1", 2, "containerId", "c1"), ("a", "n1", 2, "state", "FINISHED"),
        ("a", "n1", 2, "user", "u"),
    ]
    assert not [r for r in rows if r[0] == "old"]


def test_container_delta(spark):
    cases = [
        (None, ["a"], ["a"]), ([], ["a", "b"], ["a", "b"]), (["a"], ["a", "b"], ["a", "b"]),
        (["a", "b"], ["a", "c"], ["c"]), (["a", "b"], ["a"], ["a"]), (["a"], None, []),
        (None, None, []), (["a", "b"], ["b", "a"], []),
    ]
    rows = []
    for i, (old, new, _) in enumerate(cases):
        rows += [(1, "n", f"app{i}", "RUNNING", old), (2, "n", f"app{i}", "RUNNING", new)]
    got = {}
    for r in changes.container_delta(_node_apps(spark, rows)).collect():
        got.setdefault(r.appId, []).append(r.Value)
    assert {k: sorted(v) for k, v in got.items()} == {
        f"app{i}": want for i, (_, _, want) in enumerate(cases) if want
    }


def test_bad_documents_give_no_rows(spark):
    docs = [(1, '{"apps":null}'), (2, '{"apps":{}}'), (3, "["), (4, '{"apps":{"app":[]}}'),
            (5, '{"apps":{"app":[{"id":"a","zzz":1}]}}')]
    df = spark.createDataFrame(docs, "poll_no long, doc string")
    assert [(r.poll_no, r.id) for r in snapshots.read_apps(df).collect()] == [(5, "a")]


def test_stage_end_times(spark):
    rows = [
        (1, 1, "s1", "MAPRED", "j1"), (1, 2, "s2", "MOVE", None), (1, 3, "s3", "MAPRED", "j3"),
        (1, 4, "s4", "MAPRED", "unknown"), (1, 5, "s5", "MAPRED", "j5"),
        (2, 1, "only", "MAPRED", "j9"),
    ]
    stages = spark.createDataFrame(
        [(*r, ["x"] if r[1] == 1 else [], 100, 900) for r in rows],
        "query_id long, stage_no int, stage_id string, stage_type string, job_id string,"
        " children array<string>, query_start long, query_end long",
    )
    jobs = spark.createDataFrame(
        [("j1", 110), ("j3", 300), ("j5", 500), ("j9", 150)], "job_id string, start_time long"
    )
    got = {r.stageId: (r.startTime, r.endTime) for r in runs.stage_end_times(stages, jobs).collect()}
    assert got == {
        "s1": (100, 300), "s3": (300, 500), "s4": (300, 500), "s5": (500, 900), "only": (100, 900),
    }


def test_stage_in_two_jobs_and_in_none(spark):
    stages = spark.createDataFrame(
        [("a", 1, 50), ("a", 1, 150), ("a", 1, 250), ("a", 2, 250)],
        "app string, stageId int, completionTime long",
    )
    jobs = spark.createDataFrame(
        [("a", 7, 100, [1]), ("a", 8, 200, [1, 3])],
        "app string, jobId int, startTime long, stageIds array<int>",
    )
    got = sorted((r.stageId, r.completionTime, r.jobId) for r in runs.stage_to_job(stages, jobs).collect())
    assert got == [(1, 50, -1), (1, 150, 7), (1, 250, 8), (2, 250, -1)]


def test_named_output(spark):
    queries = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    outputs = spark.createDataFrame(
        [
            (1, 1, "load_table", None, "t"), (1, 2, "load_file", None, "/f"),
            (2, 1, "load_file", None, "/f"), (2, 2, "load_file", None, "/g"),
            (3, 1, "load_file", None, "/f"), (3, 2, "create_table", None, "t"),
            (4, 1, "other", None, "x"),
        ],
        "query_id long, seq int, kind string, db string, target string",
    )
    got = {r.query_id: (r.output_type, r.named_output)
           for r in plan_nodes.named_output(queries, outputs).collect()}
    assert got == {
        1: ("TABLE", "t"), 2: ("DIRECTORY", "/g"), 3: ("TABLE", "default.t"), 4: ("FETCH", None),
        5: ("FETCH", None),
    }


def test_long_walks_cross_chunks(spark):
    """A query whose tables and columns lie many chunks apart still finds its tables."""
    rows = [(1, [0], 0, "TOK_QUERY", "TOK_QUERY"), (1, [0, 0], 1, "TOK_FROM", "TOK_FROM"),
            (1, [0, 0, 0], 2, "TOK_TABREF", "TOK_TABREF"),
            (1, [0, 0, 0, 0], 3, "TOK_TABNAME", "TOK_TABNAME"),
            (1, [0, 0, 0, 0, 0], 4, "Identifier", "big"),
            (1, [0, 1], 5, "TOK_INSERT", "TOK_INSERT"), (1, [0, 1, 0], 6, "TOK_SELECT", "TOK_SELECT")]
    order = 7
    for i in range(3000):
        base = [0, 1, 0, i]
        rows += [(1, base, order, "TOK_SELEXPR", "TOK_SELEXPR"),
                 (1, [*base, 0], order + 1, "TOK_TABLE_OR_COL", "TOK_TABLE_OR_COL"),
                 (1, [*base, 0, 0], order + 2, "Identifier", f"c{i}")]
        order += 3
    nodes = spark.createDataFrame(
        rows, "query_id long, path array<int>, node_order int, token string, text string"
    )
    got = semantics.projections(semantics.analyse(nodes)).collect()
    assert len(got) == 3000
    assert {r.tabName for r in got} == {"big"}


def test_error_chain_with_missing_parts(spark):
    rows = [
        (1, 0, 1, "A", "a.A: x", "x", "f1"), (1, 0, 2, "A", "a.A: x", "x", "f2"),
        (1, 1, 1, "B", "b.B", None, "g1"), (1, 2, 1, "C", None, "no frames", None),
    ]
    schema = "query_id long, chain_no int, frame_no int, class string, text string, message string, frame string"
    got = plan_nodes.error_chain(spark.createDataFrame(rows, schema)).first().stack
    assert got.split("\n") == [
        "Caused By: A, a.A: x (x)", "f1", "f2", "Caused By: B, b.B (null)", "g1", "Caused By: C, null (no frames)",
    ]


def test_lineage_with_missing_parts(spark):
    rows = [(1, "t", None, "c", "SIMPLE", 1, "s1", "a", "x", "int", "n"), (1, "t", None, "c", "SIMPLE", 2, "s2", None, "y", None, None)]
    schema = (
        "query_id long, target_table string, partition_spec string, target_col string, dep_type string, base_pos int,"
        " src_table string, src_alias string, src_col string, src_type string, comment string"
    )
    got = plan_nodes.lineage_report(spark.createDataFrame(rows, schema)).first().details
    assert got == "Lineage: t.c SIMPLE [(s1)a.x int n, (s2)null.y null null]"


def test_clauses_that_no_walker_enters(spark):
    """Columns under HAVING, ORDER BY or a table reference belong to no clause; under FROM they do."""
    column = ("TOK_TABLE_OR_COL", None, [("id", "c", [])])
    tree = ("TOK_QUERY", None, [
        ("TOK_FROM", None, [("TOK_JOIN", None, [
            ("TOK_TABREF", None, [("TOK_TABNAME", None, [("id", "t", [])]), ("TOK_TABLEBUCKETSAMPLE", None, [column])]),
            column,
            column,
        ])]),
        ("TOK_INSERT", None, [
            ("TOK_SELECT", None, [("TOK_SELEXPR", None, [column])]),
            ("TOK_HAVING", None, [column]),
            ("TOK_ORDERBY", None, [column]),
        ]),
    ])
    rows = []

    def add(node, path):
        token, label, below = node
        rows.append((1, path, len(rows), token, label))
        for i, child in enumerate(below):
            add(child, [*path, i])

    add(tree, [0])
    nodes = spark.createDataFrame(rows, "query_id long, path array<int>, node_order int, token string, text string")
    got = semantics.clause_of(semantics.analyse(nodes)).collect()
    found = sorted((r.clause, r.token) for r in got)
    assert found == [
        ("FROM", "TOK_TABLE_OR_COL"), ("FROM", "TOK_TABREF"), ("JOIN_ON", "TOK_TABLE_OR_COL"), ("SELEXPR", "TOK_TABLE_OR_COL"),
    ]


def test_missing_job_ids_and_tags_of_two_tables(spark):
    stages = spark.createDataFrame([(1, None), (2, "j1"), (3, "j9"), (4, None)], "n int, job_id string")
    jobs = spark.createDataFrame([("j1", 5)], "job_id string, start_time long")
    got = {r.n: r.job_start for r in runs.stage_job_start(stages, jobs).collect()}
    assert got == {1: None, 2: 5, 3: None, 4: None}
    tags = [("counts", "a"), ("gauges", "a"), ("gauges", "b")]
    registry = spark.createDataFrame(tags, "table_name string, tag string")
    values = spark.createDataFrame([("counts", "a", 3), ("gauges", "a", 8)], "table_name string, tag string, value long")
    got = {(r.table_name, r.tag): r.value for r in counters.registry_values(registry, values).collect()}
    assert got == {("counts", "a"): 3, ("gauges", "a"): 8, ("gauges", "b"): -1}


def test_preferred_record_of_equal_ones(spark):
    """Two records of one query in one place: the greatest text, in whatever order they are read."""
    rows = [("t", "executing", "q", layout.PRELIMINARY_FILE, r) for r in ("record 1", "preliminary 1", "a")]
    schema = "top string, state string, query_id string, file string, record string"
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        files = spark.createDataFrame(order, schema).coalesce(1)
        assert [r.record for r in layout.preferred_record(files).collect()] == ["record 1"]


def test_run_tables_read_their_own_level(spark):
    """The table of workflows needs no event of a query, and none of the tables is written on the way."""
    rows = registry.QUERIES["tbl_workflows"](spark, "/root/testdata/sf0.001")
    assert not [f for f in rows.inputFiles() if "lineitem" in f or "/runs-" in f]
