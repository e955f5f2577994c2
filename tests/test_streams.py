"""A backlog in many micro-batches gives what one batch gives."""

import uuid

import pytest
from pyspark.sql import functions as F

from wtel.fixtures import queries_streams
from wtel.fixtures.views import view
from wtel.operators import changes, runs
from wtel.sinks import tables, versions
from wtel.sources import snapshots
from wtel.streaming import jobs, state

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("job", ["cluster", "apps"])
def test_backlog(spark, tmp_path, job):
    name, start, read, batch = {
        "cluster": ("cluster_docs", jobs.cluster_changes, jobs.parts, lambda d: changes.cluster_changes(snapshots.read_cluster_metrics(d))),
        "apps": ("apps_docs", jobs.app_changes, jobs.parts, lambda d: changes.app_changes(snapshots.read_apps(d))),
    }[job]
    docs = view(spark, SF_DIR, name).cache()
    landing, out, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))
    polls = sorted({r.poll_no for r in docs.select("poll_no").collect()})
    for k in range(3):  # later files hold later polls
        part = polls[k * len(polls) // 3 : (k + 1) * len(polls) // 3]
        docs.where(docs.poll_no.between(part[0], part[-1])).coalesce(1).write.mode("append").parquet(landing)
    query = start(jobs.landed(spark, landing, docs.schema, max_files=1), out, checkpoint)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    want = batch(docs)
    got = read(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def landed_run(spark, folder, batches, start):
    """Land each batch as a file and run the job over all of them, a file per micro-batch."""
    landing, out, checkpoint = (str(folder / x) for x in ("landing", "out", "checkpoint"))
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(landing)
    query = start(jobs.landed(spark, landing, batches[0].schema, max_files=1), out, checkpoint)
    query.awaitTermination()
    assert query.exception() is None
    return out, checkpoint


NODE_APPS = "poll_no long, record_time timestamp, node string, doc string"


def node_docs(spark, polls):
    """A document per (poll, node): {node: [(id, state), ...]}."""
    rows = []
    for poll, nodes in polls:
        for node, apps in nodes.items():
            items = ",".join(f'{{"id":"{i}","user":"u","state":"{x}","containerids":["c{poll}"]}}' for i, x in apps)
            rows.append((poll, None, node, f'{{"apps":{{"app":[{items}]}}}}'))
    return spark.createDataFrame(rows, NODE_APPS)


def test_one_key_with_all_rows(spark, tmp_path):
    """One application in every poll: equal to the batch operator, and no task is given more than a chunk of it."""
    docs = node_docs(spark, [(p, {"n1": [("a", "RUNNING")]}) for p in range(3000)])
    batches = [docs.where(docs.poll_no.between(1000 * k, 1000 * k + 999)) for k in range(3)]
    out, checkpoint = landed_run(spark, tmp_path, batches, lambda d, o, c: jobs.node_app_changes(d, 0, o, c))
    want = changes.node_app_changes(snapshots.read_node_apps(docs), 0)
    got = jobs.parts(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert versions.read(spark, f"{checkpoint}-polls", 2).count() == 1  # what is remembered: the last poll
    plan = changes.with_previous_poll(snapshots.read_node_apps(docs), ["node", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan[plan.index("hashpartitioning") :].split("\n")[0]


def test_finished_and_silent_ones_are_forgotten(spark, tmp_path):
    """What is remembered shrinks; an application that comes back after the horizon is a new one."""
    polls = [
        (1, {"n1": [("a", "RUNNING"), ("b", "RUNNING")], "n2": [("z", "RUNNING")]}),
        (2, {"n1": [("a", "FINISHED"), ("b", "RUNNING")]}),
        (3, {"n1": [("a", "FINISHED"), ("b", "RUNNING")]}),
        *[(p, {"n1": [("b", "RUNNING")]}) for p in range(4, 40)],
        (40, {"n1": [("a", "RUNNING"), ("b", "RUNNING")], "n2": [("z", "RUNNING")]}),
    ]
    docs = node_docs(spark, polls)
    batches = [docs.where(docs.poll_no.between(*x)) for x in ((1, 1), (2, 3), (4, 39), (40, 40))]
    out, checkpoint = landed_run(spark, tmp_path, batches[:2], lambda d, o, c: jobs.node_app_changes(d, 1, o, c, horizon=20))
    finished = lambda k: {r.id for r in versions.read(spark, f"{checkpoint}-finished", k).collect()}
    polls_ = lambda k: {(r.node, r.id) for r in versions.read(spark, f"{checkpoint}-polls", k).collect()}
    assert finished(1) == {"a"} and polls_(1) == {("n1", "b"), ("n2", "z")}
    for k, rows in ((2, batches[2]), (3, batches[3])):
        landed_run(spark, tmp_path, [rows], lambda d, o, c: jobs.node_app_changes(d, 1, o, c, horizon=20))
        if k == 2:
            assert finished(2) == set() and polls_(2) == {("n1", "b")}
    rows = [(r.part, r.nodeAddress, r.appId, r.MetricsName) for r in spark.read.parquet(out).collect()]
    new = {(n, a) for part, n, a, m in rows if part == 3 and m == "user"}
    assert new == {("n1", "a"), ("n2", "z")}
    assert not [r for r in rows if r[0] in (1, 2) and r[2] == "a" and r[3] == "user" and r[0] == 2]


EVENTS = "run long, level string, kind string, key long, parent long, name string, engine string, user_name string, ts long"


def test_starts_of_ended_runs_are_forgotten(spark, tmp_path):
    def event(run, level, kind, key, ts):
        return (run, level, kind, key, 0, "n", "e", "u", ts)

    rows = [
        event(1, "workflow", "started", 1, 10), event(1, "query", "started", 5, 20), event(2, "workflow", "started", 2, 30),
        event(1, "query", "completed", 5, 40), event(1, "workflow", "completed", 1, 50), event(2, "query", "started", 7, 60),
        event(2, "query", "completed", 7, 9000), event(2, "workflow", "completed", 2, 9500),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    batches = [events.where(events.ts.between(*x)) for x in ((0, 35), (36, 100), (101, 9100), (9101, 9999))]
    out, checkpoint = landed_run(spark, tmp_path, batches[:3], jobs.paired_events)
    kept = {(r.run, r.level) for r in versions.read(spark, f"{checkpoint}-starts", 2).collect()}
    assert kept == {(2, "workflow"), (2, "query")}
    landed_run(spark, tmp_path, batches[3:], jobs.paired_events)
    assert versions.read(spark, f"{checkpoint}-starts", 3).count() == 0
    want = runs.pair_events(events)
    got = jobs.parts(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    old = state.last_starts(events.where("ts <= 9000 and not (level = 'workflow' and kind = 'completed')"), 100)
    assert [tuple(r) for r in old.select("run", "level").collect()] == []  # both starts are older than 100 ms


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    first, second = spark.range(3), spark.range(5)
    assert versions.publish(first, root) == 0
    versions.write(second, root, 1)  # dies before the switch
    assert versions.current(spark, root).count() == 3
    assert versions.publish(second, root) == 1  # the repeated writer
    assert versions.current(spark, root).count() == 5
    for n in (6, 7):
        versions.publish(spark.range(n), root)
    assert versions.current(spark, root).count() == 7
    assert versions.published(spark, root) == [2, 3]
    assert [n for n in versions.names(spark, root) if n.startswith("version=")] == ["version=2", "version=3"]


def test_tags_are_published(spark, tmp_path):
    tags = spark.createDataFrame([("counts", "a", "1"), ("gauges", "b", "2")], "table_name string, tag string, value string")
    tables.write_tags(tags, str(tmp_path))
    versions.write(tags.limit(0), tables.table_path(str(tmp_path), "tags"), 1)
    assert tables.read_tags(spark, str(tmp_path)).count() == 2


def test_parts_of_states_are_merged(spark, tmp_path):
    """Over fifty batches a reader finds the right states in a bounded number of files."""
    out = str(tmp_path / "out")
    want = {}
    for number in range(50):
        rows = [("t", f"q{number}", "executing")] + ([("t", f"q{number - 1}", "completed")] if number else [])
        want.update({q: x for _, q, x in rows})
        batch = spark.createDataFrame([(*r, number) for r in rows], "top string, query_id string, state string, batch int")
        jobs._part(batch.coalesce(1), out, number)
        if number % 10 == 9:
            jobs.compact_states(spark, out, number)
        if number == 29:
            jobs._part(batch.coalesce(1), out, number)  # a batch that is repeated after the merge
    got = {r.query_id: r.state for r in jobs.latest_states(spark, out).collect()}
    assert got == want
    assert len(jobs._tail(spark, out, versions.latest(spark, f"{out}/base"))) <= 10
    assert len([n for n in versions.names(spark, out) if n.startswith("part=")]) <= 11
    assert versions.latest(spark, f"{out}/base") == 49


class Landed:
    """A job that only looks at what has landed."""

    def awaitTermination(self):
        pass

    def exception(self):
        return None


def test_halves_hold_every_row_once(spark, monkeypatch):
    """The middle may come out otherwise each time it is computed, and rows may have none: all rows land, once."""
    around = F.udf(lambda top: uuid.uuid4().int % top, "long").asNondeterministic()
    monkeypatch.setattr(queries_streams.F, "percentile_approx", lambda c, p: around(F.max(c)))
    rows = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("seq"))
    landed = []

    def start(df, out, checkpoint):
        landed.append(out.replace("/out", "/landing"))
        return Landed()

    queries_streams.replay(spark, rows, "seq", start)
    got = [r.seq for r in spark.read.parquet(landed[0]).collect()]
    assert sorted(got, key=str) == sorted([None if k == 7 else k for k in range(1000)], key=str)


def test_many_files_in_no_order(spark):
    """A landing of more files than a micro-batch usually takes, with polls in no order, is compared as a whole."""
    docs = view(spark, SF_DIR, "cluster_docs").repartition(jobs.MAX_FILES * 2 + 3).cache()
    got = jobs.parts(spark, queries_streams.replay(spark, docs, "poll_no", jobs.cluster_changes))
    want = changes.cluster_changes(snapshots.read_cluster_metrics(docs))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_finished_long_before_the_end_of_a_batch(spark, tmp_path):
    """An application stays finished for the rest of a micro-batch that spans more polls than the horizon."""
    polls = [(p, {"n1": [("a", "FINISHED" if p == 3 else "RUNNING"), ("b", "RUNNING")]}) for p in range(1, 6)]
    polls += [(p, {"n1": [("b", "RUNNING")]}) for p in range(6, 60)]
    docs = node_docs(spark, polls)
    out, _ = landed_run(spark, tmp_path, [docs], lambda d, o, c: jobs.node_app_changes(d, 1, o, c, horizon=20))
    want = changes.node_app_changes(snapshots.read_node_apps(docs), 1)
    got = jobs.parts(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
