"""Records of any depth survive writing and reading; stages are followed like a plain walk."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wtel.plans import forests, plan_nodes, records
from wtel.sinks import tables

OPS = "query_id long, stage_id string, op_id string, task_type string, parent_op_id string, seq int, op_type string, comment string"


def random_ops(seed):
    """Forests with chains of a dozen levels, parents in other tasks, odd comments."""
    rng = random.Random(seed)
    rows = []
    for q in range(12):
        for s in range(rng.randrange(1, 3)):
            for task in ("MAP", "REDUCE")[: rng.randrange(1, 3)]:
                own = []
                for k in range(rng.randrange(1, 14)):
                    parent = rng.choice([*own[-2:], *own[-2:], None, "elsewhere"]) if own else None
                    op = f"{task}_{k}"
                    comment = rng.choice([None, "", 'say "hi"\n{"a": [1]}', "é\\", "x"])
                    rows.append((q, f"Stage-{s}", op, task, parent, k, f"T{k % 3}", comment))
                    own.append(op)
    return rows


def nested(rows):
    """The plain nesting of each task's operators."""
    out = {}
    by = {}
    for q, s, op, task, parent, seq, kind, comment in sorted(rows, key=lambda r: r[5]):
        node = {"operatorId": op, "operatorType": kind, "childHiveOperatorInfos": []}
        if comment is not None:
            node["comment"] = comment
        by[q, s, task, op] = node
        above = by.get((q, s, task, parent))
        (above["childHiveOperatorInfos"] if above else out.setdefault((q, s, task), [])).append(node)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forests(spark, tmp_path, seed):
    rows = random_ops(seed)
    forest = records.operator_forest(spark.createDataFrame(rows, OPS))
    got = {(r.query_id, r.stage_id, r.task_type): json.loads(r.forest) for r in forest.collect()}
    want = nested(rows)
    assert got == want
    docs = []
    for q in sorted({r[0] for r in rows}):
        stages = [
            {"stageId": s, "hiveTaskInfos": [{"taskId": s + t, "taskType": t, "hiveOperatorInfos": f} for (p, x, t), f in want.items() if (p, x) == (q, s)]}
            for s in sorted({x for p, x, _ in want if p == q})
        ]
        docs.append(("completed", str(q), json.dumps({"queryId": str(q), "hiveStageInfos": stages})))
    frame = spark.createDataFrame([*docs, ("completed", "99", "{broken")], "state string, queryId string, record string")
    tables.write_documents(frame, str(tmp_path / "docs"), per_query=True)
    read = records.read_records(tables.read_documents(spark, str(tmp_path / "docs")))
    assert read.count() == len(docs)
    found = {(r.queryId, r.stageId, r.taskId, r.operatorId): (r.parentId, r.operatorType, r.comment, r.depth) for r in records.record_operators(read).collect()}
    by = {(q, s, t, op): p for q, s, op, t, p, *_ in rows}

    def depth(key):
        q, s, t, _ = key
        return 1 + (depth((q, s, t, by[key])) if (q, s, t, by[key]) in by else 0)

    assert found == {
        (str(q), s, s + t, op): (p if (q, s, t, p) in by else None, kind, comment, depth((q, s, t, op)))
        for q, s, op, t, p, _, kind, comment in rows
    }


def test_every_field_is_read_back(spark):
    """A document with all fields gives all of them; unknown ones are ignored, records without stages have none."""
    values = {"string": "x", "bigint": 5, "int": 7, "boolean": True, "array<string>": ["p", "q"], "map<string,string>": {"k": "v"}}

    def filled(schema):
        out = {}
        for f in schema.fields:
            kind = f.dataType.simpleString()
            if kind in values:
                out[f.name] = values[kind]
            elif kind.startswith("array<struct"):
                out[f.name] = [filled(f.dataType.elementType)]
            else:
                out[f.name] = {"db.t": filled(f.dataType.valueType)}
        return out

    whole = filled(records.RECORD)
    docs = [(json.dumps({**whole, "newField": 1}),), (json.dumps({"queryId": "bare"}),), ("not json",), (None,)]
    read = records.read_records(spark.createDataFrame(docs, "doc string"))
    assert read.count() == 2
    own = records.record_queries(read).where("queryId = 'x'").first().asDict()
    assert own == {k: whole[k] for k in own}
    stage = records.record_stages(read).drop("queryId").first().asDict(recursive=True)
    assert stage == whole["hiveStageInfos"][0]
    table = records.record_tables(read).drop("queryId", "name").first().asDict()
    assert table == whole["fullTableNameToInfos"]["db.t"]
    assert records.record_operators(read).count() == 0


def test_reachable_stages(spark):
    rng = random.Random(3)
    stages, roots, want = [], [], set()
    for q in range(40):
        names = [f"s{k}" for k in range(rng.randrange(1, 30))]
        chain = q % 4 == 0
        edges = {}
        for k, name in enumerate(names):
            if chain:
                edges[name] = names[k + 1 : k + 2]
            else:
                edges[name] = [rng.choice([*names, "gone"]) for _ in range(rng.randrange(3))]
            stages.append((q, name, edges[name], None if rng.random() < 0.5 else [rng.choice(names)] if not chain else None, None))
            edges[name] = edges[name] + (stages[-1][3] or [])
        start = rng.sample(names, 1)
        roots += [(q, s) for s in start]
        seen, open_ = set(), list(start)
        while open_:
            s = open_.pop()
            if s not in seen:
                seen.add(s)
                open_ += edges.get(s, [])
        want |= {(q, s) for s in seen if s in names}
    frame = spark.createDataFrame(stages, "query_id long, stage_id string, children array<string>, backup array<string>, conditional array<string>")
    roots_ = spark.createDataFrame(roots, "query_id long, stage_id string")
    for long in (1 << 20, 20, -1):
        got = [tuple(r) for r in plan_nodes.reachable_stages(frame, roots_, long).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want
    assert plan_nodes.reachable_stages(frame.limit(0), roots_.limit(0)).count() == 0


def test_jobs_do_not_grow_with_the_path(spark):
    """A path of a thousand stages takes as many jobs as one of ten."""

    def jobs(n):
        rows = [(1, f"s{k}", [f"s{k + 1}"], None, None) for k in range(n)]
        frame = spark.createDataFrame(rows, "query_id long, stage_id string, children array<string>, backup array<string>, conditional array<string>")
        roots = spark.createDataFrame([(1, "s0")], "query_id long, stage_id string")
        spark.sparkContext.setJobGroup(f"path-{n}", "")
        assert plan_nodes.reachable_stages(frame, roots).count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"path-{n}"))

    assert jobs(10) == jobs(1000)


def test_record_of_nothing(spark):
    assert records.operator_forest(spark.createDataFrame([], OPS)).count() == 0
    docs = spark.createDataFrame([], "doc string").withColumn("state", F.lit("x"))
    assert records.record_operators(records.read_records(docs)).count() == 0


def test_documents_are_compressed(spark, tmp_path, monkeypatch):
    """Documents of a state are compressed files of bounded size; what is in them is read back as it is."""
    monkeypatch.setattr(tables, "FILE_DOCUMENTS", 10)
    docs = [("completed", str(i), json.dumps({"queryId": str(i), "comments": "é" * 500})) for i in range(25)]
    frame = spark.createDataFrame(docs, "state string, queryId string, record string").coalesce(1)
    tables.write_documents(frame, str(tmp_path / "docs"))
    files = [f for f in (tmp_path / "docs" / "state=completed").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < 25 * 200
    assert sorted(r.doc for r in tables.read_documents(spark, str(tmp_path / "docs")).collect()) == sorted(d[2] for d in docs)


def test_forests_of_a_query_stay_together():
    """The forests of each query are one row, by stage and task."""
    rows = [(q, s, t, "o", None, "T", 0, None) for q in (7, 3) for s in ("S2", "S1") for t in ("REDUCE", "MAP")]
    names = ["query_id", "stage_id", "task_type", "op_id", "parent_op_id", "op_type", "seq", "comment"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    told = forests.texts(table, records.CHILDREN)
    got = forests.by_query(told).to_pylist()
    assert sorted(r["query_id"] for r in got) == [3, 7]
    for r in got:
        assert [(f["stage_id"], f["task_type"]) for f in r["forests"]] == [(s, t) for s in ("S1", "S2") for t in ("MAP", "REDUCE")]
    assert forests.by_query(told.slice(0, 0)).num_rows == 0
