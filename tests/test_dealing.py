"""Rows dealt by key in packed blocks are the same rows, each key's in one table."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wtel.plans import dealing, semantics

SCHEMA = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int32()), ("ok", pa.bool_()), ("other", pa.string())])


def rows_of(seed: int, keys: int, text: bool) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for _ in range(600):
        k = rng.randrange(-keys, keys) << rng.choice((0, 20))
        out.append((f"k{k}" if text else k, rng.choice(["a", "é", "", None, f"w{rng.random()}"]), rng.choice([None, 1, -7]), rng.choice([True, None]), None))
    return out


def dealt(rows: list[tuple], text: bool, chunk: int, most: int, at_once: int) -> list[list[tuple]]:
    schema = SCHEMA.set(0, pa.field("id", pa.string())) if text else SCHEMA
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 70]], schema) for i in range(0, len(rows), 70)]
    kinds = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("packed", pa.binary())])
    blocks = pa.Table.from_batches(dealing.packed(iter(batches), "id", chunk), kinds).sort_by("bucket")
    texts = {"id", "word", "other"} if text else {"word", "other"}
    return [[tuple(r.values()) for r in t.to_pylist()] for t in dealing.opened(iter(blocks.to_batches(5)), "id", texts, at_once, most)]


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("chunk, most, at_once", [(1 << 20, 1 << 20, 1), (100, 40, 10), (100, 4, 1), (100, 1 << 20, 1 << 20)])
def test_dealt_rows_are_whole(text, chunk, most, at_once):
    for keys in (1, 40, 1000):
        rows = rows_of(keys, keys, text)
        tables = dealt(rows, text, chunk, most, at_once)
        assert sorted((r for t in tables for r in t), key=repr) == sorted(rows, key=repr)
        assert len({r[0] for r in rows}) == sum(len({r[0] for r in t}) for t in tables)  # no key in two of them
    assert dealt([], text, chunk, most, at_once) == []


def test_nodes_are_shuffled_packed(spark):
    """Nodes go through the shuffle as blocks, at a few bytes a node."""
    from wtel.fixtures.views import view

    nodes = view(spark, "/root/testdata/sf0.001", "ast_nodes").coalesce(1)
    plan = semantics.walked(nodes, semantics._rules("dim_lookup"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(query_id" not in plan
    rows = nodes.select("query_id", "token", "text", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))
    blocks = rows.mapInArrow(lambda batches: dealing.packed(batches, "query_id"), dealing.PACKED).select(F.sum("n"), F.sum(F.length("packed"))).first()
    assert blocks[0] == rows.count() and blocks[1] < 12 * blocks[0]


def test_plans_are_shuffled_packed(spark):
    """Operators and attributes of plans go through the shuffle as blocks."""
    from wtel.plans import plan_nodes

    ops = spark.createDataFrame([], "query_id long, stage_id string, task_type string, op_id string, parent_op_id string, op_type string, variant string, seq int")
    attrs = spark.createDataFrame([], "query_id long, stage_id string, op_id string, attr string, pos int, value string, kind string, alias string")
    out = plan_nodes.operator_comment(ops, attrs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [bucket" in plan and "RepartitionByExpression [query_id" not in plan
    assert out.count() == 0
