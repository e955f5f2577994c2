"""The chunked helpers against plain Python, with chunks so small that every border is crossed."""

import random

import pytest
from pyspark.sql import functions as F

from wtel.functions import ordered


def series(seed, n=300):
    """Random series; one key holds most rows."""
    r = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        k = "hot" if r.random() < 0.6 else f"k{r.randrange(6)}"
        at[k] = at.get(k, 0) + r.choice([1, 1, 1, 2, 9])
        rows.append((k, at[k], r.randrange(100) if r.random() < 0.4 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_previous_poll(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "k string, poll_no long, v int")
    out = ordered.with_previous_poll(df, ["k"], chunk=4)
    got = sorted((r.k, r.poll_no, r.prev.v if r.prev else "new") for r in out.collect())
    known = {(k, p): v for k, p, v in rows}
    want = sorted((k, p, known.get((k, p - 1), "new")) for k, p, _ in rows)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_fill(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "k string, t long, v int")
    out = ordered.fill(
        df, ["k"], ["t"], ordered.position_chunk("t", 5),
        upto={"a": "v"}, before={"b": "v"}, after={"c": "v"},
    )
    got = {(r.k, r.t): (r.v, r.a, r.b, r.c) for r in out.collect()}
    want = {}
    for k, t, v in rows:
        mine = sorted((t2, v2) for k2, t2, v2 in rows if k2 == k and v2 is not None)
        a = [x for t2, x in mine if t2 <= t]
        b = [x for t2, x in mine if t2 < t]
        c = [x for t2, x in mine if t2 > t]
        want[k, t] = (v, a[-1] if a else None, b[-1] if b else None, c[0] if c else None)
    assert got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_as_of(spark, seed):
    left = [(k, t) for k, t, _ in series(seed)]
    right = [(k, t, i) for i, (k, t, v) in enumerate(series(seed + 10)) if v is not None]
    out = ordered.as_of(
        spark.createDataFrame(left, "k string, t long"),
        spark.createDataFrame(right, "k string, t long, i int"),
        ["k"], ["t"], ordered.position_chunk("t", 7), ["i"],
    )
    want = []
    for k, t in left:
        before = sorted((t2, i) for k2, t2, i in right if k2 == k and t2 <= t)
        want.append((k, t, before[-1][1] if before else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_number_rows_and_running_sum(spark):
    rows = [(k, t, (v or 0)) for k, t, v in series(7)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    chunk = ordered.position_chunk("t", 3)
    numbered = {(r.k, r.t): r.n for r in ordered.number_rows(df, ["k"], ["t"], chunk, "n").collect()}
    summed = {(r.k, r.t): r.s for r in ordered.running_sum(df, ["k"], ["t"], chunk, "v", "s").collect()}
    for k, t, _ in rows:
        upto = [v for k2, t2, v in rows if k2 == k and t2 <= t]
        assert numbered[k, t] == len(upto)
        assert summed[k, t] == sum(upto)
    overall = ordered.number_all(df, ["t", "k"], "n").orderBy("n").collect()
    assert [(r.t, r.k) for r in overall] == sorted((t, k) for k, t, _ in rows)
    assert [r.n for r in overall] == list(range(1, len(rows) + 1))


def test_rows_are_only_windowed_within_chunks(spark):
    """The shuffle of the rows themselves is by key and chunk; only chunk totals go by key alone."""
    df = spark.createDataFrame([("a", 1)], "k string, t long")
    out = ordered.number_rows(df, ["k"], ["t"], ordered.position_chunk("t", 3), "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    ranked = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert len(ranked) == 1
    assert "[k#" in ranked[0] and "_chunk#" in ranked[0].split("row_number()")[1]


def test_as_of_joins_on_key_and_chunk(spark):
    """No join of ``as_of`` goes by key alone, not even when the key is one constant."""
    left = spark.createDataFrame([("a", 1)], "k string, t long").withColumn("k", F.lit("a"))
    right = spark.createDataFrame([("a", 1, 2)], "k string, t long, i int").withColumn("k", F.lit("a"))
    out = ordered.as_of(left, right, ["k"], ["t"], ordered.position_chunk("t", 3), ["i"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins
    assert all("_chunk#" in line and ">" not in line.split("Join", 1)[1] for line in joins)


def test_numbering_is_balanced_by_rows(spark):
    """All rows in one instant still go to several tasks."""
    df = spark.range(4000).select(F.lit(5).alias("t"), "id")
    ranged = ordered.number_all(df, ["t", "id"], "n")
    assert [r.id for r in ranged.orderBy("n").limit(5).collect()] == [0, 1, 2, 3, 4]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, "t", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in cut.collect()) < 4000 / parts * 2
