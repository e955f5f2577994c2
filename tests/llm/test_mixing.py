"""The flow, the targets and the selection; the query equals its SQL."""

import random

import pytest
from pyspark.sql import functions as F

from wtel.fixtures.compare import connect
from wtel.llm import mixing, queries

from .conftest import SMALL


def best_total(patterns, quotas, repeats):
    """Greatest flow by least cut: over all sets of sources on the sink's side."""
    out = []
    for cut in range(1 << len(quotas)):
        outside = sum(q for s, q in enumerate(quotas) if not cut >> s & 1)
        inside = sum(n * repeats for members, n in patterns if any(cut >> s & 1 for s in members))
        out.append(outside + inside)
    return min(out)


@pytest.mark.parametrize("seed", range(6))
def test_flow(seed):
    rng = random.Random(seed)
    quotas = [rng.randrange(200) for _ in range(5)]
    patterns = [(sorted(rng.sample(range(5), rng.randrange(1, 4))), rng.randrange(60)) for _ in range(12)]
    given = mixing.flow(patterns, quotas, 3, 2)
    assert all(0 <= g <= 3 * n for g, (_, n) in zip(given, patterns, strict=True))
    assert sum(given) == best_total(patterns, quotas, 3)
    for copies in (1, 2):  # no token is repeated that need not be
        assert sum(min(g, copies * n) for g, (_, n) in zip(given, patterns, strict=True)) == best_total(patterns, quotas, copies)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 300, 2) == [150.0, 50.0, 100.0]
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315, 2) == [20.0, pytest.approx(98.3333333), pytest.approx(196.6666667)]
    assert mixing.targets([0, 0], [3, 1], 0.0, 2) == [0.0, 0.0]
    assert mixing.targets([], [], 0.0, 2) == []
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1000) for _ in range(8)]
        weights = [(3, 1, 2)[i % 3] for i in range(8)]
        found = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2)
        assert sum(found) == pytest.approx(1.5 * sum(sizes))
        free = [t / w for t, w, n in zip(found, weights, sizes, strict=True) if t < 2 * n - 1e-9]
        assert max(free, default=0) == pytest.approx(min(free, default=0))
        assert all(t <= 2 * n + 1e-9 for t, n in zip(found, sizes, strict=True))


def test_query_equals_sql(spark):
    con = connect(SMALL)
    for key in ("op1_mix_sources", "op4_url_filter"):
        got = queries.QUERIES[key](spark, SMALL)
        found = con.execute(queries.STATEMENTS[key])
        names = [c[0] for c in found.description]
        want = sorted(found.fetchall(), key=str)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == want


def test_taken_is_near_the_target(spark):
    rows = queries.op1_mix_sources(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    sums = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in sums.collect())
    assert rows.where("taken > 2 * size").count() == 0
    again = queries.op1_mix_sources(spark, "/root/testdata/sf0.01")
    assert sorted(rows.collect()) == sorted(again.collect())


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None], 10 + i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n long")
    found, units, sources = mixing.mix(docs, F.col("sources"), F.col("n"))
    assert found.count() == 300 and units.where("copies between 0 and 2").count() == 300
    wanted = {r.source: r.target for r in sources.collect()}
    assert set(wanted) == {"a", "b", None}
    taken = units.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(taken - 1.5 * sum(r[2] for r in rows)) < 40


def test_odd_rows(odd, none):
    mixed = mixing.mixed_documents(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = mixed.collect()
    assert all(r.text and r.text.strip() for r in got)
    assert {r.doc_id for r in got} <= {r.doc_id for r in odd.collect()}
    first, units, sources = mixing.mix(odd, F.array("source"), mixing.n_words(F.col("text")))
    assert first.count() == odd.count()
    assert {r.source for r in sources.collect()} == {"a", "b", "c", None}
    assert mixing.mixed_documents(none).count() == 0


def test_a_source_for_nearly_every_document(spark, tmp_path, monkeypatch):
    """Sources that no other pattern has need no flow: more of them than the driver would plan, equal to the SQL."""
    import duckdb

    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    rng = random.Random(6)
    rows = []
    for i in range(9000):
        source = None if i % 997 == 0 else f"www{rng.randrange(6000)}.example"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 2, 5, 40])) or None, "en", source, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.STATEMENTS["op1_mix_sources"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    got = queries.op1_mix_sources(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want


def test_shared_and_private_sources_together(spark):
    """The flow of overlapping sources beside private ones is that of all together."""
    rng = random.Random(2)
    kinds = [["a"], ["a", "b"], ["b", "c"], ["x"], ["y"], [None], []]
    rows = [(i, rng.choice(kinds), rng.randrange(1, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n long")
    _, units, sources = mixing.mix(docs, F.col("sources"), F.col("n"))
    wanted = {r.source: r.target for r in sources.collect()}
    names = sorted(wanted, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, m, n in rows if s in m) for s in names]
    everything = sum(n for _, m, n in rows if m)
    weights = [(3, 1, 2)[k % 3] for k in range(len(names))]
    assert [wanted[s] for s in names] == mixing.targets(sizes, weights, 1.5 * everything, 2)
    patterns = {}
    for _, m, n in rows:
        key = tuple(sorted(m, key=lambda s: (s is not None, s or "")))
        patterns[key] = patterns.get(key, 0) + n
    given = mixing.flow([([names.index(s) for s in m], n) for m, n in patterns.items()], [int(wanted[s]) for s in names], 2)
    taken = {}
    for r in units.collect():
        key = tuple(r.members)
        taken[key] = taken.get(key, 0) + r.copies * r["size"]
    assert all(taken[k] <= 2 * n for k, n in patterns.items())
    private = [("x",), ("y",), (None,)]
    for (k, n), g in zip(patterns.items(), given, strict=True):
        if k in private:
            assert abs(taken[k] - g) <= 15  # whole documents
        if not k:
            assert taken[k] == 0
    assert abs(sum(taken.values()) - sum(given)) < 40
