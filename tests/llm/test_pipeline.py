"""The stages in a row, each against what it must keep and change."""

import pytest

import corpus_pipeline
from wtel.llm import bpe, mixing, quality, secrets, setsketch
from wtel.llm.common import ranks_path, staged

from .conftest import SMALL


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SMALL), name))
    return out


def keyed(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, steps):
    docs, good, single, masked, mixed, ids = steps
    names = corpus_pipeline.COLUMNS
    assert all(s.columns == names for s in (good, single, masked, mixed))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    groups = setsketch.near_duplicates(good, words=5).where("kept").collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in groups)
    before, after = keyed(single), keyed(masked)
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i].text == secrets.masked(r.text, secrets.all_spans(r.text)[1])
        assert after[i].n_chars == len(after[i].text)
    copies = {r.doc_id: r.copies for r in mixing.mix(masked, corpus_pipeline.F.array("source"), mixing.n_words(corpus_pipeline.F.col("text")))[1].collect()}
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}
    own = bpe.tokenizer(ranks_path())
    texts = {i: r.text for i, r in after.items()}
    rows = ids.collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert own.decode(bpe.pa.array([r.ids], bpe.IDS))[1][0].as_py().decode() == texts[r.doc_id]


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((r.doc_id, tuple(r.ids)) for r in steps[-1].collect())


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, SMALL)
            assert found.columns == corpus_pipeline.COLUMNS, name
            n = found.count()
            assert n <= 2 * docs.count(), name
            assert n or name == "quality_rules" or docs is none
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == docs.count()
