"""Source divergence, decontamination and ranked search against plain Python and SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wtel.fixtures import registry
from wtel.fixtures.compare import compare, connect
from wtel.llm import divergence, lexical, queries, winnowing

from .conftest import SMALL

LOWER = {c: c + 32 for c in range(65, 91)}
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_decontamination", "op13_lexical_search"])
def test_queries_equal_sql(spark, monkeypatch, name):
    monkeypatch.setitem(registry.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(registry.STATEMENTS, name, queries.STATEMENTS[name])
    assert compare(spark, connect(SMALL), SMALL, name)["ok"]


# --- divergence -----------------------------------------------------------------------------------
def plain_audit(rows, min_docs, listed):
    rows = [(r.lang or "", r.source or "", cut(LETTERS, r.text)) for r in rows]
    count, docs = Counter(), Counter()
    groups = defaultdict(Counter)
    for lang, source, words in rows:
        groups[lang, source].update(words)
        count.update((lang, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang, source in groups:
        kept = sorted(w for g, w in docs if g == lang and docs[g, w] >= min_docs)

        def share(own):
            n = sum(own[w] for w in kept)
            return {w: 1 + 10**9 * (own[w] + 5) // (n + 5 * len(kept)) for w in kept}

        own, whole = share(groups[lang, source]), share(Counter({w: count[lang, w] for w in kept}))
        pairs = []
        for g, s in groups:
            if g == lang and s != source:
                other = share(groups[g, s])
                pairs.append((-sum(abs(own[w] - other[w]) for w in kept), s.encode(), s))
        terms = [(whole[w] - own[w], w.encode(), w) for w in kept if groups[lang, source][w] and own[w] > whole[w]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, listed)):
            out |= {(lang, source, part, w, -v, k) for k, (v, _, w) in enumerate(sorted(found)[:most], 1)}
    return out


@pytest.mark.parametrize(("block", "strip"), [(4096, 64), (7, 2), (1, 1)])
def test_divergence_in_blocks(spark, documents, block, strip):
    docs = documents.where("doc_id % 3 <> 0")
    got = [tuple(r) for r in divergence.audit(docs, 5, 8, block, strip).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(docs.collect(), 5, 8)


def test_divergence_odd_rows(odd, none):
    for least in (1, 2, 50):
        got = [tuple(r) for r in divergence.audit(odd, least).collect()]
        assert len(got) == len(set(got))
        assert set(got) == plain_audit(odd.collect(), least, 50)
    assert divergence.audit(none).count() == 0


def test_run_columns():
    ends = np.array([3, 5, 9]), np.array([4, 9])
    values = np.array([1, 0, 7]), np.array([2, 7])
    columns = [np.repeat(v, np.diff(e, prepend=0)) for e, v in zip(ends, values, strict=True)]
    assert divergence.difference(ends, values) == int(np.abs(columns[0] - columns[1]).sum())


def test_shares_are_exact():
    counts = np.array([0, 1, 10**12, 9 * 10**14], np.int64)
    for total, terms in ((9 * 10**14, 3), (10**15, 10**9)):
        want = [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]
        assert divergence.shares(counts, total, terms).tolist() == want


# --- decontamination ------------------------------------------------------------------------------
def plain_hits(rows, items):
    windows = []
    for i in items:
        words = cut(WORDS, i.text)
        n = min(10, len(words))
        windows += [(str(i.item_id if i.item_id is not None else ""), tuple(words[s : s + n])) for s in range(len(words) - n + 1) if n]
    out = []
    for r in rows:
        words = cut(WORDS, r.text)
        hit, names = set(), set()
        for name, w in windows:
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    names.add(name)
        spans, k = [], 0
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k, k + 1))
        out.append((r.doc_id, len(words), len(hit), spans, sorted(names)))
    return sorted(out, key=str)


def hits_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in frame.collect()), key=str)


def test_random_windows(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["ab", "Cd", "é1", "x", "Y-z"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 14))) for i in range(30)] + [(3, "again the same id ab Cd"), (None, "x x"), (40, None), (41, " ;; ")]
    docs = []
    for d in range(60):
        own = text(rng.randrange(0, 40))
        if d % 3:
            own = f"{own} {rng.choice(items)[1] or ''} {text(5)}"
        docs.append((d % 50, own))
    items_ = spark.createDataFrame(items, "item_id long, text string")
    docs_ = spark.createDataFrame([*docs, (None, docs[1][1]), (7, None), (8, "")], "doc_id long, text string")
    want = plain_hits(docs_.collect(), items_.collect())
    assert hits_of(winnowing.decontaminate(docs_, items_)) == want
    monkeypatch.setattr(winnowing, "fits", lambda *_: False)  # as if the items were too many to send around
    assert hits_of(winnowing.decontaminate(docs_, items_)) == want


def test_windows_odd_rows(spark, odd, none):
    items = [("a", "lazy dog near the river bank, and then it sleeps in the sun"), ("b", "word"), ("a", "!!! 12"), ("c", None)]
    items = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, n_words int")
    assert hits_of(winnowing.decontaminate(odd, items)) == plain_hits(odd.collect(), items.collect())
    assert winnowing.decontaminate(none, items).count() == 0
    blank = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in winnowing.decontaminate(odd, blank).collect()} == {0}


def test_no_python_in_decontamination(spark):
    plan = queries.op12_decontamination(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    import inspect

    assert not re.search(r"mapIn|udf|pandas|pyarrow|\.rdd", inspect.getsource(winnowing))


# --- search ---------------------------------------------------------------------------------------
def plain_search(rows, items, most=50):
    vectors = [(r.doc_id, Counter(cut(TERMS, r.text))) for r in rows]
    vectors = [(d, v, sum(v.values())) for d, v in vectors if v]
    n, total = len(vectors), sum(x[2] for x in vectors)
    df = Counter(t for _, v, _ in vectors for t in v)
    out = []
    for i in items:
        found = []
        for d, v, size in vectors:
            m = 100 - 50 + 50 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 20 * m))
                for t in set(cut(TERMS, i.text)) if t in v
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i.item_id, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs_", "leaf", "terms"), [(16_384, 64, 8192), (37, 3, 60), (5, 1, 1)])
def test_search_in_trees(spark, documents, monkeypatch, docs_, leaf, terms):
    monkeypatch.setattr(lexical, "TERMS", terms)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12)
    # small trees are searched here, as workers do not see the patch
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rows, wanted = documents.collect(), items.collect()
    got = sorted((tuple(r) for r in lexical.search(documents, items).collect()), key=str)
    assert got == plain_search(rows, wanted)


def test_branch_and_bound_of_random_trees(monkeypatch):
    rng = np.random.default_rng(8)
    for leaf in (1, 2, 8):
        monkeypatch.setattr(lexical, "LEAF", leaf)
        for _ in range(15):
            sizes = rng.integers(1, 9, 90)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            terms = np.concatenate([np.sort(rng.choice(12, n, replace=False)) for n in sizes])
            tfs = rng.integers(1, 5, offsets[-1]).astype(np.int32)
            m, ids = rng.integers(50, 300, 90), rng.permutation(90) // 2
            nulls = rng.random(90) < 0.1
            wanted = np.where(rng.random((12, 7)) < 0.4, rng.integers(0, 5000, (12, 1)), 0).astype(float)
            found = lexical.Search(wanted, 10)
            for a, b in ((0, 40), (40, 90)):
                x, y = offsets[a], offsets[b]
                found.over(lexical.Tree(terms[x:y], tfs[x:y], offsets[a : b + 1] - x, m[a:b], ids[a:b], nulls[a:b]))
            row = np.repeat(np.arange(90), sizes)
            for k in range(7):
                gain = wanted[terms, k].astype(np.int64) * (10**9 * tfs.astype(np.int64) // (1000 * tfs + 20 * m[row]))
                score = np.bincount(row, gain, 90).astype(np.int64)
                best = sorted((-s, bool(n), int(i)) for s, n, i in zip(score, nulls, ids, strict=True) if s > 0)[:10]
                got = list(zip((-found.best.scores[k]).tolist(), found.best.nulls[k].tolist(), found.best.ids[k].tolist(), strict=True))
                assert got == best


def test_bounds_leave_branches_out():
    """Documents that cannot reach an item's best are not scored."""
    scored = []

    class Counting(lexical.Search):
        def _leaf(self, tree, a, b, active):
            scored.append(b - a)
            super()._leaf(tree, a, b, active)

    n = 64 * 64
    kind = np.repeat(np.arange(64), 64)
    terms = np.stack([kind, 64 + kind], axis=1).reshape(-1)
    wanted = np.zeros((128, 1))
    wanted[5], wanted[69] = 100, 900
    found = Counting(wanted, 50)
    tree = lexical.Tree(terms, np.ones(2 * n, np.int32), np.arange(n + 1) * 2, np.full(n, 100), np.arange(n), np.zeros(n, bool))
    found.over(tree)
    assert sum(scored) <= 128
    assert found.best.ids[0].tolist() == list(range(320, 370))


def test_search_odd_rows(spark, odd, none):
    items = [(1, "The lazy dog"), (1, "alpha1 beta2 gamma3"), (None, "éé fox river"), (2, None), (3, ""), (4, "nothing-there 12")]
    items = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical.search(odd, items).collect()), key=str)
    assert got == plain_search(odd.collect(), items.collect())
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0
