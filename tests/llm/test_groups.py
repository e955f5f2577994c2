"""Components, near-duplicate documents and embeddings against plain comparisons of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wtel.llm import components, embed, setsketch
from wtel.llm.common import staged


def union(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(7, i) for i in range(200)] + [(7, 3)] * 5,
        "none": [],
    }[kind]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = union({n for e in edges for n in e}, edges)
    assert {r.node for r in got} == set(want)
    roots = {}
    for r in got:
        assert roots.setdefault(want[r.node], r.root) == r.root
    assert len(set(roots.values())) == len(roots)


def sets_of(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(zip(*(found[i:] for i in range(words)), strict=False))


def expected(rows, words):
    """Rows are (id, text), ids without nulls; every pair is compared."""
    sets = {}
    for i, text in rows:
        sets[i] = sets_of(text, words)
    ids = sorted(sets)
    edges = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    return {i: len(s) for i, s in sets.items()}, union(ids, edges)


def near_texts():
    """Originals, copies with a few words changed around the limit, exact copies, short ones, a chain."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(2, 120))]
        texts += [" ".join(base)] * rng.randrange(1, 4)
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(max(1, len(base) // 10) + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain[k * 9 : k * 9 + 8] = [word() for _ in range(8)]
        texts.append(" ".join(chain))
    return texts + ["", "   ", "one", "One", "one two", "two one", "x x x x", "x x x x x x x"]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = list(enumerate(near_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes, groups = expected(rows, words)
    got = setsketch.near_duplicates(docs, words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], groups[i]) for i in sizes}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {r.doc_id for r in setsketch.one_of_each(docs, words=words).collect()}
    assert kept == {i for i in sizes if groups[i] == i}


def test_a_group_of_near_copies_makes_few_pairs(spark):
    """A bucket's members meet its first, not each other."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_texts_of_one_template_are_not_read_again(spark, monkeypatch):
    """Texts that share a template, far below the limit, meet in buckets; their registers rule them out."""
    rng = random.Random(7)
    template = [f"t{rng.randrange(10**6)}" for _ in range(181)]
    rows = [(i, " ".join(template + [f"x{rng.randrange(10**9)}" for _ in range(120)])) for i in range(700)]  # similarity 0.43
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = []
    own = setsketch.marked_members

    def counted(members):
        out = staged(own(members), "counted")
        marked.append((members.select("c").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(setsketch, "marked_members", counted)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert marked[0][0] > 600  # nearly all share buckets
    assert marked[0][1] <= 20  # but the sets of next to none are read


def test_links_that_no_first_member_shows(spark):
    """Members of a bucket that are like each other but not like its first one are linked too."""
    rng = random.Random(11)
    rows = []
    for g in range(30):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for k in rng.sample(range(120), rng.randrange(4, 9)):
                copy[k] = f"y{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, groups = expected(rows, 2)
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()} == groups


def test_registers():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = base[:3600], base[400:]
    merged = np.maximum(setsketch.registers(a), setsketch.registers(b))
    assert (merged == setsketch.registers(base)).all()
    for shared in (0.2, 0.5, 0.8, 0.95):
        n = 2000
        k = int(2 * n * shared / (1 + shared))
        found = []
        for s in range(12):
            x = np.random.default_rng(s).integers(0, 1 << 63, 2 * n - k, dtype=np.uint64)
            rows = [setsketch.registers(v)[None, :] for v in (x[:n], x[n - k :])]
            found.append(setsketch.estimate(*rows, np.array([n]), np.array([n]))[0])
        assert abs(np.mean(found) - shared) < 0.03
        assert min(found) > shared - 0.15


def test_odd_documents(odd, none):
    got = setsketch.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles > 0, r.component_id, r.kept))
    assert by[1] == [(True, 1, True)]
    assert by[6] == [(True, 1, False)] * 2
    assert by[8] == [(True, 1, False)]
    assert by[2] == [(False, 2, True)]
    assert sorted(by[None], key=str) == [(False, None, False), (True, 1, False)]
    kept = [r.doc_id for r in setsketch.one_of_each(odd.select("doc_id", "text")).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 7, 9, 10, None], key=str)
    assert setsketch.near_duplicates(none).count() == setsketch.one_of_each(none).count() == 0


def test_groups_of_rows_without_ids(spark):
    """One row of a group stays even if none has an id."""
    rows = [(None, "a b c d"), (None, "A b c d"), (None, None), (5, "z y x"), (5, "z y x"), (5, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(setsketch.one_of_each(docs).collect(), key=str)
    texts = sorted((r.text or "").lower() for r in kept)
    assert texts == ["", "a b c d", "other words here", "z y x"]


def plain_links(rows, threshold=0.93):
    """Rows (id, vector or None, label); links by cosine of every pair."""
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and None not in v:
            x = np.array(v, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                good[i] = (x, label)
    edges = []
    for a in good:
        for b in good:
            (x, k), (y, m) = good[a], good[b]
            if a < b and k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                edges.append((a, b))
    n = {i: 0 for i, *_ in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    return n, union(list(n), edges)


@pytest.mark.parametrize("block", [7, 1500])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(20):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 14))):
            v = center + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(k % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None, 2.0], 1), (1003, [float("nan")] * 16, 1)]
    rows += [(1004, [1.0, 2.0], None), (1005, [1.0, 2.0], 1), (1006, [-0.0, 2.0], 1), (1007, [0.0, 2.0], 1), (1008, [], 2)]
    rows += [(1009, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embed.links(df.withColumn("digest", df.vec_id)).collect()
    n, groups = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], groups[i], groups[i] == i) for i in n}


def test_signs_grow_with_the_label():
    """Twice as many vectors take little more than twice as many comparisons; the chance to miss a pair stays."""
    work = []
    for n in (1 << 12, 1 << 16, 1 << 20):
        bits = embed.bits_for(n)
        tables = embed.tables_for(bits)
        assert (1 - embed.AGREE**bits) ** tables <= embed.MISSED
        work.append(tables * n * n / 2**bits / n)  # comparisons of one vector
    assert work[1] < 2 * work[0] and work[2] < 2 * work[1]


def test_recall_of_buckets():
    """Pairs at the limit share a bucket and have similar signatures."""
    rng = np.random.default_rng(1)
    for n in (200, 40_000):
        x = rng.standard_normal((4000, 32))
        other = rng.standard_normal((4000, 32))
        other -= (other * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        y = 0.931 * unit(x) + np.sqrt(1 - 0.931**2) * unit(other)
        a, b = (embed.codes(v, embed.bits_for(n)) for v in (x, y))
        assert (a == b).any(axis=1).mean() >= 0.999
        signs = np.bitwise_count(embed.signatures(x) ^ embed.signatures(y)).sum(axis=1)
        assert (signs <= embed.DIFFER).all()


def test_unlike_vectors_are_not_compared(spark, monkeypatch):
    """Of vectors without partners none is sent to a comparison."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(48)], 1) for i in range(2000)]
    rows += [(5000 + i, [v * 2 for v in rows[i][1]], 1) for i in range(10)]
    found = []
    own = embed.similar_members

    def counted(members):
        out = staged(own(members), "counted")
        found.append(out.select("c").distinct().count())
        return out

    monkeypatch.setattr(embed, "similar_members", counted)
    got = embed.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sum(r.n_links for r in got) == 20
    assert found[0] <= 40


def test_odd_embeddings(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (None, None, None), (None, [0.0, 1.0], 3)]
    schema = "vec_id long, embedding array<float>, label int"
    got = sorted((tuple(r) for r in embed.links(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert embed.links(spark.createDataFrame([], schema)).count() == 0


def test_shingles_of_short_texts():
    sets = setsketch.shingle_sets(pa.array(["a b c", "a", None, "A  B", " "]))
    assert [len(s) for s in sets] == [2, 1, 0, 1, 0]
