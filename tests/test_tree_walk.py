"""Random syntax trees: the walk, the joins for long queries and a plain recursive walker agree."""

import random

import pytest
from pyspark.sql import functions as F

from wtel.plans import semantics

TOKENS = [
    "TOK_SELEXPR", "TOK_WHERE", "TOK_GROUPBY", "TOK_JOIN", "TOK_LEFTOUTERJOIN", "TOK_FROM", "TOK_TABREF", "TOK_SUBQUERY",
    "TOK_FUNCTION", "TOK_FUNCTIONDI", "TOK_TABLE_OR_COL", "TOK_TABLE_OR_COL", "TOK_TABLEBUCKETSAMPLE", "TOK_TABNAME",
    "TOK_ISNULL", "TOK_QUERY", "Identifier", "Identifier", "Identifier", "Number", "DOT", "DOT", "LSQUARE", "OPERATOR", "OPERATOR", None,
]
WORDS = ["a", "b", "t", "u", "dim_lookup", "3", "-7", "x1", "", "null", None]
SCHEMA = "query_id long, path array<int>, node_order int, token string, text string"


def grown(seed: int, queries: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = []

    def add(q, path, counter):
        token = rng.choice(TOKENS) if len(path) > 1 else "TOK_QUERY"
        text = {"DOT": ".", "LSQUARE": "[", "OPERATOR": rng.choice(semantics.COMPARISONS)}.get(token)
        if text is None:
            text = rng.choice(WORDS) if token in ("Identifier", "Number", None) else token
        rows.append((q, path, counter[0], token, text))
        counter[0] += rng.choice((1, 1, 3))
        for i in range(rng.choice((0, 1, 2, 2, 3, 5)) if len(path) < 9 else 0):
            add(q, [*path, i], counter)

    for q in range(queries):
        add(q, [0], [0])
    return rows


def plain(rows: list[tuple]) -> set[tuple]:
    """(query, order, kind, clause, table, function, lookup, index, condition) of each reported node."""
    at = {(q, tuple(p)): (o, t, x) for q, p, o, t, x in rows}
    out = set()
    for q in {r[0] for r in rows}:
        walk = sorted((o, tuple(p), t, x) for q2, p, o, t, x in rows if q2 == q)
        token = lambda p, *k: at.get((q, (*p, *k)), (0, None, None))[1]
        text = lambda p, *k: at.get((q, (*p, *k)), (0, None, None))[2]
        names: dict[str, str] = {}
        waiting = None  # name of a subquery that no plain table has followed yet
        for o, p, t, x in walk:
            above = [p[:k] for k in range(1, len(p))]
            kinds = []
            for a in above:
                via, at_, ax = p[len(a)], token(a), text(a)
                kind = (
                    "clause" if at_ in ("TOK_SELEXPR", "TOK_WHERE", "TOK_GROUPBY")
                    else "join" if at_ in semantics.JOINS else "from" if at_ == "TOK_FROM" else "table" if at_ == "TOK_TABREF"
                    else "dot" if ax == "." else "index" if ax == "[" else "function" if at_ == "TOK_FUNCTION"
                    else "sign" if ax in semantics.COMPARISONS else None
                )
                kinds.append((kind, a, via))
            if not (x == "." or t in ("TOK_TABLE_OR_COL", "TOK_TABREF", "TOK_SUBQUERY")):
                continue
            owners = [k for k, (kind, a, via) in enumerate(kinds) if kind == "clause" or (kind == "join" and via == 2)]
            inner = kinds
            if owners:
                kind, a, via = kinds[owners[0]]
                inner = kinds[owners[0] + 1 :]
                if kind == "join":
                    clause = "JOIN_ON"
                elif token(a) != "TOK_GROUPBY" and via != 0:
                    continue
                else:
                    clause = token(a)[4:]
            else:
                a = None
                if not any(k[0] == "from" for k in kinds) or any(k[0] == "table" for k in kinds):
                    continue
                clause = "FROM"
            kind = "table" if t == "TOK_TABREF" else "subquery" if t == "TOK_SUBQUERY" else "part" if any(k[0] == "dot" for k in inner) else "column"
            found = None
            if clause == "FROM" and kind == "table":
                few = [k for k in range(4) if (q, (*p, k)) in at]
                n = max(few, default=-1) + 1
                last = (*p, n - 1)
                # a comparison with a null token is neither true nor false
                alias = text(last) if n > 1 and token(last) not in (None, "TOK_TABLEBUCKETSAMPLE") else None
                name = text(p, 0, 0)
                if alias is None:
                    if name is not None:
                        names[""] = name
                        if waiting is not None and waiting[0] is not None:
                            names[waiting[0]] = name
                    waiting = None
                elif name is not None:
                    names[alias] = name
            if clause == "FROM" and kind == "subquery":
                waiting = (text(p, 1),)
            if kind == "column" and clause != "FROM":
                ref = (text(p, 0, 0) if text(p, 0, 0) is not None else "null") if x == "." else ""
                found = names.get(ref)
            calls = [k[1] for k in inner if k[0] == "function"]
            lookups = [c for c in calls if text(c, 0) == "dim_lookup"]
            brackets = [k for k in inner if k[0] == "index"]
            stops = [k for k in inner if k[0] in ("sign", "function")]
            out.add((
                q, o, kind, clause, found, text(calls[-1], 0) if calls else None, (text(lookups[-1], 1) or "") if lookups else "",
                bool(lookups), bool(brackets) and brackets[-1][2] == 0, stops[0][2] if stops else None,
                text(stops[0][1], 1) if stops else None, token(a, 0) if a else None, text(a, 0, 0) if a else None,
            ))
    return out


COLUMNS = [
    "query_id", "node_order", "kind", "clause", "tabName", "function", "dimTabName", "isDimLookup", "isArray", "cond_via",
    "cond_value", "item_token", "outer_name",
]


def shown(facts):
    found = F.when(F.expr("kind = 'column' and clause <> 'FROM'"), F.col("tabName")).alias("tabName")
    return {tuple(r) for r in facts.withColumn("tabName", found).select(*COLUMNS).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_trees(spark, seed):
    rows = grown(seed)
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert shown(semantics.analyse(nodes)) == want
    assert shown(semantics.analyse(nodes, long_query=-1)) == want  # every query by joins
    assert shown(semantics.analyse(nodes, long_query=60)) == want  # some


def test_repeated_nodes_and_no_nodes(spark):
    rows = grown(5, 8)
    nodes = spark.createDataFrame(rows + rows[::3] + [(None, [0], 0, "TOK_TABREF", "x"), (1, None, 0, "TOK_TABREF", "x")], SCHEMA)
    assert shown(semantics.analyse(nodes)) == plain(rows)
    assert semantics.analyse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_shuffle_of_the_nodes(spark):
    nodes = spark.createDataFrame(grown(6, 5), SCHEMA)
    plan = semantics._narrow(semantics.walked(nodes, semantics._rules("dim_lookup")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_paths_are_cut_once(spark):
    """The view of landed nodes carries ready paths: none is split again for every query."""
    from wtel.fixtures.views import view

    nodes = view(spark, "/root/testdata/sf0.001", "ast_nodes")
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    assert nodes.schema["path"].dataType.simpleString() == "array<int>"
