"""Literal shapes that the derived views repeat for every order: syntax trees and plan nodes.

``#`` in a text is replaced by a number taken from the order.
"""

from __future__ import annotations


def _sql(value: object) -> str:
    if value is None:
        return "cast(null as string)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "' || chr(39) || '") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_sql(c) for c in r) + ")" for r in rows)


# --- syntax trees: (token, text, children) -----------------------------------------------------
def n(token: str, *children: tuple, text: str | None = None) -> tuple:
    return (token, token if text is None else text, children)


def ident(name: str) -> tuple:
    return n("Identifier", text=name)


def num(value: int) -> tuple:
    return n("Number", text=str(value))


def lit(value: str) -> tuple:
    return n("StringLiteral", text=f"'{value}'")


def col(name: str) -> tuple:
    return n("TOK_TABLE_OR_COL", ident(name))


def dot(alias: str, name: str) -> tuple:
    return n("DOT", col(alias), ident(name), text=".")


def at(array: tuple, index: tuple) -> tuple:
    return n("LSQUARE", array, index, text="[")


def op(sign: str, *sides: tuple) -> tuple:
    return n("OPERATOR", *sides, text=sign)


def fn(name: str, *args: tuple) -> tuple:
    return n("TOK_FUNCTION", ident(name), *args)


def sel(*items: tuple) -> tuple:
    return n("TOK_SELECT", *[n("TOK_SELEXPR", i) for i in items])


def table(name: str, alias: str | None = None, sample: tuple | None = None) -> tuple:
    parts = [n("TOK_TABNAME", ident(name))]
    if sample is not None:
        parts.append(sample)
    if alias is not None:
        parts.append(ident(alias))
    return n("TOK_TABREF", *parts)


def sample(*buckets: int, on: tuple | None = None) -> tuple:
    parts = [num(b) for b in buckets]
    if on is not None:
        parts.append(on)
    return n("TOK_TABLEBUCKETSAMPLE", *parts)


def where(cond: tuple) -> tuple:
    return n("TOK_WHERE", cond)


def group(*items: tuple) -> tuple:
    return n("TOK_GROUPBY", *items)


def query(source: tuple, *clauses: tuple) -> tuple:
    return n("TOK_QUERY", n("TOK_FROM", source), n("TOK_INSERT", n("TOK_DESTINATION"), *clauses))


def subquery(inner: tuple, alias: str) -> tuple:
    return n("TOK_SUBQUERY", inner, ident(alias))


def isnull(c: tuple) -> tuple:
    return n("TOK_FUNCTION", n("TOK_ISNULL"), c)


def isnotnull(c: tuple) -> tuple:
    return n("TOK_FUNCTION", n("TOK_ISNOTNULL"), c)


AST = [
    # aliased join, distinct count, a function inside arithmetic
    query(
        n("TOK_JOIN", table("t#", "a"), table("u", "b"),
          op("AND", op("=", dot("a", "k"), dot("b", "k")), op("=", dot("a", "m"), dot("b", "n")))),
        sel(dot("a", "x#"), n("TOK_FUNCTIONDI", ident("count"), dot("b", "y")),
            op("+", fn("f", dot("a", "z"), dot("b", "w")), num(1)),
            n("TOK_FUNCTIONSTAR", ident("count"))),
        where(op("AND", op("=", dot("a", "x#"), num(5)), isnotnull(dot("b", "y")))),
    ),
    # bare columns, a literal on the left, grouping
    query(
        table("t#"),
        sel(col("c"), fn("sum", col("d")), num(1)),
        where(op("AND", op(">", col("c"), num(10)), op("<", num(5), col("d")))),
        group(col("c"), col("d")),
    ),
    # two un-aliased tables and an unknown alias, left outer join, function in a group item
    query(
        n("TOK_LEFTOUTERJOIN", table("t#"), table("v"), op("=", col("k"), dot("q", "k"))),
        sel(op("*", col("a"), col("b")), fn("concat", col("c"), fn("lower", col("d")))),
        where(op("OR", op("<=", op("+", col("a"), col("b")), col("c")),
                 op("<>", fn("upper", col("d")), lit("X#")))),
        group(fn("year", col("e")), op("%", col("f"), col("g"))),
    ),
    # array items: constant, computed and nested index
    query(
        table("t#", "a"),
        sel(at(dot("a", "info"), num(1)), at(col("info"), dot("a", "pos")),
            at(at(col("mat"), num(2)), num(7))),
        where(op("AND", op("=", at(dot("a", "arr"), num(2)), lit("v")),
                 op("!=", at(col("m"), lit("key")), lit("w")))),
        group(at(dot("a", "g"), num(4))),
    ),
    # lookups, nested in a cast, in a filter and in a group item
    query(
        n("TOK_LEFTSEMIJOIN", table("t#", "a"), table("u", "b"),
          op("=", fn("dim_lookup", lit("dj"), dot("a", "k"), lit("x")), dot("b", "k"))),
        sel(fn("TOK_INT", fn("dim_lookup", lit("tier#"), at(dot("a", "info"), num(1)), lit("tier"))),
            fn("dim_lookup", lit("d"), fn("lower", dot("a", "c")), lit("x"))),
        where(op("=", fn("dim_lookup", lit("d2"), dot("a", "q"), lit("y")), lit("v"))),
        group(fn("dim_lookup", lit("d3"), dot("a", "g"), lit("z"))),
    ),
    # sampled tables, a subquery alias, conditions that give no row
    query(
        n("TOK_FULLOUTERJOIN",
          subquery(query(table("t#", sample=sample(1, 64, on=fn("rand", col("z")))),
                         sel(col("x"), col("y")), where(op(">=", col("x"), num(3)))), "s"),
          table("other", sample=sample(3, 8)),
          op("=", dot("s", "x"), col("y"))),
        sel(dot("s", "x"), col("y")),
        where(op("AND", fn("in", dot("s", "x"), num(1), num(2)),
                 op("AND", op("NOT", op("<=", dot("s", "x"), num(3))),
                    op("AND", isnull(dot("s", "y")),
                       fn("if", op("=", col("p"), num(1)), col("p"), num(0)))))),
        n("TOK_HAVING", op(">", col("h"), num(1))),
        n("TOK_ORDERBY", col("o")),
    ),
    # a sampled and aliased table, an alias used twice, a subquery in a condition, field of a field
    query(
        n("TOK_RIGHTOUTERJOIN",
          subquery(query(table("t#", "a"), sel(dot("a", "p")), group(dot("a", "p"))), "s1"),
          subquery(query(n("TOK_JOIN", table("w", "a", sample(2, 16)), table("r"),
                           op("=", dot("a", "i"), col("j"))), sel(dot("a", "p"))), "s2"),
          op("=", dot("s1", "p"), dot("s2", "p"))),
        n("TOK_SELECTDI", n("TOK_SELEXPR", dot("a", "z"), ident("zz")),
          n("TOK_SELEXPR", n("DOT", dot("a", "st"), ident("fld"), text="."))),
        where(n("TOK_SUBQUERY_EXPR", n("TOK_SUBQUERY_OP", n("KW_IN", text="in")),
                query(table("hidden", "h"), sel(dot("h", "c")), where(op("=", dot("h", "d"), num(9)))),
                dot("s2", "c"))),
    ),
]
AST_SHAPES = len(AST)


def ast_rows() -> list[tuple]:
    """(shape, path, node_order, token, text) of every node, in walk order."""
    rows: list[tuple] = []
    for shape, tree in enumerate(AST):
        order = 0
        pending = [("0", tree)]
        while pending:
            path, (token, text, children) = pending.pop()
            rows.append((shape, path, order, token, text))
            order += 1
            pending.extend(reversed([(f"{path}.{i}", c) for i, c in enumerate(children)]))
    return rows


def ast_values() -> str:
    return _values(ast_rows())


# --- plan nodes ----------------------------------------------------------------------------------
# (stage, task, op, parent, type, variant, [(attr, value, kind, alias), ...]); repeated attributes
# count up their position, an attribute "name@3" has position 3.
PLANS: list[list[tuple]] = [
    [  # join of two scans, then a grouping stage
        ("Stage-1", "MAP", "TS_0", None, "TABLESCAN", "", [
            ("alias", "a"), ("partitionCol", "ds"), ("partitionCol", "hr"),
            ("filterExpr", "(k > #)"), ("rowLimit", "0")]),
        ("Stage-1", "MAP", "FIL_1", "TS_0", "FILTER", "", [
            ("predicate", "(k > #)"), ("operand", "k", "column", "a"), ("operand", "#", "constant", None)]),
        ("Stage-1", "MAP", "RS_2", "FIL_1", "REDUCESINK", "", [
            ("partitionCol", "k", "column", "a"), ("key", "k", "column", "a"), ("value", "v", "column", "a"),
            ("value", "w", "column", "a"), ("outputKey", "joinkey0"), ("outputCol", "_col1"),
            ("numReducers", "8")]),
        ("Stage-1", "MAP", "TS_3", None, "TABLESCAN", "", [("alias", "s:b"), ("rowLimit", "100")]),
        ("Stage-1", "MAP", "FIL_4", "TS_3", "FILTER", "", [
            ("predicate", "('x' = c)"), ("operand", "x", "constant", None), ("operand", "c", "column", "b")]),
        ("Stage-1", "MAP", "RS_5", "FIL_4", "REDUCESINK", "", [
            ("partitionCol", "k2", "column", "b"), ("partitionCol", "f(k)", "func", None),
            ("key", "k2", "column", "b"), ("numReducers", "-1")]),
        ("Stage-1", "REDUCE", "JOIN_6", None, "JOIN", "", [
            ("cond", "Inner Join 0 to 1"), ("cond", "Left Outer Join1 to 2"),
            ("filterString@1", "(c = #)"), ("filterString@7", "(d = #)"), ("skew", "false"),
            ("outputCol", "_col0"), ("outputCol", "_col1"), ("filterMap@0", "[1, 1]"),
            ("nullSafe", "[true]")]),
        ("Stage-1", "REDUCE", "SEL_7", "JOIN_6", "SELECT", "", [
            ("expr", "_col0", "column", None), ("expr", "5", "constant", None),
            ("expr", "f(_col1)", "func", None), ("expr", "odd", "other", None), ("outputCol", "_col0"),
            ("outputCol", "_col1")]),
        ("Stage-1", "REDUCE", "FS_8", "SEL_7", "FILESINK", "", [
            ("dirName", "/tmp/#"), ("finalDirName", "/out/#"), ("numFiles", "1"), ("partitionCol", "ds")]),
        ("Stage-2", "MAP", "TS_9", None, "TABLESCAN", "", [("alias", "mid")]),
        ("Stage-2", "MAP", "GBY_10", "TS_9", "GROUPBY", "", [
            ("key", "_col0"), ("outputCol", "_col0"), ("outputCol", "_col1"), ("aggregation", "count(1)"),
            ("aggregation", "sum(_col1)")]),
        ("Stage-2", "MAP", "RS_11", "GBY_10", "REDUCESINK", "", [
            ("partitionCol", "_col0", "column", "mid"), ("key", "_col0", "column", "mid")]),
        ("Stage-2", "REDUCE", "GBY_12", None, "GROUPBY", "", [("key", "k"), ("distinct", "true")]),
        ("Stage-2", "REDUCE", "LIM_13", "GBY_12", "LIMIT", "", [("limit", "1#")]),
    ],
    [  # map joins of three kinds
        ("Stage-3", "MAP", "TS_0", None, "TABLESCAN", "", [("alias", "big")]),
        ("Stage-3", "MAP", "MJ_1", "TS_0", "MAPJOIN", "bucket", [
            ("cond", "Inner Join 0 to 1"), ("skew", "true"), ("outputCol", "_col4"),
            ("joinExpr", "id", "column", "big"), ("joinExpr", "1", "constant", None),
            ("mapKey@0", "id"), ("mapKey@1", "id2"), ("bigTablePos", "0")]),
        ("Stage-3", "MAP", "MJ_2", "MJ_1", "MAPJOIN", "sorted bucket", [
            ("cond", "Inner Join 0 to 1"), ("skew", "false"), ("joinExpr", "sk", "column", "t:small"),
            ("bigTablePos", "1")]),
        ("Stage-3", "MAP", "FIL_3", "MJ_2", "FILTER", "", [
            ("predicate", "(a = b)"), ("operand", "a", "column", "big"), ("operand", "b", "column", "big")]),
        ("Stage-3", "MAP", "FS_4", "FIL_3", "FILESINK", "", [
            ("dirName", "/same"), ("finalDirName", "/same"), ("numFiles", "2")]),
        ("Stage-4", "MAP", "HTS_0", None, "HASHTABLESINK", "", [("cond", "c0"), ("cond", "c1")]),
        ("Stage-4", "MAP", "HTD_1", "HTS_0", "HASHTABLEDUMMY", "", []),
        ("Stage-4", "MAP", "MJ_5", "HTD_1", "MAPJOIN", "sorted sink", [
            ("skew", "false"), ("mapKey@0", "h"), ("bigTablePos", "0")]),
        ("Stage-4", "MAP", "MJ_6", "MJ_5", "MAPJOIN", "", [
            ("skew", "false"), ("bigTablePos", "2")]),
    ],
    [  # the remaining kinds of node
        ("Stage-5", "MAP", "TS_0", None, "TABLESCAN", "", [("alias", "x"), ("rowLimit", "#")]),
        ("Stage-5", "MAP", "FOR_1", "TS_0", "FORWARD", "", []),
        ("Stage-5", "MAP", "LVF_2", "FOR_1", "LATERALVIEWFORWARD", "", []),
        ("Stage-5", "MAP", "UDTF_3", "LVF_2", "UDTF", "", [("name", "explode")]),
        ("Stage-5", "MAP", "LVJ_4", "UDTF_3", "LATERALVIEWJOIN", "", [
            ("outputCol", "_col0"), ("outputCol", "_col#")]),
        ("Stage-5", "MAP", "UN_5", "LVJ_4", "UNION", "", [("inputs", "2")]),
        ("Stage-5", "MAP", "SCR_6", "UN_5", "SCRIPT", "", [("command", "python clean.py #")]),
        ("Stage-5", "MAP", "GBY_7", "SCR_6", "GROUPBY", "", []),
        ("Stage-5", "REDUCE", "EX_8", None, "EXTRACT", "", [("expr", "VALUE._col"), ("expr", "second")]),
        ("Stage-5", "REDUCE", "FIL_9", "EX_8", "FILTER", "", [
            ("predicate", "f(p)"), ("operand", "p", "column", "x")]),
    ],
]
PLAN_SHAPES = len(PLANS)
# (shape, stage, alias path, full table, position)
ALIASES = [
    (0, "Stage-1", "a", "default.t#", 0),
    (0, "Stage-1", "s:b", "default.u", 1),
    (0, "Stage-2", "mid", "default.mid", 0),
    (1, "Stage-3", "big:", "default.big#", 0),
    (1, "Stage-3", "q:w:small", "default.other", 1),
    (2, "Stage-5", "y", "default.y", 0),
]


def op_values() -> str:
    rows = []
    for shape, plan in enumerate(PLANS):
        for seq, (stage, task, op_id, parent, kind, variant, _) in enumerate(plan):
            rows.append((shape, stage, task, op_id, parent, kind, variant, seq))
    return _values(rows)


def attr_values() -> str:
    rows = []
    for shape, plan in enumerate(PLANS):
        for stage, _, op_id, _, _, _, attrs in plan:
            seen: dict[str, int] = {}
            for attr, value, *more in attrs:
                attr, _, fixed = attr.partition("@")
                pos = int(fixed) if fixed else seen.get(attr, 0)
                seen[attr] = pos + 1
                kind, alias = more if more else (None, None)
                rows.append((shape, stage, op_id, attr, pos, value, kind, alias))
    return _values(rows)


def alias_values() -> str:
    return _values(ALIASES)
