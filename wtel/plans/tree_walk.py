"""What each node of a syntax tree inherits from the nodes above it, for whole queries at a time.

The nodes of a query reach one task together, by one shuffle of packed blocks (``dealing``). A batch of queries is walked level by level
with array operations: every node takes over what its parent knows and adds the parent itself, which is a
structural join of nodes with their ancestors in a single pass, without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.plans.dealing import whole_keys

#: Nodes that are walked together; a query with more of them does not come here.
BATCH_NODES = 1 << 17
#: How a null step of a path is written.
NO_STEP = "?"

#: Columns of a reported node, and their types.
WALKED = (
    "query_id {query_id}, node_order {node_order}, token string, text string, clause string, part boolean, tabName string,"
    " c0_text string, c1_token string, c1_text string, last_token string, last_text string, n int,"
    " g00 string, g10 string, g11 string, function string, lookup string, is_lookup boolean, bracket_text string, bracket_via int,"
    " cond_kind string, cond_via int, cond_sign string, cond_token string, cond_value string, item_token string, outer_name string"
)


def whole_queries(batches: Iterator[pa.RecordBatch], rows: int = BATCH_NODES, key: str = "query_id") -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that hold all rows of their queries (or other keys), from a sorted partition."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(key).combine_chunks()
        changes = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
        size = sum(b.num_rows for b in held)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


class _Words:
    """Codes of a string column; -1 for null."""

    def __init__(self, column: pa.ChunkedArray):
        coded = column.combine_chunks().dictionary_encode()
        self.values = coded.dictionary
        self.codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def among(self, wanted) -> np.ndarray:
        hit = np.append(pc.is_in(self.values, pa.array(list(wanted), pa.string())).to_numpy(zero_copy_only=False), False)
        return hit[self.codes]

    def code(self, value: str) -> int:
        """The code of a value; of none, a number that no row has."""
        found = pc.index(self.values, pa.scalar(value, self.values.type)).as_py()
        return found if found >= 0 else -9

    def at(self, rows: np.ndarray) -> np.ndarray:
        """Codes of the given rows; -1 where a row is."""
        return np.where(rows >= 0, self.codes[rows], -1)

    def text(self, codes: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(codes, mask=codes < 0)).cast(pa.string())


def _at(values: np.ndarray, rows: np.ndarray, none: int = -1) -> np.ndarray:
    return np.where(rows >= 0, values[rows], none)


def _latest(keys: tuple[np.ndarray, ...], order: np.ndarray, of: tuple[np.ndarray, ...], before: np.ndarray) -> np.ndarray:
    """For each row of ``of``, which row of ``keys`` is the same and has the greatest order below ``before``; else -1."""
    if not len(order):
        return np.full(len(before), -1)
    whole = np.stack([np.concatenate([a, b]) for a, b in zip(keys, of, strict=True)], axis=1)
    _, group = np.unique(whole, axis=0, return_inverse=True)
    group = group.reshape(-1)
    _, rank = np.unique(np.concatenate([order, before]), return_inverse=True)
    place = group.astype(np.int64) * (rank.max() + 1) + rank
    own, asked = place[: len(order)], place[len(order) :]
    by = np.argsort(own, kind="stable")
    found = np.searchsorted(own[by], asked) - 1
    hit = by[np.maximum(found, 0)]
    return np.where((found >= 0) & (group[: len(order)][hit] == group[len(order) :]), hit, -1)


def _places(table: pa.Table) -> pa.Table:
    """Nodes with a number ``key`` for their query and path, ``above`` for the node above, ``depth`` and ``pos``."""
    path = _Words(table.column("path"))
    number: dict[tuple[str, ...], int] = {}
    told = []
    for text in path.values.to_pylist():
        steps = text.split(".") if text else []
        # a step that is null counts for the depth only
        own, up = (number.setdefault(tuple(s for s in x if s != NO_STEP), len(number)) for x in (steps, steps[:-1]))
        told.append((own, up, len(steps), int(steps[-1]) if steps and steps[-1] != NO_STEP else -1))
    own, up, depth, pos = np.array(told, np.int64).reshape(-1, 4).T[:, path.codes]
    query = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) * len(number)
    columns = {"key": query + own, "above": query + up, "depth": depth, "pos": pos}
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values))
    return table


def walk(table: pa.Table, rules) -> pa.RecordBatch:
    """The reported nodes of whole queries with what they inherit. ``rules`` names the tokens (``semantics.RULES``)."""
    table = _places(table)
    key = table.column("key").to_numpy()
    by = np.argsort(key)
    in_order = key[by]
    if (in_order[1:] == in_order[:-1]).any():
        by = np.lexsort((table.column("node_order").to_numpy(), key))
        last_of_key = np.append(in_order[1:] != in_order[:-1], True)
        table = table.take(pa.array(np.sort(by[last_of_key])))  # a node that repeats is one
        key = table.column("key").to_numpy()
        by = np.argsort(key)
        in_order = key[by]
    order, above, pos, depth = (table.column(c).to_numpy() for c in ("node_order", "above", "pos", "depth"))
    token, text = _Words(table.column("token")), _Words(table.column("text"))
    size = len(order)
    found = np.minimum(np.searchsorted(in_order, above), size - 1)
    parent = np.where((in_order[found] == above) & (depth > 1), by[found], -1)

    child = []
    for i in (0, 1):
        own = np.full(size, -1)
        here = np.flatnonzero((pos == i) & (parent >= 0))
        own[parent[here]] = here
        child.append(own)
    few = np.flatnonzero((parent >= 0) & (pos <= 3))
    n = np.zeros(size, np.int64)
    np.maximum.at(n, parent[few], pos[few] + 1)
    last = np.full(size, -1)
    ends = few[pos[few] + 1 == n[parent[few]]]
    last[parent[ends]] = ends

    clause, join, source, tables = (token.among(rules[k]) for k in ("clause", "join", "from", "table"))
    dot, index, sign = (text.among(rules[k]) for k in ("dot", "index", "comparison"))
    subquery, column_token = token.among(rules["subquery"]), token.among(rules["column"])
    call = token.among(rules["function"])
    # a node has one meaning, the first that fits
    taken = clause | join | source | tables
    is_dot = dot & ~taken
    is_index = index & ~taken
    taken |= is_dot | is_index
    is_call = call & ~taken
    is_sign = sign & ~(taken | is_call)
    is_lookup = is_call & (text.at(child[0]) == text.code(rules["lookup"]))

    owner, owner_via, calls, lookups, bracket, bracket_via, blocker, blocker_via = (np.full(size, -1) for _ in range(8))
    in_from, in_table, part = (np.zeros(size, bool) for _ in range(3))
    levels = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[levels], np.arange(1, (depth.max() if size else 0) + 2))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = levels[a:b]
        own = own[parent[own] >= 0]
        p, via = parent[own], pos[own]
        ends_walk = clause[p] | (join[p] & (via == 2))
        begun = owner[p] >= 0
        first = ~begun & ends_walk
        owner[own] = np.where(begun, owner[p], np.where(first, p, -1))
        owner_via[own] = np.where(begun, owner_via[p], np.where(first, via, -1))
        in_from[own] = in_from[p] | source[p]
        in_table[own] = in_table[p] | tables[p]
        part[own] = ~first & (part[p] | is_dot[p])
        new = lambda old, mark, value: np.where(first, -1, np.where(mark, value, old))
        calls[own] = new(calls[p], is_call[p], p)
        lookups[own] = new(lookups[p], is_lookup[p], p)
        bracket[own], bracket_via[own] = new(bracket[p], is_index[p], p), new(bracket_via[p], is_index[p], via)
        opens = (blocker[p] < 0) & (is_sign[p] | is_call[p])
        blocker[own], blocker_via[own] = new(blocker[p], opens, p), new(blocker_via[p], opens, via)

    names = [*rules["clause"].values(), "JOIN_ON", "FROM"]
    owned = np.full(size, -1)
    for i, t in enumerate(rules["clause"]):
        owned = np.where((owner >= 0) & _at(token.among([t]).astype(int), owner, 0).astype(bool), i, owned)
    open_side = (owner_via != 0) & (owner >= 0) & ~_at(token.among(rules["any_side"]).astype(int), owner, 0).astype(bool)
    in_join = _at(join.astype(int), owner, 0).astype(bool)
    clauses = np.where(owner < 0, np.where(in_from & ~in_table, len(names) - 1, -1), np.where(in_join, len(names) - 2, np.where(open_side, -1, owned)))
    reported = np.flatnonzero((dot | column_token | tables | subquery) & (clauses >= 0))

    # which table a column belongs to
    query = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    c1_token, last_token = token.at(child[1]), token.at(last)
    sample = token.code(rules["sample"])
    from_table = np.flatnonzero(tables & (clauses == len(names) - 1))
    from_sub = np.flatnonzero(subquery & (clauses == len(names) - 1) & ~tables)
    g00 = _at(child[0], child[0])
    named = text.at(g00)
    alias = np.where((n > 1) & (last_token >= 0) & (last_token != sample), text.at(last), -1)
    plain = from_table[alias[from_table] < 0]
    plain_before = _latest((query[plain],), order[plain], (query[plain],), order[plain])
    sub_before = _latest((query[from_sub],), order[from_sub], (query[plain],), order[plain])
    since = np.where(plain_before >= 0, order[plain][plain_before] if len(plain) else -1, np.iinfo(np.int64).min)
    sub_at = np.where(sub_before >= 0, order[from_sub][sub_before] if len(from_sub) else -1, 0)
    sub_name = np.where(sub_before >= 0, text.at(child[1])[from_sub][sub_before] if len(from_sub) else -1, -1)
    opened = plain[(sub_before >= 0) & (since < sub_at) & (sub_name >= 0)]
    opened_name = sub_name[(sub_before >= 0) & (since < sub_at) & (sub_name >= 0)]
    aliased = from_table[alias[from_table] >= 0]
    bare = -2  # what columns without a name refer to
    meaning = np.concatenate([aliased, plain, opened])
    refs = np.concatenate([alias[aliased], np.full(len(plain), bare), opened_name])
    known = named[meaning] >= 0
    meaning, refs = meaning[known], refs[known]
    empty = text.code("")
    refs = np.where(refs == empty, bare, refs)
    null_name = text.code(rules["none"])  # a nameless table is asked for by this text
    asked = np.where(dot[reported], np.where(named[reported] < 0, null_name, named[reported]), bare)
    asked = np.where(asked == empty, bare, asked)
    hit = _latest((query[meaning], refs), order[meaning], (query[reported], asked), order[reported])
    table_code = np.where(hit >= 0, named[meaning][hit] if len(meaning) else -1, -1)

    pick = lambda words, rows: words.text(words.at(rows[reported]))
    ints = lambda rows: pa.array(rows[reported].astype(np.int32), mask=rows[reported] < 0)
    blocked = blocker[reported]
    cond = np.where(blocked < 0, -1, np.where(is_sign[blocked], 0, 1))
    kinds = pa.array(["comparison", "function"])
    own = pa.array(reported)
    columns = {
        "query_id": table.column("query_id").take(own).combine_chunks(),
        "node_order": table.column("node_order").take(own).combine_chunks(),
        "token": token.text(token.codes[reported]),
        "text": text.text(text.codes[reported]),
        "clause": pa.array(names).take(pa.array(clauses[reported])),
        "part": pa.array(part[reported]),
        "tabName": text.text(table_code),
        "c0_text": pick(text, child[0]),
        "c1_token": pick(token, child[1]),
        "c1_text": pick(text, child[1]),
        "last_token": pick(token, last),
        "last_text": pick(text, last),
        "n": pa.array(n[reported].astype(np.int32)),
        "g00": pick(text, g00),
        "g10": pick(text, _at(child[0], child[1])),
        "g11": pick(text, _at(child[1], child[1])),
        "function": pick(text, _at(child[0], calls)),
        "lookup": pick(text, _at(child[1], lookups)),
        "is_lookup": pa.array(lookups[reported] >= 0),
        "bracket_text": pick(text, _at(child[1], bracket)),
        "bracket_via": ints(bracket_via),
        "cond_kind": kinds.take(pa.array(cond, mask=cond < 0)),
        "cond_via": ints(blocker_via),
        "cond_sign": pick(text, blocker),
        "cond_token": pick(token, _at(child[0], blocker)),
        "cond_value": pick(text, _at(child[1], blocker)),
        "item_token": pick(token, _at(child[0], owner)),
        "outer_name": pick(text, _at(_at(child[0], child[0]), owner)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def walked(nodes: DataFrame, rules: dict) -> DataFrame:
    """The reported nodes of all queries, by one shuffle on the query."""

    own = nodes.where("path is not null").select(
        "query_id", "node_order", "token", "text", F.array_join(F.col("path").cast("array<string>"), ".", NO_STEP).alias("path")
    )
    kinds = {f: nodes.schema[f].dataType.simpleString() for f in ("query_id", "node_order")}
    return whole_keys(own, "query_id", lambda table: walk(table, rules), WALKED.format(**kinds), BATCH_NODES)
