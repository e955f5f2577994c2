"""Forests of operators as JSON text, for the tasks of many queries at a time.

A forest's text is the series of its operators, depth first, with the brackets that open and close between
two of them. Depths, sizes and places in the series are found level by level with array operations.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _member(name: str, values: pa.Array) -> pa.Array:
    """``,"name":"value"`` as JSON text; empty for null."""
    coded = values.dictionary_encode()
    shown = pa.array([f',"{name}":{json.dumps(v, ensure_ascii=False)}' for v in coded.dictionary.to_pylist()], pa.string())
    return pc.fill_null(shown.take(coded.indices), "")


def _groups(*codes: np.ndarray) -> np.ndarray:
    """One number for each combination of codes, in their order."""
    out = codes[0]
    for code in codes[1:]:
        out = np.unique(out * (code.max(initial=0) + 2) + code + 1, return_inverse=True)[1]
    return out


def _coded(values: pa.Array) -> np.ndarray:
    """Codes in the order of the values; -1 for null."""
    coded = values.dictionary_encode()
    rank = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
    return np.append(rank, -1)[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)].astype(np.int64)


def texts(table: pa.Table, children: str) -> pa.RecordBatch:
    """query_id, stage_id, task_type and forest of the operators of whole queries; operators below none are roots."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    task = _groups(column["query_id"].dictionary_encode().indices.to_numpy().astype(np.int64), _coded(column["stage_id"]), _coded(column["task_type"]))
    size = len(task)
    ids = _coded(pa.concat_arrays([column["op_id"], column["parent_op_id"]]))
    width = ids.max(initial=0) + 2
    key, above = task * width + ids[:size] + 1, task * width + ids[size:] + 1
    by = np.argsort(key, kind="stable")
    found = by[np.minimum(np.searchsorted(key[by], above), size - 1)]
    parent = np.where((ids[size:] >= 0) & (key[found] == above), found, -1)

    # siblings follow each other, roots by their task; ``cuts`` are the places of an operator's children
    seq = pc.fill_null(column["seq"], np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((ids[:size], seq, task, parent))
    cuts = np.searchsorted(parent[order], np.arange(-1, size + 1))
    newest = order[: cuts[1]]
    depth = np.full(size, -1)
    levels = []
    while len(newest):
        depth[newest] = len(levels)
        levels.append(newest)
        counts = cuts[newest + 2] - cuts[newest + 1]
        ends = np.cumsum(counts)
        newest = order[np.arange(ends[-1]) + np.repeat(cuts[newest + 1] - (ends - counts), counts)]
    below = np.ones(size, np.int64)
    for level in levels[:0:-1]:
        np.add.at(below, parent[level], below[level])
    place = np.zeros(size, np.int64)
    for i, level in enumerate(levels):
        before = np.cumsum(below[level]) - below[level]
        if i:
            first = np.append(True, parent[level][1:] != parent[level][:-1])
            before = before - before[first][np.cumsum(first) - 1] + place[parent[level]] + 1
        place[level] = before
    reached = np.flatnonzero(depth >= 0)  # operators in a circle hang below no root
    walk = reached[np.argsort(place[reached])]

    head = pc.binary_join_element_wise(
        _member("operatorId", column["op_id"]), _member("operatorType", column["op_type"]), _member("comment", column["comment"]), f',"{children}":[', ""
    )
    head = pc.binary_join_element_wise("{", pc.utf8_slice_codeunits(head, 1), "").take(pa.array(walk))
    task, depth = task[walk], depth[walk]
    starts = np.flatnonzero(np.append(True, task[1:] != task[:-1])[: len(task)])
    # brackets that close before an operator: its elder siblings' and those of what is below them
    closed = np.append(0, depth[:-1] - depth[1:] + 1)[: len(depth)]
    closed[starts] = 0
    counts, which = np.unique(closed, return_inverse=True)
    lead = pa.array(["]}" * int(n) + "," * int(n > 0) for n in counts], pa.string()).take(pa.array(which))
    parts = pc.binary_join_element_wise(lead, head, "")
    ends = np.append(starts[1:], len(task))
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(task)), pa.int32()), parts), "")
    counts, which = np.unique(depth[ends - 1] + 1, return_inverse=True)
    tail = pa.array(["]}" * int(n) + "]" for n in counts], pa.string()).take(pa.array(which))
    names = ["query_id", "stage_id", "task_type"]
    at = pa.array(walk[starts])
    return pa.RecordBatch.from_arrays([*[column[c].take(at) for c in names], pc.binary_join_element_wise("[", body, tail, "")], [*names, "forest"])


def by_query(told: pa.RecordBatch) -> pa.RecordBatch:
    """query_id and ``forests``: per query the rows of ``texts``, which follow each other, by stage and task."""
    names = ["stage_id", "task_type", "forest"]
    query = told.column("query_id").dictionary_encode()
    q = query.indices.to_numpy()
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    rows = pa.StructArray.from_arrays([told.column(c).cast(pa.string()) for c in names], names)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)), pa.int32()), rows)
    return pa.RecordBatch.from_arrays([told.column("query_id").take(pa.array(starts)), lists], ["query_id", "forests"])
