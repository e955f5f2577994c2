"""Oracle statements for the facts from syntax trees."""

from __future__ import annotations

from wtel.fixtures.views import duck

_JOINS = (
    "('TOK_JOIN', 'TOK_LEFTOUTERJOIN', 'TOK_RIGHTOUTERJOIN', 'TOK_FULLOUTERJOIN',"
    " 'TOK_LEFTSEMIJOIN')"
)
_SIGNS = "('=', '<=', '>=', '<', '>', '!=', '<>')"

# kid(q, parent, pos) and up(node, ancestor) relations, clauses by smallest depth.
_BASE = f"""
    node AS MATERIALIZED (
      SELECT query_id AS q, path AS p, len(path) AS d, node_order AS o, token, text,
        path[1:len(path) - 1] AS par, path[len(path)] AS pos FROM $ast_nodes),
    cand AS (
      SELECT * FROM node
      WHERE text = '.' OR token IN ('TOK_TABLE_OR_COL', 'TOK_TABREF', 'TOK_SUBQUERY')),
    mark AS (
      SELECT q, p, d, token, text FROM node
      WHERE token IN ('TOK_SELEXPR', 'TOK_WHERE', 'TOK_GROUPBY', 'TOK_FUNCTION')
        OR token IN {_JOINS} OR text IN {_SIGNS} OR text IN ('.', '[')),
    up AS MATERIALIZED (
      SELECT c.q, c.o, c.p AS cp, m.p AS mp, m.d AS md, m.token AS mtoken, m.text AS mtext,
        c.p[m.d + 1] AS via
      FROM cand c JOIN mark m ON c.q = m.q AND m.d < c.d AND c.p[1:m.d] = m.p),
    owner AS (
      SELECT q, o, min(md) AS md, arg_min(mtoken, md) AS token, arg_min(via, md) AS via,
        arg_min(mp, md) AS mp FROM up
      WHERE mtoken IN ('TOK_SELEXPR', 'TOK_WHERE', 'TOK_GROUPBY') OR (mtoken IN {_JOINS} AND via = 2)
      GROUP BY q, o),
    below AS (
      SELECT c.q, c.o, bool_or(n.token = 'TOK_FROM') AS from_above, bool_or(n.token = 'TOK_TABREF') AS table_above
      FROM cand c JOIN node n ON n.q = c.q AND n.d < c.d AND c.p[1:n.d] = n.p
      WHERE n.token IN ('TOK_FROM', 'TOK_TABREF') GROUP BY c.q, c.o),
    claused AS MATERIALIZED (
      SELECT c.*, ow.md, ow.mp, CASE WHEN ow.token IS NULL THEN
          CASE WHEN b.from_above AND NOT b.table_above THEN 'FROM' END
        WHEN ow.token = 'TOK_GROUPBY' THEN 'GROUPBY'
        WHEN ow.token = 'TOK_SELEXPR' THEN CASE WHEN ow.via = 0 THEN 'SELEXPR' END
        WHEN ow.token = 'TOK_WHERE' THEN CASE WHEN ow.via = 0 THEN 'WHERE' END
        ELSE 'JOIN_ON' END AS clause
      FROM cand c LEFT JOIN owner ow USING (q, o) LEFT JOIN below b USING (q, o)),
    ref AS (
      SELECT t.q, t.o, nm.text AS tab, count(k.q) AS n, arg_max(k.token, k.pos) AS last_token,
        arg_max(k.text, k.pos) AS last_text, max(CASE WHEN k.pos = 1 THEN k.token END) AS second,
        t.p
      FROM claused t JOIN node k ON k.q = t.q AND k.par = t.p
      JOIN node nm ON nm.q = t.q AND nm.p = list_concat(t.p, [0, 0])
      WHERE t.token = 'TOK_TABREF' AND t.clause = 'FROM' GROUP BY t.q, t.o, nm.text, t.p),
    tab AS (
      SELECT r.q, r.o, r.tab, n > 1 AND last_token <> 'TOK_TABLEBUCKETSAMPLE' AS is_alias,
        CASE WHEN n > 1 AND last_token <> 'TOK_TABLEBUCKETSAMPLE' THEN last_text END AS alias,
        last_token = 'TOK_TABLEBUCKETSAMPLE' AND n = 2 AS sampled,
        s1.text AS sel, s2.text AS total
      FROM ref r
      LEFT JOIN node s1 ON s1.q = r.q AND s1.p = list_concat(r.p, [1, 0])
      LEFT JOIN node s2 ON s2.q = r.q AND s2.p = list_concat(r.p, [1, 1])),
    sub AS (
      SELECT c.q, c.o, k.text AS name FROM claused c
      JOIN node k ON k.q = c.q AND k.p = list_concat(c.p, [1])
      WHERE c.token = 'TOK_SUBQUERY' AND c.clause = 'FROM'),
    plain AS (SELECT q, o, tab FROM tab WHERE NOT is_alias),
    opened AS (
      SELECT p.q, p.o, p.tab, max(s.o) AS so, arg_max(s.name, s.o) AS name
      FROM plain p JOIN sub s ON s.q = p.q AND s.o < p.o GROUP BY p.q, p.o, p.tab),
    means AS (
      SELECT q, o, alias AS ref, tab FROM tab WHERE is_alias
      UNION ALL SELECT q, o, '' AS ref, tab FROM plain
      UNION ALL SELECT x.q, x.o, x.name, x.tab FROM opened x
        WHERE NOT EXISTS (SELECT 1 FROM plain z WHERE z.q = x.q AND z.o > x.so AND z.o < x.o)),
    col AS (
      SELECT c.*, CASE WHEN c.text = '.' THEN a.text ELSE '' END AS ref,
        CASE WHEN c.text = '.' THEN k1.text ELSE k0.text END AS name
      FROM claused c
      LEFT JOIN node k0 ON k0.q = c.q AND k0.p = list_concat(c.p, [0])
      LEFT JOIN node k1 ON k1.q = c.q AND k1.p = list_concat(c.p, [1])
      LEFT JOIN node a ON a.q = c.q AND a.p = list_concat(c.p, [0, 0])
      WHERE c.token NOT IN ('TOK_TABREF', 'TOK_SUBQUERY') AND c.clause IS NOT NULL
        AND c.clause <> 'FROM'
        AND NOT EXISTS (SELECT 1 FROM up u WHERE u.q = c.q AND u.o = c.o AND u.mtext = '.'
          AND u.md > c.md)),
    inside AS (
      SELECT u.q, u.o, u.md, u.mtoken, u.mtext, u.via, k0.text AS k0, k0.token AS k0_token,
        k1.text AS k1
      FROM up u JOIN col c ON c.q = u.q AND c.o = u.o AND u.md > c.md
      LEFT JOIN node k0 ON k0.q = u.q AND k0.p = list_concat(u.mp, [0])
      LEFT JOIN node k1 ON k1.q = u.q AND k1.p = list_concat(u.mp, [1])),
    fun AS (
      SELECT q, o, arg_max(k0, md) AS fname, arg_max(k1, md) FILTER (k0 = 'dim_lookup') AS dim
      FROM inside WHERE mtoken = 'TOK_FUNCTION' GROUP BY q, o),
    br AS (
      SELECT q, o, arg_max(via, md) AS via, arg_max(k1, md) AS idx
      FROM inside WHERE mtext = '[' GROUP BY q, o),
    blk AS (
      SELECT q, o, arg_min(mtoken, md) AS token, arg_min(mtext, md) AS sign, arg_min(via, md) AS via,
        arg_min(k0_token, md) AS k0_token, arg_min(k1, md) AS val
      FROM inside WHERE mtoken = 'TOK_FUNCTION' OR mtext IN {_SIGNS} GROUP BY q, o),
    named AS (
      SELECT c.q, c.o, arg_max(m.tab, m.o) AS tab FROM col c
      JOIN means m ON m.q = c.q AND m.ref = c.ref AND m.o < c.o GROUP BY c.q, c.o),
    fact AS MATERIALIZED (
      SELECT c.q AS queryId, c.o, c.clause, coalesce(named.tab, 'null') AS tabName,
        c.name AS colName, coalesce(br.via = 0, false) AS isArray,
        fun.dim IS NOT NULL AS isDimLookup,
        CASE WHEN br.via = 0 THEN coalesce(try_cast(br.idx AS integer), -1) ELSE 0 END AS arrayIndex,
        coalesce(fun.dim, '') AS dimTabName, fun.fname, c.mp, blk.token AS b_token, blk.sign,
        blk.via AS b_via, blk.k0_token, blk.val
      FROM col c LEFT JOIN named ON named.q = c.q AND named.o = c.o
      LEFT JOIN fun ON fun.q = c.q AND fun.o = c.o
      LEFT JOIN br ON br.q = c.q AND br.o = c.o
      LEFT JOIN blk ON blk.q = c.q AND blk.o = c.o)"""

_ATTRS = "queryId, tabName, colName, isArray, isDimLookup, arrayIndex, dimTabName"


def statements() -> dict[str, str]:
    base = f"WITH {_BASE}"
    q = {
        "sem2_datasets": f"""{base}
            SELECT q AS queryId, tab AS tabName, sampled AS isTabSample,
              CASE WHEN sampled THEN coalesce(try_cast(sel AS integer), 0) ELSE 0 END AS selBuckets,
              CASE WHEN sampled THEN coalesce(try_cast(total AS integer), 0) ELSE 0 END AS totalBuckets
            FROM tab""",
        "sem3_bucket_samples": f"""{base}
            SELECT q AS queryId, tab AS tabName, coalesce(try_cast(sel AS integer), 0) AS selBuckets,
              coalesce(try_cast(total AS integer), 0) AS totalBuckets FROM tab WHERE sampled""",
        "sem4_clause_of": f"""{base}
            SELECT q AS query_id, o AS node_order, token, clause FROM claused
            WHERE clause IS NOT NULL AND token <> 'TOK_SUBQUERY'""",
        "sem5_projections": f"""{base}
            SELECT {_ATTRS}, coalesce(fname, CASE WHEN i.token IN ('TOK_FUNCTION', 'TOK_FUNCTIONDI',
              'TOK_FUNCTIONSTAR') THEN i0.text END, 'null') AS agg
            FROM fact
            LEFT JOIN node i ON i.q = queryId AND i.p = list_concat(mp, [0])
            LEFT JOIN node i0 ON i0.q = queryId AND i0.p = list_concat(mp, [0, 0])
            WHERE clause = 'SELEXPR'""",
        "sem6_filters": f"""{base}
            SELECT {_ATTRS}, CASE WHEN b_token <> 'TOK_FUNCTION' THEN sign
                WHEN k0_token = 'TOK_ISNULL' THEN 'ISNULL' ELSE 'ISNOTNULL' END AS operator,
              CASE WHEN b_token <> 'TOK_FUNCTION' THEN val ELSE 'null' END AS value
            FROM fact WHERE clause = 'WHERE' AND (
              (b_token <> 'TOK_FUNCTION' AND b_via = 0)
              OR (b_token = 'TOK_FUNCTION' AND b_via = 1
                AND k0_token IN ('TOK_ISNULL', 'TOK_ISNOTNULL')))""",
        "sem7_join_attributes": f"{base} SELECT {_ATTRS} FROM fact WHERE clause = 'JOIN_ON'",
        "sem8_grouping_attributes": f"{base} SELECT {_ATTRS} FROM fact WHERE clause = 'GROUPBY'",
        "sem9_array_index": f"""{base}
            SELECT queryId, o AS node_order, colName, arrayIndex FROM fact WHERE isArray""",
        "sem10_dim_lookup": f"""{base}
            SELECT queryId, o AS node_order, colName, dimTabName FROM fact WHERE isDimLookup""",
        "jn2_resolve_column_table": f"""{base}
            SELECT queryId, o AS node_order, clause, colName, tabName FROM fact""",
    }
    return {key: duck(body) for key, body in q.items()}
