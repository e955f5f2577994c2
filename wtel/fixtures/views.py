"""Telemetry views derived from the given tables, as SQL text for Spark and for DuckDB.

The text is the same for both but for the few functions named in ``Dialect``. ``$name`` stands
for a given table or for another view.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wtel import schemas
from wtel.fixtures import templates

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

BASE_MS = 1_704_067_200_000  # all derived clocks start here


class Dialect:
    """The functions that Spark and DuckDB spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def ms(self, ts: str) -> str:
        if self.spark:
            return f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"
        return f"(epoch_us({ts}) // 1000)"

    def div(self, a: str, b: object) -> str:
        return f"(({a}) {'div' if self.spark else '//'} ({b}))"

    def text(self, expr: str) -> str:
        return f"cast({expr} as string)"

    def agg_text(self, expr: str, order: str, sep: str = ",") -> str:
        if self.spark:
            return f"listagg({expr}, '{sep}') within group (order by {order})"
        return f"string_agg({expr}, '{sep}' order by {order})"

    def array(self, *items: str) -> str:
        if not items:
            return "cast(array() as array<string>)" if self.spark else "cast([] as varchar[])"
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def concat(self, *arrays: str) -> str:
        if self.spark:
            return f"concat({', '.join(arrays)})"
        return " || ".join(f"({a})" for a in arrays)

    def path(self, expr: str) -> str:
        if self.spark:
            return f"cast(split({expr}, '[.]') as array<int>)"
        return f"cast(string_split({expr}, '.') as int[])"

    def nodes(self, values: str) -> str:
        """Syntax-tree rows ``t`` to join queries with; Spark cuts their few paths once, not for every query."""
        names = "(shape, path, node_order, token, text)"
        if not self.spark:
            return f"(VALUES {values})\n          AS t{names}"
        return f"(SELECT shape, {self.path('path')} AS path, node_order, token, text FROM VALUES {values} AS v{names}) AS t"

    def stamp(self, ts: str) -> str:
        if self.spark:
            return f"date_format({ts}, 'yyyyMMddHHmm')"
        return f"strftime({ts}, '%Y%m%d%H%M')"

    def plus_minutes(self, ts: str, n: str) -> str:
        if self.spark:
            return f"timestampadd(MINUTE, cast({n} as int), {ts})"
        return f"({ts} + to_minutes(cast({n} as bigint)))"

    def k(self) -> str:
        """The number in ``events.props``."""
        return "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"


def _json(d: Dialect, pairs: list[tuple[str, str]]) -> str:
    """JSON object text; a value expression that is null leaves its field out."""
    body = " || ".join(f"coalesce('\"{n}\":' || {v} || ',', '')" for n, v in pairs)
    return "'{' || " + body + " || '\"extra\":0}'"


def _q(expr: str) -> str:
    """Quoted JSON text."""
    return f"('\"' || {expr} || '\"')"


def _views(d: Dialect) -> dict[str, str]:
    v: dict[str, str] = {}
    num = d.text

    # --- cluster polls -------------------------------------------------------------------
    cluster = schemas.names(schemas.CLUSTER)
    fields = ",\n".join(
        f"({d.div(f'event_id + {3 * i}', 4 + i)} + user_id % {2 + i % 3}) % {7 + i} AS {f}"
        for i, f in enumerate(cluster)
    )
    v["cluster_flat"] = f"""
        SELECT event_id AS poll_no, {d.ms('ts')} AS record_time, {fields} FROM $events"""
    doc = _json(d, [(f, num(f)) for f in cluster])
    v["cluster_docs"] = f"""
        SELECT poll_no, record_time, '{{"clusterMetrics":' || {doc} || '}}' AS doc
        FROM $cluster_flat
        UNION ALL SELECT -1 - event_id, 0, 'not json' FROM $events WHERE event_id < 3"""

    # --- application polls: 40 events make one poll --------------------------------------
    v["apps_flat"] = f"""
        WITH seen AS (
          SELECT {d.div('event_id', 40)} AS p, user_id AS u, max(event_id) AS e, count(*) AS n
          FROM $events GROUP BY 1, 2)
        SELECT p AS poll_no, {BASE_MS} + p * 250 AS record_time,
          'application_' || {num('u')} AS id, e * 1000 AS finishedTime,
          CASE WHEN e % 4 <> 0 THEN 'logs/' || {num('u')} END AS amContainerLogs,
          'UI' AS trackingUI,
          CASE e % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'ACCEPTED' ELSE 'FINISHED' END AS state,
          'user' || {num('u % 7')} AS "user", u % 3 AS clusterId,
          CASE WHEN e % 3 = 2 THEN 'SUCCEEDED' ELSE 'UNDEFINED' END AS finalStatus,
          'host' || {num('u % 5')} AS amHostHttpAddress,
          {num('e % 100')} || CASE WHEN e % 2 = 0 THEN '.5' ELSE '.0' END AS progress,
          'job ' || {num('u')} AS name, {BASE_MS} + u AS startedTime, e * 10 AS elapsedTime,
          CASE WHEN e % 5 <> 0 THEN 'ok' END AS diagnostics,
          'url/' || {num('u')} AS trackingURL,
          CASE WHEN e % 6 <> 0 THEN 'queue' || {num('e % 2')} END AS queue,
          (e % 8) * 512 AS allocatedMB, n AS allocatedVCores, e % 4 AS runningContainers
        FROM seen"""
    if d.spark:
        v["apps_flat"] = v["apps_flat"].replace('"user"', "`user`")
    user = "`user`" if d.spark else '"user"'
    apps = schemas.names(schemas.APP)
    app_text = set("amContainerLogs trackingUI state user id finalStatus amHostHttpAddress name"
                   " diagnostics trackingURL queue".split())
    doc = _json(
        d,
        [
            (f, _q(user if f == "user" else f) if f in app_text else num(f))
            for f in apps
        ],
    )
    v["apps_docs"] = f"""
        SELECT poll_no, max(record_time) AS record_time,
          '{{"apps":{{"app":[' || {d.agg_text(doc, 'id')} || ']}}}}' AS doc
        FROM $apps_flat GROUP BY poll_no
        UNION ALL SELECT -1 - event_id, 0,
          CASE event_id WHEN 0 THEN '{{"apps":null}}' WHEN 1 THEN '{{"apps":{{}}}}' ELSE '[' END
        FROM $events WHERE event_id < 3"""

    # --- scheduler polls: one queue per event type ---------------------------------------
    v["queues_flat"] = f"""
        WITH seen AS (
          SELECT {d.div('event_id', 40)} AS p, event_type AS queueName, count(*) AS n,
            sum({d.k()}) AS k, max({d.k()}) AS m, count(DISTINCT user_id) AS users,
            sum(user_id) AS u, max(event_id) AS e
          FROM $events GROUP BY 1, 2)
        SELECT p AS poll_no, {BASE_MS} + p * 250 AS record_time, queueName,
          {num('n')} || '.5' AS capacity, {num('k % 9')} || '.0' AS usedCapacity,
          n AS numApplications,
          CASE WHEN k % 3 <> 0 THEN 'used ' || {num('k % 4')} END AS usedResources,
          CASE WHEN e % 7 = 0 THEN 'STOPPED' ELSE 'RUNNING' END AS state,
          users AS numActiveApplications, cast(k as bigint) AS numContainers,
          m AS maxApplications,
          CASE WHEN e % 5 <> 0 THEN cast(u % 50 as bigint) END AS memory, n AS vCores
        FROM seen"""
    doc = _json(
        d,
        [
            ("queueName", _q("queueName")), ("capacity", "capacity"),
            ("usedCapacity", "usedCapacity"), ("numApplications", num("numApplications")),
            ("usedResources", _q("usedResources")), ("state", _q("state")),
            ("numActiveApplications", num("numActiveApplications")),
            ("numContainers", num("numContainers")), ("maxApplications", num("maxApplications")),
            ("users", "'{\"username\":\"a\"}'"), ("queues", "'[]'"),
            ("resourcesUsed", f"('{{\"memory\":' || {num('memory')} || ',\"vCores\":' || {num('vCores')} || '}}')"),
        ],
    )
    v["scheduler_docs"] = f"""
        SELECT poll_no, max(record_time) AS record_time,
          '{{"scheduler":{{"schedulerInfo":{{"queues":{{"queue":[' || {d.agg_text(doc, 'queueName')}
          || ']}}}}}}}}' AS doc
        FROM $queues_flat GROUP BY poll_no"""

    # --- node polls: 100 events make one poll, 2000 events one generation of applications -
    v["node_events"] = f"""
        SELECT event_id AS e, {d.div('event_id', 100)} AS p, user_id AS u, event_type, {d.k()} AS k,
          'node' || {num('user_id % 3')} || ':8042' AS node,
          'application_' || {num(d.div('event_id', 2000))} || '_' || {num('user_id % 20')} AS app
        FROM $events"""
    v["node_apps_flat"] = f"""
        SELECT p AS poll_no, {BASE_MS} + p * 500 AS record_time, node, app AS id,
          'user' || {num('max(u) % 4')} AS {user},
          CASE WHEN max(e) % 2000 > 900 + 45 * (max(u) % 20) OR (max(e) < 2000 AND max(u) % 20 = 19)
            THEN 'FINISHED' ELSE 'RUNNING' END AS state,
          CASE WHEN count(*) > 1 OR max(k) % 5 <> 0 THEN
            {d.agg_text("DISTINCT 'container_' || app || '_' || " + num('k % 6'),
                        "'container_' || app || '_' || " + num('k % 6'))} END AS containers
        FROM $node_events GROUP BY p, node, app"""
    split = "replace(containers, ',', '\",\"')"
    doc = _json(
        d,
        [("id", _q("id")), ("user", _q(user)), ("state", _q("state")),
         ("containerids", f"('[\"' || {split} || '\"]')")],
    )
    v["node_apps_docs"] = f"""
        SELECT poll_no, max(record_time) AS record_time, node,
          '{{"apps":{{"app":[' || {d.agg_text(doc, 'id')} || ']}}}}' AS doc
        FROM $node_apps_flat GROUP BY poll_no, node"""
    v["container_events"] = f"""
        SELECT p AS poll_no, {BASE_MS} + p * 500 AS record_time, node, e,
          'container_' || app || '_' || {num('k % 6')} AS id,
          CASE WHEN event_type = 'error' THEN 'DONE' ELSE 'RUNNING' END AS state,
          replace(node, ':8042', ':45454') AS nodeId, 'link' || {num('e')} AS containerLogsLink,
          'user' || {num('u % 4')} AS {user}, e % 3 AS exitCode,
          CASE WHEN k % 4 <> 0 THEN 'diag ' || {num('k % 4')} END AS diagnostics,
          1024 * (1 + k % 3) AS totalMemoryNeededMB, 1 + k % 2 AS totalVCoresNeeded
        FROM $node_events"""
    doc = _json(
        d,
        [("id", _q("id")), ("state", _q("state")), ("nodeId", _q("nodeId")),
         ("containerLogsLink", _q("containerLogsLink")), ("user", _q(user)),
         ("exitCode", num("exitCode")), ("diagnostics", _q("diagnostics")),
         ("totalMemoryNeededMB", num("totalMemoryNeededMB")),
         ("totalVCoresNeeded", num("totalVCoresNeeded"))],
    )
    v["container_docs"] = f"""
        SELECT poll_no, max(record_time) AS record_time, node,
          '{{"containers":{{"container":[' || {d.agg_text(doc, 'e')} || ']}}}}' AS doc
        FROM $container_events GROUP BY poll_no, node"""
    v["containers_flat"] = """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY poll_no, node, id ORDER BY e DESC) AS rn
          FROM $container_events) x WHERE rn = 1"""
    doc = _json(
        d,
        [("id", _q("node")), ("nodeHTTPAddress", _q("node")), ("state", "'\"RUNNING\"'"),
         ("numContainers", num("n"))],
    )
    v["nodes_docs"] = f"""
        SELECT p AS poll_no, {BASE_MS} + p * 500 AS record_time,
          '{{"nodes":{{"node":[' || {d.agg_text(doc, 'node')} || ']}}}}' AS doc
        FROM (SELECT p, node, count(*) AS n FROM $node_events GROUP BY p, node) x GROUP BY p"""

    # --- metric packets ------------------------------------------------------------------
    v["packets"] = f"""
        SELECT event_id AS seq, {d.ms('ts')} AS ts,
          CASE event_id % 97
            WHEN 3 THEN 'my.prefix.' || event_type || '12|c'
            WHEN 5 THEN ''
            WHEN 7 THEN 'my.prefix.' || event_type || ':abc|c'
            WHEN 11 THEN 'my.prefix.view:3|ms'
            WHEN 13 THEN 'my.prefix.' || event_type || ':-4|c'
            ELSE 'my.prefix.' || event_type || ':' || {num('cast(floor(value) as bigint)')}
              || CASE WHEN event_type IN ('error', 'signup') THEN '|g' ELSE '|c' END
          END AS line
        FROM $events"""
    v["registry"] = """
        SELECT DISTINCT
          CASE WHEN event_type IN ('error', 'signup') THEN 'gauges' ELSE 'counts' END AS table_name,
          event_type AS tag FROM $events
        UNION ALL SELECT 'counts', r_name FROM $region"""

    # --- query log -----------------------------------------------------------------------
    v["query_log"] = """
        SELECT o_orderkey AS query_id, o_orderdate AS start_time,
          CASE o_orderkey % 9
            WHEN 0 THEN 'use default'
            WHEN 1 THEN 'CREATE TABLE t' || cast(o_custkey as string) || ' (a int)'
            WHEN 2 THEN 'EXPLAIN SELECT a FROM impressions'
            WHEN 3 THEN chr(10) || 'explain select a from Actions'
            WHEN 4 THEN 'SELECT a FROM Impressions WHERE b = ' || cast(o_custkey as string)
            WHEN 5 THEN 'select c from sales'
            WHEN 6 THEN 'INSERT INTO t VALUES (''select'')'
            WHEN 7 THEN chr(10) || chr(10) || chr(10) || 'EXPLAIN SELECT x FROM rtbids'
            ELSE 'sElEcT count(*) from RTBIDS r join actions a on r.k = a.k'
          END AS query_string
        FROM $orders"""

    # --- syntax trees --------------------------------------------------------------------
    v["ast_nodes"] = f"""
        SELECT o_orderkey AS query_id, {'t.path' if d.spark else d.path('t.path')} AS path, t.node_order AS node_order,
          t.token AS token,
          replace(t.text, '#', cast(o_custkey % 50 as string)) AS text
        FROM $orders JOIN {d.nodes(templates.ast_values())}
          ON o_orderkey % {templates.AST_SHAPES} = t.shape"""

    # --- workflow, component and query events: customer > order > line -------------------
    v["lines"] = """
        SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
            l_shipdate) AS ln,
          count(*) OVER (PARTITION BY l_orderkey) AS n_lines
        FROM $lineitem l"""
    v["run_queries"] = f"""
        SELECT o_custkey AS run, o_orderkey AS component, o_orderkey * 100 + ln AS query,
          {BASE_MS} + o_orderkey * 1000000 + ln * 1000 AS q_start,
          {BASE_MS} + o_orderkey * 1000000 + ln * 1000 + 500 + l_partkey % 400 AS q_end,
          'SELECT ' || cast(l_partkey as string) AS query_string, l.*
        FROM $lines l JOIN $orders ON l_orderkey = o_orderkey"""
    v["lifecycle_events"] = f"""
        SELECT run, 'query' AS level, 'started' AS kind, query AS key, component AS parent,
          query_string AS name, 'hive' AS engine, '' AS user_name, q_start AS ts FROM $run_queries
        UNION ALL SELECT run, 'query', 'completed', query, component, query_string, 'hive', '', q_end
          FROM $run_queries
        UNION ALL SELECT o_custkey, 'component', 'started', o_orderkey, o_custkey, o_orderpriority,
          'spark', '', {BASE_MS} + o_orderkey * 1000000 FROM $orders
        UNION ALL SELECT o_custkey, 'component', 'completed', o_orderkey, o_custkey, o_orderpriority,
          'spark', '', {BASE_MS} + o_orderkey * 1000000 + 900000 FROM $orders
        UNION ALL SELECT o_custkey, 'workflow', 'started', o_custkey, 0, c_name, '', c_mktsegment,
          {BASE_MS} - 10 + min(o_orderkey) * 1000000
          FROM $orders JOIN $customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name, c_mktsegment
        UNION ALL SELECT o_custkey, 'workflow', 'completed', o_custkey, 0, c_name, '', c_mktsegment,
          {BASE_MS} + max(o_orderkey) * 1000000 + 950000
          FROM $orders JOIN $customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name, c_mktsegment"""

    # --- stages of a query: one per line -------------------------------------------------
    def stage(expr: str) -> str:
        return "'Stage-' || " + num(expr)

    v["stages"] = f"""
        SELECT l_orderkey AS query_id, ln AS stage_no, {stage('ln')} AS stage_id,
          CASE l_linenumber % 4 WHEN 0 THEN 'CONDITIONAL' WHEN 1 THEN 'MOVE' ELSE 'MAPRED' END
            AS stage_type,
          CASE WHEN l_partkey % 10 <> 0
            THEN 'job_' || {num('l_orderkey')} || '_' || {num('ln')} END AS job_id,
          {d.concat(
              f"CASE WHEN ln < n_lines AND l_suppkey % 3 <> 0 THEN {d.array(stage('ln + 1'))} ELSE {d.array()} END",
              f"CASE WHEN ln + 2 <= n_lines AND l_suppkey % 4 = 0 THEN {d.array(stage('ln + 2'))} ELSE {d.array()} END")}
            AS children,
          CASE WHEN ln + 3 <= n_lines AND l_suppkey % 5 = 0 THEN {d.array(stage('ln + 3'))} END
            AS backup,
          CASE WHEN ln + 1 <= n_lines AND l_suppkey % 7 = 0
            THEN {d.array(stage('ln + 1'), stage('n_lines'))} END AS conditional,
          l_suppkey % 6 = 1 AS running, cast(l_partkey % 4 as int) AS exit_code,
          'task.' || l_returnflag AS task_kind,
          {BASE_MS} + l_orderkey * 1000000 AS query_start,
          {BASE_MS} + l_orderkey * 1000000 + 60000 AS query_end
        FROM $lines"""
    v["jobs"] = f"""
        SELECT 'job_' || {num('l_orderkey')} || '_' || {num('ln')} AS job_id,
          {BASE_MS} + l_orderkey * 1000000 + ln * 1000 + l_partkey % 100 AS start_time
        FROM $lines WHERE l_partkey % 13 <> 0"""

    # --- plan nodes ----------------------------------------------------------------------
    v["plan_ops"] = f"""
        SELECT o_orderkey AS query_id, t.stage_id AS stage_id, t.task_type AS task_type,
          t.op_id AS op_id, t.parent_op_id AS parent_op_id, t.op_type AS op_type,
          t.variant AS variant, t.seq AS seq
        FROM $orders JOIN (VALUES {templates.op_values()})
          AS t(shape, stage_id, task_type, op_id, parent_op_id, op_type, variant, seq)
          ON o_orderkey % {templates.PLAN_SHAPES} = t.shape"""
    v["op_attrs"] = f"""
        SELECT o_orderkey AS query_id, t.stage_id AS stage_id, t.op_id AS op_id, t.attr AS attr,
          t.pos AS pos, replace(t.value, '#', cast(o_custkey % 50 as string)) AS value,
          t.kind AS kind, t.alias AS alias
        FROM $orders JOIN (VALUES {templates.attr_values()})
          AS t(shape, stage_id, op_id, attr, pos, value, kind, alias)
          ON o_orderkey % {templates.PLAN_SHAPES} = t.shape"""
    v["stage_aliases"] = f"""
        SELECT o_orderkey AS query_id, t.stage_id AS stage_id, t.alias AS alias,
          replace(t.full_table, '#', cast(o_custkey % 50 as string)) AS full_table, t.pos AS pos
        FROM $orders JOIN (VALUES {templates.alias_values()})
          AS t(shape, stage_id, alias, full_table, pos)
          ON o_orderkey % {templates.PLAN_SHAPES} = t.shape"""
    v["outputs"] = f"""
        SELECT o_orderkey AS query_id, ln AS seq,
          CASE l_suppkey % 6 WHEN 0 THEN 'load_table' WHEN 1 THEN 'create_table'
            WHEN 2 THEN 'other' ELSE 'load_file' END AS kind,
          CASE WHEN l_suppkey % 6 = 1 AND l_partkey % 2 = 0 THEN 'db' || {num('l_partkey % 9')} END
            AS db,
          'target' || {num('l_partkey % 30')} AS target
        FROM $lines JOIN $orders ON l_orderkey = o_orderkey"""
    v["exceptions"] = f"""
        SELECT l_orderkey AS query_id, cast(0 as int) AS chain_no, ln AS frame_no,
          'IOException' AS class, 'io.IOException: lost ' || {num('l_orderkey')} AS text,
          'lost ' || {num('l_orderkey')} AS message,
          'pkg.Reader.read' || {num('l_linenumber')} || ':Reader.java:' || {num('l_suppkey')} AS frame
        FROM $lines WHERE l_orderkey % 5 = 0
        UNION ALL SELECT l_orderkey, 1, ln, 'Timeout', 'net.Timeout: slow', 'slow',
          'pkg.Net.wait:Net.java:' || {num('l_partkey')}
        FROM $lines WHERE l_orderkey % 10 = 0
        UNION ALL SELECT l_orderkey, 2, ln, 'Closed', 'io.Closed', NULL, 'pkg.Pool.take:Pool.java:7'
        FROM $lines WHERE l_orderkey % 15 = 0
        UNION ALL SELECT l_orderkey, 3, 1, 'Root', NULL, 'no frames', NULL
        FROM $lines WHERE l_orderkey % 20 = 0 AND ln = 1"""

    # --- table descriptions and lineage --------------------------------------------------
    v["table_columns"] = f"""
        SELECT 'db_' || lower(c_mktsegment) AS db, 't' || {num('c_custkey')} AS table_name,
          t.col || {num('c_custkey % 3')} AS column_name, t.role AS role, t.pos AS pos,
          cast((t.pos + c_custkey) % 2 as int) AS sort_order,
          CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE cast(c_nationkey as int) END AS num_buckets,
          CASE WHEN c_custkey % 5 <> 0 THEN '/warehouse/t' || {num('c_custkey')} END AS path
        FROM $customer JOIN (VALUES (0, 'a', 'data', 0), (0, 'b', 'data', 1), (0, 'ds', 'partition', 0),
            (0, 'hr', 'partition', 1), (0, 'a', 'bucket', 0), (0, 'b', 'sort', 1), (0, 'a', 'sort', 0),
            (1, 'x', 'data', 0), (1, 'ds', 'partition', 0))
          AS t(shape, col, role, pos) ON c_custkey % 2 = t.shape"""
    v["lineage_edges"] = f"""
        SELECT l_orderkey AS query_id, 'target' || {num('l_suppkey % 4')} AS target_table,
          CASE WHEN l_suppkey % 3 = 0 THEN 'ds=' || {num('l_suppkey % 2')} || ',hr=1' END
            AS partition_spec,
          'col' || {num('l_partkey % 3')} AS target_col,
          CASE (l_suppkey + l_partkey % 3) % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'EXPRESSION'
            ELSE 'SCRIPT' END AS dep_type,
          ln AS base_pos, 'src' || {num('l_linenumber')} AS src_table,
          CASE WHEN l_suppkey % 5 > 0 THEN 'a' || {num('l_linenumber')} END AS src_alias, 'c' || {num('l_partkey')} AS src_col,
          'string' AS src_type, CASE WHEN l_partkey % 4 > 0 THEN 'note ' || l_returnflag END AS comment
        FROM $lines"""

    # --- record directories --------------------------------------------------------------
    v["query_files"] = f"""
        SELECT 'top' || {num('o_custkey % 20')} AS top, s.state AS state,
          'query_' || {num('o_orderkey')} AS query_id,
          CASE o_orderkey % 3 WHEN 0 THEN 'HiveQueryInfo.json' WHEN 1 THEN 'HiveQueryInfoPre.json'
            ELSE CASE s.state WHEN 'completed' THEN '_logs' ELSE 'HiveQueryInfo.json' END END AS file,
          'record ' || {num('o_orderkey')} || s.state AS record
        FROM $orders JOIN (VALUES ('F', 'executing'), ('F', 'completed'), ('O', 'executing'),
            ('P', 'completed'), ('P', 'analyzed'), ('P', 'archived')) AS s(status, state)
          ON o_orderstatus = s.status
        UNION ALL SELECT 'top' || {num('o_custkey % 20')}, 'executing',
          'query_' || {num('o_orderkey')}, 'HiveQueryInfoPre.json',
          'preliminary ' || {num('o_orderkey')}
        FROM $orders WHERE o_orderkey % 2 = 0"""
    doc = _json(
        d,
        [("queryId", "('\"q' || " + num("query_id") + " || '\"')"),
         ("queryString", _q("'SELECT ' || " + num("query_id"))),
         ("startTime", num("min(query_start)")),
         ("endTime", "CASE WHEN query_id % 3 <> 0 THEN " + num("max(query_end)") + " END"),
         ("version", "'\"1.0\"'"),
         ("hiveStageInfos", "('[' || " + d.agg_text(
             "'{\"stageId\":\"' || stage_id || '\",\"stageType\":\"' || stage_type || '\"'"
             " || coalesce(',\"hadoopJobId\":\"' || job_id || '\"', '')"
             " || ',\"dependentChildren\":[\"x\",\"y\"],\"hiveTaskInfos\":[{\"taskId\":\"'"
             " || stage_id || 'MAP\"}]}'", "stage_no") + " || ']')")],
    )
    v["query_docs"] = f"""
        SELECT query_id AS doc_id, {doc} AS doc FROM $stages GROUP BY query_id
        UNION ALL SELECT -1 - o_orderkey, '{{"queryId": ' FROM $orders WHERE o_orderkey % 50 = 0"""

    v["orders_as_queries"] = f"""
        SELECT o_orderkey AS query_id, 'SELECT ' || {num('o_custkey')} AS query_string,
          {BASE_MS} + o_orderkey * 1000000 AS start_time,
          CASE WHEN o_orderkey % 4 <> 0 THEN {BASE_MS} + o_orderkey * 1000000 + 900000 END
            AS end_time, '1.0' AS version
        FROM $orders"""
    v["run_stages"] = f"""
        SELECT run, query AS stage, q_start - 900 + l_partkey % 2500 AS completionTime
        FROM $run_queries"""

    # --- event-log lines -----------------------------------------------------------------
    v["spark_jobs"] = f"""
        SELECT 'app' || {num('o_custkey % 40')} AS app, cast(o_orderkey as int) AS jobId,
          {BASE_MS} + o_orderkey * 1000 AS startTime, o_custkey % 200 AS s1,
          (o_custkey * 7) % 200 AS s2, 200 + o_custkey % 9 AS s3
        FROM $orders"""
    v["spark_stages"] = f"""
        SELECT 'app' || {num('l_suppkey % 40')} AS app, cast(l_partkey % 210 as int) AS stageId,
          'stage at ' || {num('l_partkey')} AS name, cast(l_linenumber as int) AS numTasks,
          CASE WHEN l_linenumber <> 4 THEN {BASE_MS} + l_orderkey * 1000 + ln * 10 END
            AS submissionTime,
          {BASE_MS} + l_orderkey * 1000 + ln * 10 + 5 AS completionTime
        FROM $lines"""
    v["event_lines"] = f"""
        SELECT app, '{{"Event":"SparkListenerJobStart","Job ID":' || {num('jobId')}
          || ',"Submission Time":' || {num('startTime')} || ',"Stage IDs":[' || {num('s1')} || ','
          || {num('s2')} || ',' || {num('s3')} || '],"Properties":{{}}}}' AS line FROM $spark_jobs
        UNION ALL SELECT app, '{{"Event":"SparkListenerStageCompleted","Stage Info":{{"Stage ID":'
          || {num('stageId')} || ',"Stage Name":"' || name || '","Number of Tasks":'
          || {num('numTasks')} || coalesce(',"Submission Time":' || {num('submissionTime')}, '')
          || ',"Completion Time":' || {num('completionTime')} || '}}}}' FROM $spark_stages
        UNION ALL SELECT app, '{{"Event":"SparkListenerTaskEnd","Stage ID":1}}' FROM $spark_jobs"""

    # --- directory listing ---------------------------------------------------------------
    minutes = "(o_orderkey * 37) % 1440"
    v["du_lines"] = f"""
        SELECT CASE
          WHEN o_orderkey % 101 = 0 THEN 'Found ' || {num('o_custkey')} || ' items'
          WHEN o_orderkey % 103 = 0 THEN 'du: no such file ' || {num('o_custkey')}
          WHEN o_orderkey % 107 = 0 THEN {num('o_custkey')} || ' /base/analyzed/not_a_log'
          ELSE {num('cast(floor(o_totalprice) as bigint) * CASE WHEN o_orderkey % 29 = 0 THEN 9 ELSE 1 END')}
            || CASE WHEN o_orderkey % 2 = 0 THEN ' hdfs://10.0.0.1:9000' ELSE '   ' END
            || '/base/analyzed/user' || {num('o_custkey % 30')} || '_'
            || {d.stamp(d.plus_minutes('o_orderdate', minutes))} || '_' || {num('o_orderkey')}
          END AS line
        FROM $orders"""
    return v


SPARK = Dialect(spark=True)
DUCK = Dialect(spark=False)
SPARK_VIEWS = _views(SPARK)
DUCK_VIEWS = _views(DUCK)


def with_views(
    views: dict[str, str], table: Callable[[str], str], body: str, materialized: bool = False
) -> str:
    """``body`` as one statement, every view it needs (directly or not) as a common table."""
    done: dict[str, str] = {}

    def resolve(text: str) -> str:
        def name(m: re.Match) -> str:
            n = m.group(1)
            if n in BASE_TABLES:
                return table(n)
            if n not in done:
                done[n] = resolve(views[n])
            return "v_" + n

        return re.sub(r"\$(\w+)", name, text)

    main = resolve(body)
    if not done:
        return main
    kept = "AS MATERIALIZED" if materialized else "AS"
    ctes = ", ".join(f"v_{n} {kept} ({t})" for n, t in done.items())
    stripped = main.lstrip()
    if stripped[:5].upper() == "WITH " and stripped[5:14].upper() != "RECURSIVE":
        return f"WITH {ctes}, {stripped[5:]}"
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {stripped[14:]}"
    return f"WITH {ctes} {main}"


#: Folders of views that have been written once, by table folder and name (see ``land``).
LANDED: dict[tuple[str, str], str] = {}


def _spark_table(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Name of a temporary view over a given table."""
    name = f"wtel_{table}_{zlib.crc32(sf_dir.encode())}"
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df.createOrReplaceTempView(name)
    return name


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a Spark DataFrame over the tables in ``sf_dir``."""
    if (sf_dir, name) in LANDED:
        return spark.read.parquet(LANDED[sf_dir, name])
    tables: dict[str, str] = {}

    def table(t: str) -> str:
        if t not in tables:
            tables[t] = _spark_table(spark, sf_dir, t)
        return tables[t]

    return spark.sql(with_views(SPARK_VIEWS, table, f"SELECT * FROM ${name}"))


def land(spark: SparkSession, sf_dir: str, name: str, folder: str) -> None:
    """Write a view once; from then on ``view`` reads it, as a collector's landed files are read."""
    path = f"{folder}/{name}"
    view(spark, sf_dir, name).write.parquet(path)
    LANDED[sf_dir, name] = path


def duck(body: str) -> str:
    """An oracle statement with the views it needs."""
    return with_views(DUCK_VIEWS, lambda t: t, body, materialized=True)
