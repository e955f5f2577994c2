"""Oracle statements for snapshots, change capture, packets and the query log."""

from __future__ import annotations

from wtel import schemas
from wtel.fixtures.views import duck

CLUSTER = schemas.names(schemas.CLUSTER)
APP = schemas.names(schemas.APP)


def _c(f: str) -> str:
    return f'"{f}"'


def _long(view: str, ids: str, fields: list[str], where: str = "") -> str:
    """Union of one select per field; null as the text null."""
    return " UNION ALL ".join(
        f"SELECT {ids}, '{f}' AS MetricsName, record_time AS RecordTime,"
        f" coalesce(cast({_c(f)} as varchar), 'null') AS Value FROM {view} {where}"
        for f in fields
    )


def _prev(view: str, keys: str) -> str:
    """Each row with the row of the same key one poll before."""
    on = " AND ".join(f"n.{k} = o.{k}" for k in keys.split())
    return f"FROM {view} n LEFT JOIN {view} o ON {on + ' AND ' if on else ''}o.poll_no = n.poll_no - 1"


QUEUE_COMPARED = (
    "capacity usedCapacity numApplications usedResources state numActiveApplications numContainers"
    " maxApplications memory vCores"
).split()
CONTAINER_COMPARED = "state nodeId user diagnostics totalMemoryNeededMB totalVCoresNeeded".split()
NEW_CONTAINER = "nodeId totalMemoryNeededMB totalVCoresNeeded state user".split()


def _fields(alias: str, names: list[str], view: str, ids: str) -> str:
    return f"SELECT {ids}, {', '.join(_c(f) for f in names)} FROM {view}"


def _app_changes() -> str:
    compared = [f for f in APP if f not in ("elapsedTime", "id")]
    differs = {f: f"(n.{_c(f)} IS NOT NULL AND n.{_c(f)} IS DISTINCT FROM o.{_c(f)})" for f in compared}
    some = " OR ".join(differs.values())
    src = _prev("$apps_flat", "id")
    new = [
        f"SELECT n.id AS AppId, '{f}' AS MetricsName, n.record_time AS RecordTime,"
        f" coalesce(cast(n.{_c(f)} as varchar), 'null') AS Value {src} WHERE o.id IS NULL"
        for f in APP
    ]
    old = [
        f"SELECT n.id, '{f}', n.record_time, cast(n.{_c(f)} as varchar) {src}"
        f" WHERE o.id IS NOT NULL AND {differs[f]}"
        for f in compared
    ]
    elapsed = (
        f"SELECT n.id, 'elapsedTime', n.record_time, cast(n.elapsedTime as varchar) {src}"
        f" WHERE o.id IS NOT NULL AND ({some})"
    )
    return " UNION ALL ".join([*new, *old, elapsed])


def _changed(view: str, keys: str, fields: list[str], ids: str, names: dict[str, str]) -> str:
    src = _prev(view, keys)
    return " UNION ALL ".join(
        f"SELECT {ids + ', ' if ids else ''}'{names.get(f, f)}' AS MetricsName,"
        f" n.record_time AS RecordTime, cast(n.{_c(f)} as varchar) AS Value {src}"
        f" WHERE n.{_c(f)} <> o.{_c(f)}"
        for f in fields
    )


# Applications that were not finished at the first poll, up to their first FINISHED poll.
LIVE = """
    live AS (
      SELECT a.* FROM $node_apps_flat a LEFT JOIN (
        SELECT id, min(poll_no) AS fin FROM $node_apps_flat WHERE state = 'FINISHED' GROUP BY id) f
        USING (id)
      WHERE fin IS NULL
        OR (fin > (SELECT min(poll_no) FROM $node_apps_flat) AND poll_no <= fin))"""

_APP_IDS = "n.node AS nodeAddress, n.id AS appId"


def _delta(view: str, extra: str = "") -> str:
    """New container ids of an application present in the previous poll."""
    return f"""
        SELECT nodeAddress, appId, 'containerId' AS MetricsName, RecordTime, c AS Value FROM (
          SELECT {_APP_IDS}, n.record_time AS RecordTime,
            string_split(o.containers, ',') AS old, unnest(string_split(n.containers, ',')) AS c,
            len(string_split(n.containers, ',')) AS size
          {_prev(view, 'node id')} WHERE o.id IS NOT NULL AND n.containers IS NOT NULL {extra}) x
        WHERE old IS NULL OR len(old) <> size OR NOT list_contains(old, c)"""


def _in_full(source: str, where: str) -> str:
    return f"""
        SELECT {_APP_IDS}, 'state' AS MetricsName, n.record_time AS RecordTime, n.state AS Value
        {source} {where}
        UNION ALL SELECT n.node, n.id, 'user', n.record_time, n."user" {source} {where}
        UNION ALL SELECT n.node, n.id, 'containerId', n.record_time,
          unnest(string_split(n.containers, ',')) {source}
          {where + ' AND' if where else 'WHERE'} n.containers IS NOT NULL"""


_CONTAINER_IDS = "n.node AS nodeAddress, n.id AS containerId"


def _container_in_full(source: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_CONTAINER_IDS}, '{f}' AS MetricsName, n.record_time AS RecordTime,"
        f" cast(n.{_c(f)} as varchar) AS Value {source} {where}"
        for f in NEW_CONTAINER
    )


_PACKET = """
    parsed AS (
      SELECT seq, ts, right(line, 1) AS kind,
        string_split(left(substr(line, 11), greatest(length(line) - 12, 0)), ':') AS part
      FROM $packets),
    good AS (
      SELECT seq, ts, part[1] AS name, try_cast(part[2] as integer) AS value, kind FROM parsed
      WHERE kind IN ('c', 'g') AND try_cast(part[2] as integer) IS NOT NULL)"""

_CLASS = """
    classed AS (
      SELECT *, CASE WHEN query_string NOT ILIKE '%select%' THEN 'ddl'
        WHEN regexp_matches(lower(query_string), '^\\n{0,2}explain') THEN 'explain'
        WHEN query_string ILIKE '%impressions%' OR query_string ILIKE '%rtbids%'
          OR query_string ILIKE '%actions%' THEN 'retrieval'
        ELSE 'ignored' END AS class
      FROM $query_log)"""

_LAST = """
    values_now AS (
      SELECT 'counts' AS table_name, name AS tag, cast(sum(value) as bigint) AS value
      FROM good WHERE kind = 'c' GROUP BY name
      UNION ALL SELECT 'gauges', name, cast(arg_max(value, seq) as bigint)
      FROM good WHERE kind = 'g' GROUP BY name)"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src1_read_cluster_metrics"] = "SELECT * FROM $cluster_flat"
    q["src2_read_apps"] = "SELECT * REPLACE (cast(progress as float) AS progress) FROM $apps_flat"
    q["src3_read_queues"] = """
        SELECT poll_no, record_time, queueName, state, usedResources,
          cast(capacity as float) AS capacity, cast(usedCapacity as float) AS usedCapacity,
          numApplications, numActiveApplications, numContainers, maxApplications,
          memory AS used_memory, CASE WHEN memory IS NOT NULL THEN vCores END AS used_vcores
        FROM $queues_flat"""
    q["src4_read_nodes"] = """
        SELECT DISTINCT p AS poll_no, 1704067200000 + p * 500 AS record_time,
          node AS nodeHTTPAddress FROM $node_events"""
    q["src5_read_node_apps"] = """
        SELECT poll_no, record_time, node, id, "user" AS user_name, state, containers
        FROM $node_apps_flat"""
    q["src6_read_containers"] = """
        SELECT poll_no, node, id, state, nodeId, containerLogsLink, "user" AS user_name, exitCode,
          diagnostics, totalMemoryNeededMB, totalVCoresNeeded FROM $containers_flat"""
    q["src7_scan_query_log"] = """
        SELECT query_id, query_string FROM $query_log
        WHERE start_time >= TIMESTAMP '1997-01-01' AND start_time <= TIMESTAMP '1998-12-31'
          AND query_string <> 'use default'"""
    q["src8_parse_statsd"] = f"WITH {_PACKET} SELECT * FROM good"
    q["snk3_append_metric"] = """
        SELECT node AS nodeAddress, id AS containerId, 'diagnostics' AS MetricsName,
          record_time AS RecordTime, repeat(id || ';', 20) AS Value FROM $containers_flat"""
    q["snk4_upsert_tags"] = f"""
        WITH {_PACKET}, {_LAST}
        SELECT table_name, tag, cast(coalesce(value, -1) as varchar) AS value
        FROM $registry LEFT JOIN values_now USING (table_name, tag)"""
    q["prj1_to_long_metrics"] = _long("$apps_flat", "id AS AppId", APP)
    q["prj2_selected_app_metrics"] = _in_full("FROM $node_apps_flat n", "")
    q["prj2_selected_container_metrics"] = _container_in_full("FROM $containers_flat n", "")
    q["flt1_classify_query"] = f"WITH {_CLASS} SELECT query_id, class FROM classed"
    q["flt2_explain_rewrite"] = f"""
        WITH {_CLASS} SELECT query_id, 'EXPLAIN ' || query_string AS query_string
        FROM classed WHERE class = 'retrieval'"""
    q["flt6_suppress_finished"] = (
        f"WITH {LIVE} SELECT poll_no, node, id, state FROM live"
    )
    q["jn6_container_delta"] = _delta("$node_apps_flat")
    q["jn7_registry_values"] = f"""
        WITH {_PACKET}, {_LAST}
        SELECT table_name, tag, coalesce(value, -1) AS value
        FROM $registry LEFT JOIN values_now USING (table_name, tag)"""
    q["agg1_counter_totals"] = f"""
        WITH {_PACKET} SELECT name, cast(sum(value) as bigint) AS value
        FROM good WHERE kind = 'c' GROUP BY name"""
    q["agg1_counter_totals_first_counts_one"] = f"""
        WITH {_PACKET}, numbered AS (
          SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY seq) AS rn
          FROM good WHERE kind = 'c')
        SELECT name, cast(sum(CASE WHEN rn = 1 THEN 1 ELSE value END) as bigint) AS value
        FROM numbered GROUP BY name"""
    q["agg2_gauge_latest"] = f"""
        WITH {_PACKET}, numbered AS (
          SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rn
          FROM good WHERE kind = 'g')
        SELECT name, cast(value as bigint) AS value FROM numbered WHERE rn = 1"""
    q["agg3_scheduler_totals"] = """
        SELECT record_time AS RecordTime, cast(sum(numContainers) as bigint) AS totalContainers,
          cast(sum(numActiveApplications) as bigint) AS totalActiveApplications,
          cast(sum(numApplications) as bigint) AS totalApplications,
          cast(sum(maxApplications) as bigint) AS maxApplications
        FROM $queues_flat GROUP BY record_time"""
    q["agg4_class_counts"] = f"""
        WITH {_CLASS} SELECT class, count(*) AS n FROM classed WHERE class <> 'ignored'
        GROUP BY class"""
    q["sem1_queries"] = """
        SELECT query_id, 100 + row_number() OVER (ORDER BY start_time, query_id) AS queryId,
          query_string AS queryString FROM $query_log"""
    q["win4_cluster_changes"] = _changed("$cluster_flat", "", CLUSTER, "", {})
    q["win5_app_changes"] = _app_changes()
    queues = "(SELECT * REPLACE (CASE WHEN memory IS NOT NULL THEN vCores END AS vCores) FROM $queues_flat)"
    q["win6_queue_changes"] = _changed(
        queues, "queueName", QUEUE_COMPARED, "n.queueName AS QueueName",
        {"memory": "resourcesUsed_memory", "vCores": "resourcesUsed_vCores"},
    )
    full = "WHERE (o.id IS NULL OR n.state = 'FINISHED')"
    q["win7_node_app_changes"] = f"""
        WITH {LIVE} {_in_full(_prev('live', 'node id'), full)}
        UNION ALL {_delta('live', "AND n.state <> 'FINISHED'")}"""
    q["win8_container_changes"] = (
        _container_in_full(_prev("$containers_flat", "node id"), "WHERE o.id IS NULL")
        + " UNION ALL "
        + _changed("$containers_flat", "node id", CONTAINER_COMPARED, _CONTAINER_IDS, {})
    )
    return {key: duck(body) for key, body in q.items()}
