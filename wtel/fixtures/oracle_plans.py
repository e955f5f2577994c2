"""Oracle statements for plans, runs, archives and record directories."""

from __future__ import annotations

from wtel.fixtures.views import duck

# --- directory listing and archives --------------------------------------------------------------
_LINE = r"^([0-9]+)[ ]+(hdfs://)?([0-9a-z\.:]*)?/base/analyzed/([/a-zA-Z0-9_-]*)$"
_DIR = r"^([a-zA-Z0-9-]+)_([0-9]{12})([/a-fA-F0-9_-]*)$"
_LOCAL = "timezone('America/Los_Angeles', make_timestamptz({} * 1000))"


def _la(ms: str, fmt: str) -> str:
    return f"strftime({_LOCAL.format(ms)}, '{fmt}')"


def _path(first: str, last: str) -> str:
    return (
        f"{_la(first, '%Y/%m/%d')} || '/' || {_la(first, '%Y_%m_%dT%H%M')} || '-' || "
        f"{_la(last, '%Y_%m_%dT%H%M')} || '.tar.xz'"
    )


_ENTRIES = f"""
    listed AS (
      SELECT line, CASE WHEN regexp_matches(line, '{_LINE}') THEN regexp_extract(line, '{_LINE}', 4) END
        AS name FROM $du_lines WHERE line NOT LIKE 'Found %'),
    entries AS (
      SELECT name AS dirName, '/base/analyzed/' || name AS path,
        cast(regexp_extract(line, '{_LINE}', 1) AS bigint) AS size,
        epoch_ms(timezone('America/New_York',
          strptime(regexp_extract(name, '{_DIR}', 2), '%Y%m%d%H%M'))) AS timestamp,
        regexp_extract(name, '{_DIR}', 1) AS userName
      FROM listed WHERE regexp_matches(name, '{_DIR}')),
    past AS (
      SELECT *, {_la('timestamp', '%Y/%m/%d')} AS day FROM entries
      WHERE {_la('timestamp', '%Y/%m/%d')} <> (SELECT max({_la('timestamp', '%Y/%m/%d')}) FROM entries)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY day ORDER BY timestamp, path) AS i FROM past)"""

_PACKED = f"""{_ENTRIES},
    fold AS (
      SELECT day, i, path, timestamp, size, size AS filled, cast(1 as bigint) AS archive_no
      FROM placed WHERE i = 1
      UNION ALL
      SELECT p.day, p.i, p.path, p.timestamp, p.size,
        CASE WHEN f.filled + p.size < 1000000 THEN f.filled + p.size ELSE p.size END,
        CASE WHEN f.filled + p.size < 1000000 THEN f.archive_no ELSE f.archive_no + 1 END
      FROM fold f JOIN placed p ON p.day = f.day AND p.i = f.i + 1)"""
_MANIFEST = f"""{_PACKED},
    totals AS (
      SELECT day, archive_no, min(timestamp) AS first_ms, max(timestamp) AS last_ms,
        count(*) AS entry_count, cast(sum(size) as bigint) AS total_bytes FROM fold GROUP BY 1, 2),
    manifest AS (
      SELECT *, '/archive/' || {_path('first_ms', 'last_ms')} AS dest_path FROM totals)"""

# --- plans -----------------------------------------------------------------------------------------
_ALIASED = """
    known AS (
      SELECT query_id, stage_id, last_alias AS alias, arg_max(full_table, pos) AS full_table FROM (
        SELECT *, list_last(string_split(rtrim(alias, ':'), ':')) AS last_alias FROM $stage_aliases) x
      GROUP BY 1, 2, 3)"""
_SHOWN = "CASE WHEN op_type = 'MAPJOIN' AND variant LIKE '%sorted%' THEN 'SMBMAPJOIN' ELSE op_type END"
_CONST = f"""{_ALIASED},
    sides AS (
      SELECT a.query_id, a.stage_id, a.op_id, count(*) FILTER (attr = 'operand') AS n,
        max(a.kind) FILTER (attr = 'operand' AND pos = 0) AS k0,
        max(a.kind) FILTER (attr = 'operand' AND pos = 1) AS k1,
        max(value) FILTER (attr = 'operand' AND pos = 0) AS v0,
        max(value) FILTER (attr = 'operand' AND pos = 1) AS v1,
        max(alias) FILTER (attr = 'operand' AND pos = 0) AS a0,
        max(alias) FILTER (attr = 'operand' AND pos = 1) AS a1,
        max(value) FILTER (attr = 'predicate') AS expr
      FROM $op_attrs a JOIN $plan_ops o USING (query_id, stage_id, op_id)
      WHERE o.op_type = 'FILTER' GROUP BY 1, 2, 3),
    const AS (
      SELECT s.query_id, s.stage_id, op_id, CASE WHEN k1 = 'column' THEN a1 ELSE a0 END AS alias,
        CASE WHEN k1 = 'column' THEN v1 ELSE v0 END AS column_name, expr
      FROM sides s
      WHERE n = 2 AND ((k0 = 'column' AND k1 = 'constant') OR (k0 = 'constant' AND k1 = 'column')))"""

_EDGES = """
    edges AS (
      SELECT query_id, stage_id AS from_stage, unnest(children) AS to_stage, 'dependency' AS kind
      FROM $stages
      UNION ALL SELECT query_id, stage_id, unnest(backup), 'backup' FROM $stages
      UNION ALL SELECT query_id, stage_id, unnest(conditional), 'conditional' FROM $stages)"""

_OUTPUT = """
    named AS (
      SELECT query_id, arg_max(CASE WHEN kind = 'create_table'
          THEN coalesce(db, 'default') || '.' || target ELSE target END, seq) AS name
      FROM $outputs WHERE kind IN ('load_table', 'create_table') GROUP BY 1),
    filed AS (
      SELECT query_id, arg_max(target, seq) AS name FROM $outputs WHERE kind = 'load_file' GROUP BY 1),
    output AS (
      SELECT q.query_id, CASE WHEN named.name IS NOT NULL THEN 'TABLE'
          WHEN filed.name IS NOT NULL THEN 'DIRECTORY' ELSE 'FETCH' END AS output_type,
        coalesce(named.name, filed.name) AS named_output
      FROM $orders_as_queries q LEFT JOIN named USING (query_id) LEFT JOIN filed USING (query_id))"""

_FAILURE = """
    failure AS (
      SELECT query_id, stage_id AS fail_task, job_id AS fail_job, task_kind AS fail_kind,
        exit_code AS fail_code FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage_no DESC) AS rn
          FROM $stages WHERE NOT running AND exit_code <> 0) x WHERE rn = 1)"""

# Comment titles by operator type: attribute, title, place and way of showing.
_RULES = [
    ("JOIN", "cond", "condition map", 1, ""),
    ("JOIN", "filterString", "condition expressions", 2, "pos"),
    ("JOIN", "skew", "handleSkewJoin", 3, ""),
    ("JOIN", "outputCol", "outputCols", 4, ""),
    ("JOIN", "filterString", "filter predicates", 5, "pos"),
    ("JOIN", "filterMap", "filter mappings", 6, "pos"),
    ("JOIN", "nullSafe", "nullSafes", 7, ""),
    ("GROUPBY", "key", "keys", 1, ""),
    ("GROUPBY", "outputCol", "outputCols", 2, ""),
    ("GROUPBY", "aggregation", "aggregations", 3, ""),
    ("SELECT", "expr", "select", 1, "expr"),
    ("SELECT", "outputCol", "outputCols", 2, ""),
    ("TABLESCAN", "alias", "alias", 1, ""),
    ("TABLESCAN", "partitionCol", "partitionCols", 2, ""),
    ("TABLESCAN", "filterExpr", "FilterExpr", 3, ""),
    ("TABLESCAN", "rowLimit", "rowLimit", 4, "positive"),
    ("FILESINK", "dirName", "dirName", 1, ""),
    ("FILESINK", "finalDirName", "finalDirName", 2, "other"),
    ("FILESINK", "numFiles", "numFiles", 3, ""),
    ("FILESINK", "partitionCol", "partitionCols", 4, ""),
    ("REDUCESINK", "key", "key expressions", 1, ""),
    ("REDUCESINK", "value", "value expressions", 2, ""),
    ("REDUCESINK", "partitionCol", "Map-reduce partition columns", 3, ""),
    ("REDUCESINK", "outputKey", "outputKey", 4, ""),
    ("REDUCESINK", "outputCol", "outputCols", 5, ""),
    ("REDUCESINK", "numReducers", "numReducers", 6, "positive"),
]
_RULES += [("MAPJOIN", *r[1:]) for r in _RULES if r[0] == "JOIN"]
_RULES += [
    ("MAPJOIN", "mapKey", "keys", 8, "pos"),
    ("MAPJOIN", "bigTablePos", "Position of Big Table", 9, ""),
]
_RULE_VALUES = ", ".join(
    f"('{t}', '{a}', '{title}', {place}, '{show}')" for t, a, title, place, show in _RULES
)

_COMMENT = f"""
    rule AS (SELECT * FROM (VALUES {_RULE_VALUES}) r(op_type, attr, title, place, how)),
    op AS (SELECT *, query_id || '/' || op_id AS oid FROM $plan_ops),
    oat AS (SELECT *, query_id || '/' || op_id AS oid FROM $op_attrs),
    dirs AS (SELECT oid, max(value) AS dir FROM oat WHERE attr = 'dirName' GROUP BY 1),
    entry AS (
      SELECT o.oid, r.title, r.place, a.pos,
        CASE WHEN how = 'pos' THEN cast(a.pos AS varchar) || ': ' || a.value ELSE a.value END AS value
      FROM op o JOIN rule r USING (op_type) JOIN oat a ON a.oid = o.oid AND a.attr = r.attr
      LEFT JOIN dirs d ON d.oid = o.oid
      WHERE a.value <> '' AND NOT (how = 'positive' AND coalesce(try_cast(a.value AS integer), 0) <= 0)
        AND NOT (how = 'other' AND a.value = d.dir)
        AND NOT (how = 'expr' AND a.kind NOT IN ('field', 'column', 'constant', 'func'))
      UNION ALL
      SELECT oid, 'Map Join Variant', 10, 0, CASE WHEN variant LIKE '%sink%' THEN 'HashTable Sink'
        WHEN variant LIKE '%sorted%' THEN 'Sorted Merge Bucket' ELSE 'Bucket' END
      FROM op WHERE op_type = 'MAPJOIN' AND variant <> ''
      UNION ALL
      SELECT j.oid, 'joinKeys', 8, k.seq * 1000 + a.pos, a.value
      FROM op j JOIN op k ON k.query_id = j.query_id AND k.stage_id = j.stage_id AND k.seq < j.seq
      JOIN oat a ON a.oid = k.oid
      WHERE j.op_type = 'JOIN' AND k.op_type = 'REDUCESINK' AND a.attr = 'partitionCol'
        AND a.kind = 'column'
      UNION ALL
      SELECT o.oid, 'distinct', 4, 0, 'implied' FROM op o WHERE op_type = 'GROUPBY'
        AND NOT EXISTS (SELECT 1 FROM oat a WHERE a.oid = o.oid AND a.attr = 'aggregation')
      UNION ALL
      SELECT o.oid, 'distinct', 4, 1, 'explicit' FROM op o JOIN oat a ON a.oid = o.oid
      WHERE op_type = 'GROUPBY' AND a.attr = 'distinct' AND a.value = 'true'),
    line AS (
      SELECT oid, place, title || ': ' || string_agg(value, ', ' ORDER BY pos) AS line
      FROM entry GROUP BY oid, place, title),
    titled AS (SELECT oid, string_agg(line, chr(10) ORDER BY place) AS text FROM line GROUP BY oid),
    one AS (SELECT oid, attr, arg_min(value, pos) AS value,
        string_agg(' ' || value, '' ORDER BY pos) AS spaced FROM oat GROUP BY 1, 2),
    commented AS (
      SELECT o.query_id, o.stage_id, o.op_id, o.seq, {_SHOWN} AS op_type, CASE op_type
        WHEN 'EXTRACT' THEN 'extract: ' || w.value WHEN 'FILTER' THEN w.value
        WHEN 'LIMIT' THEN 'limit: ' || w.value WHEN 'SCRIPT' THEN w.value
        WHEN 'UNION' THEN 'union of ' || w.value || ' inputs' WHEN 'UDTF' THEN 'UDTF: ' || w.value
        WHEN 'LATERALVIEWJOIN' THEN 'Lateral View Join: ' || w.spaced
        WHEN 'LATERALVIEWFORWARD' THEN 'Lateral View Forward'
        WHEN 'HASHTABLESINK' THEN 'conditions: ' || w.spaced
        WHEN 'FORWARD' THEN NULL WHEN 'HASHTABLEDUMMY' THEN NULL
        ELSE coalesce(t.text, '') END AS comment
      FROM op o LEFT JOIN titled t USING (oid)
      LEFT JOIN one w ON w.oid = o.oid AND w.attr = CASE op_type WHEN 'EXTRACT' THEN 'expr'
        WHEN 'FILTER' THEN 'predicate' WHEN 'LIMIT' THEN 'limit' WHEN 'SCRIPT' THEN 'command'
        WHEN 'UNION' THEN 'inputs' WHEN 'UDTF' THEN 'name' WHEN 'LATERALVIEWJOIN' THEN 'outputCol'
        WHEN 'HASHTABLESINK' THEN 'cond' END)"""

_KEYS = f"""
    jc AS (
      SELECT query_id, stage_id, max(seq) FILTER (op_type = 'JOIN') AS common,
        arg_max({_SHOWN}, seq) FILTER (op_type IN ('JOIN', 'MAPJOIN')) AS join_type
      FROM $plan_ops GROUP BY 1, 2),
    place AS (
      SELECT a.query_id, a.stage_id, o.op_type, o.seq, a.pos, concat_ws('.', a.alias, a.value) AS col
      FROM $op_attrs a JOIN $plan_ops o USING (query_id, stage_id, op_id)
      WHERE a.kind = 'column' AND ((o.op_type = 'REDUCESINK' AND attr = 'partitionCol')
        OR (o.op_type = 'MAPJOIN' AND attr = 'joinExpr'))),
    keyed AS (
      SELECT jc.query_id, jc.stage_id, join_type,
        coalesce(string_agg(col, ',' ORDER BY seq, pos) FILTER (op_type = 'REDUCESINK'), '')
          AS partition_columns,
        coalesce(string_agg(col, ',' ORDER BY op_type DESC, seq, pos) FILTER (
          (op_type = 'REDUCESINK' AND common IS NOT NULL)
          OR (op_type = 'MAPJOIN' AND (common IS NULL OR seq > common))), '') AS join_keys
      FROM jc LEFT JOIN place p ON p.query_id = jc.query_id AND p.stage_id = jc.stage_id
      GROUP BY 1, 2, 3)"""

# --- runs --------------------------------------------------------------------------------------------
_IDS = """
    started AS (SELECT * FROM $lifecycle_events WHERE kind = 'started'),
    wf AS (SELECT key, row_number() OVER (ORDER BY ts, key) + {last} AS wid FROM started
      WHERE level = 'workflow'),
    co AS (SELECT s.key, wid, row_number() OVER (PARTITION BY parent ORDER BY ts, s.key) AS cid
      FROM started s JOIN wf ON wf.key = s.parent WHERE level = 'component'),
    qu AS (SELECT s.key, s.run, s.ts, wid, cid,
        row_number() OVER (PARTITION BY parent ORDER BY ts, s.key) AS qid
      FROM started s JOIN co ON co.key = s.parent WHERE level = 'query'),
    ids AS (
      SELECT 'workflow' AS level, key, wid, cast(NULL AS bigint) AS cid, cast(NULL AS bigint) AS qid
      FROM wf UNION ALL SELECT 'component', key, wid, cid, NULL FROM co
      UNION ALL SELECT 'query', key, wid, cid, qid FROM qu),
    paired AS (
      SELECT d.run, d.level, d.key, d.name, d.engine, d.user_name, s.ts AS startTime, d.ts AS endTime
      FROM (SELECT * FROM $lifecycle_events WHERE kind = 'completed') d
      ASOF LEFT JOIN started s ON d.run = s.run AND d.level = s.level AND d.ts >= s.ts)"""
_RUNS = _IDS.format(last=0)
_TABLES = _RUNS + """,
    all_rows AS (SELECT p.*, wid, cid, qid FROM paired p JOIN ids USING (level, key)),
    workflows AS (SELECT wid, name, user_name AS userName, startTime, endTime FROM all_rows
      WHERE level = 'workflow'),
    components AS (SELECT cid, wid, name, engine, startTime, endTime FROM all_rows
      WHERE level = 'component'),
    executed AS (SELECT qid, cid, wid, name AS queryString, engine, startTime, endTime FROM all_rows
      WHERE level = 'query'),
    written AS (SELECT * FROM workflows WHERE wid < (SELECT max(wid) FROM workflows))"""

_MAPRED = """
    mr AS (
      SELECT s.*, j.start_time, row_number() OVER (PARTITION BY query_id ORDER BY stage_no) AS rn
      FROM $stages s LEFT JOIN $jobs j USING (job_id) WHERE stage_type = 'MAPRED'),
    later AS (SELECT *, CASE WHEN rn > 1 THEN start_time END AS own FROM mr)"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src9_parse_du_listing"] = f"WITH {_ENTRIES} SELECT * FROM entries"
    q["src9_rejected_du_lines"] = f"""WITH {_ENTRIES}
        SELECT line FROM listed WHERE name IS NULL OR NOT regexp_matches(name, '{_DIR}')"""
    q["src10_read_query_info"] = """
        SELECT 'q' || query_id AS queryId, stage_id AS stageId, stage_type AS stageType,
          job_id AS hadoopJobId, 'x,y' AS dependentChildren, 1 AS numTasks FROM $stages"""
    q["src11_stage_completed"] = """
        SELECT app, stageId, name, numTasks, coalesce(submissionTime, 0) AS submissionTime,
          completionTime FROM $spark_stages"""
    q["src11_job_start"] = """
        SELECT app, jobId, startTime, s1 || ',' || s2 || ',' || s3 AS stageIds FROM $spark_jobs"""
    q["snk5_write_query_info"] = """
        SELECT query_id, state, top || '/' || state || '/' || query_id || '/' || file AS path, record
        FROM $query_files WHERE file LIKE 'Hive%'"""
    q["prj3_last_alias"] = """
        SELECT query_id, alias, list_last(string_split(rtrim(alias, ':'), ':')) AS last_alias
        FROM $stage_aliases"""
    q["prj4_full_table_name"] = """
        SELECT query_id, seq, coalesce(db, 'default') || '.' || target AS full_name FROM $outputs"""
    q["prj5_archive_path"] = f"""WITH {_ENTRIES}
        SELECT path, {_path('timestamp', '(timestamp + 5400000)')} AS archive_path FROM entries"""
    q["prj6_dependent_children"] = """
        SELECT query_id, stage_id, coalesce(array_to_string(children, ','), '') AS dependentChildren,
          coalesce(job_id, '') AS hadoopJobId FROM $stages"""
    q["flt3_const_filters"] = f"""WITH {_CONST}
        SELECT c.*, k.full_table FROM const c LEFT JOIN known k USING (query_id, stage_id, alias)"""
    q["flt4_mapred_stages"] = "SELECT query_id, stage_id FROM $stages WHERE stage_type = 'MAPRED'"
    q["flt5_complete_stages"] = """
        SELECT query_id, stage_id, job_id FROM $stages WHERE job_id IS NOT NULL"""
    q["flt7_exclude_today"] = f"WITH {_ENTRIES} SELECT path, day FROM past"
    q["jn1_resolve_alias"] = f"""WITH {_ALIASED}
        SELECT a.query_id, a.stage_id, op_id, attr, pos, a.alias, value, full_table
        FROM $op_attrs a LEFT JOIN known k ON k.query_id = a.query_id AND k.stage_id = a.stage_id
          AND k.alias = a.alias WHERE kind = 'column'"""
    q["jn3_stage_to_job"] = """
        WITH listed AS (
          SELECT app, startTime, jobId, unnest([s1, s2, s3]) AS stageId FROM $spark_jobs)
        SELECT s.app, s.stageId, name, numTasks, coalesce(submissionTime, 0) AS submissionTime,
          completionTime, coalesce(l.jobId, -1) AS jobId
        FROM $spark_stages s ASOF LEFT JOIN listed l
          ON s.app = l.app AND s.stageId = l.stageId AND s.completionTime >= l.startTime"""
    q["jn4_attribute_to_query"] = f"""WITH {_RUNS}
        SELECT s.run, s.stage, s.completionTime, wid, cid, qid
        FROM $run_stages s ASOF LEFT JOIN qu ON s.run = qu.run AND s.completionTime >= qu.ts"""
    q["jn5_stage_job_start"] = """
        SELECT query_id, stage_id, job_id, start_time AS job_start
        FROM $stages LEFT JOIN $jobs USING (job_id)"""
    q["jn8_root_stages"] = f"""WITH {_EDGES}
        SELECT query_id, stage_id FROM $stages s WHERE NOT EXISTS (SELECT 1 FROM edges e
          WHERE e.kind = 'dependency' AND e.query_id = s.query_id AND e.to_stage = s.stage_id)"""
    q["jn9_stage_edges"] = f"WITH {_EDGES} SELECT * FROM edges"
    q["jn10_reachable_stages"] = f"""WITH RECURSIVE {_EDGES},
        reach AS (
          SELECT query_id, stage_id FROM $stages s WHERE NOT EXISTS (SELECT 1 FROM edges e
            WHERE e.kind = 'dependency' AND e.query_id = s.query_id AND e.to_stage = s.stage_id)
          UNION SELECT e.query_id, e.to_stage FROM reach r JOIN edges e
            ON e.query_id = r.query_id AND e.from_stage = r.stage_id)
        SELECT r.* FROM reach r SEMI JOIN $stages s USING (query_id, stage_id)"""
    q["agg5_last_ids"] = f"""WITH {_TABLES}
        SELECT 'workflow' AS level, cast(NULL AS bigint) AS wid, cast(NULL AS bigint) AS cid,
          coalesce(max(wid), 0) AS last_id FROM written
        UNION ALL SELECT 'component', wid, NULL, max(cid) FROM components GROUP BY wid
        UNION ALL SELECT 'query', wid, cid, max(qid) FROM executed GROUP BY wid, cid"""
    q["agg6_current_query_id"] = f"""WITH {_TABLES},
        w AS (SELECT coalesce(max(wid), 0) + 1 AS wid FROM written),
        c AS (SELECT coalesce(max(cid), 0) + 1 AS cid FROM components WHERE wid = (SELECT wid FROM w)),
        x AS (SELECT coalesce(max(qid), 0) + 1 AS qid FROM executed
          WHERE wid = (SELECT wid FROM w) AND cid = (SELECT cid FROM c))
        SELECT wid, cid, qid FROM w, c, x"""
    q["agg7_stages_with_common_join"] = """
        SELECT DISTINCT query_id, stage_id FROM $plan_ops
        WHERE parent_op_id IS NULL AND op_type = 'JOIN'"""
    q["agg8_stages_with_map_join"] = """
        SELECT DISTINCT query_id, stage_id FROM $plan_ops
        WHERE task_type = 'MAP' AND op_type = 'MAPJOIN' AND variant NOT LIKE '%sorted%'"""
    q["agg9_stages_with_map_aggregation"] = """
        SELECT DISTINCT query_id, stage_id FROM $plan_ops
        WHERE task_type = 'MAP' AND op_type = 'GROUPBY'"""

    def role(name: str, value: str) -> str:
        return f"coalesce(string_agg({value}, ',' ORDER BY pos) FILTER (role = '{name}'), '')"

    q["agg10_table_profile"] = f"""
        SELECT db || '.' || table_name AS full_name, db, table_name,
          {role('bucket', 'column_name')} AS bucket_cols, max(num_buckets) AS num_buckets,
          {role('partition', 'column_name')} AS partition_cols,
          {role('sort', 'column_name')} AS sort_cols,
          {role('sort', "CASE WHEN sort_order = 1 THEN 'ASC' ELSE 'DSC' END")} AS sort_props,
          max(path) AS path
        FROM $table_columns GROUP BY db, table_name"""
    q["agg11_stage_keys"] = f"WITH {_KEYS} SELECT * FROM keyed"
    q["agg12_named_output"] = f"WITH {_OUTPUT} SELECT * FROM output"
    q["agg13_failure_summary"] = f"WITH {_FAILURE} SELECT * FROM failure"
    q["agg14_error_chain"] = """
        WITH lines AS (
          SELECT query_id, chain_no, frame_no, frame AS line FROM $exceptions WHERE frame IS NOT NULL
          UNION ALL SELECT DISTINCT query_id, chain_no, 0,
            'Caused By: ' || coalesce(class, 'null') || ', ' || coalesce(text, 'null')
              || ' (' || coalesce(message, 'null') || ')' FROM $exceptions)
        SELECT query_id, string_agg(line, chr(10) ORDER BY chain_no, frame_no) AS stack
        FROM lines GROUP BY query_id"""
    q["agg15_labelled_comment"] = """
        WITH titles AS (
          SELECT query_id, stage_id, op_id, attr, min(pos) AS first_pos,
            attr || ': ' || string_agg(value, ', ' ORDER BY pos) AS line
          FROM $op_attrs WHERE value <> '' GROUP BY 1, 2, 3, 4)
        SELECT query_id, stage_id, op_id,
          string_agg(line, chr(10) ORDER BY first_pos, attr COLLATE C) AS comment
        FROM titles GROUP BY 1, 2, 3"""
    q["agg15_labelled_comment"] = q["agg15_labelled_comment"].replace(" COLLATE C", "")
    q["agg16_log_dir_valid"] = """
        SELECT top, bool_or(state = 'completed'
          AND file IN ('HiveQueryInfo.json', 'HiveQueryInfoPre.json')) AS valid
        FROM $query_files GROUP BY top"""
    rank = "list_position(['executing', 'completed', 'analyzed', 'archived'], state)"
    q["agg17_query_state"] = f"""
        SELECT top, query_id, arg_max(state, {rank}) AS state FROM $query_files GROUP BY 1, 2"""
    q["agg18_lineage_report"] = """
        WITH targets AS (
          SELECT query_id, target_table, partition_spec, target_col, max(dep_type) AS dep,
            string_agg('(' || src_table || ')' || coalesce(src_alias, 'null') || '.' || src_col || ' '
              || src_type || ' ' || coalesce(comment, 'null'), ', ' ORDER BY base_pos) AS sources
          FROM $lineage_edges GROUP BY 1, 2, 3, 4)
        SELECT query_id, 'Lineage: ' || string_agg(target_table
            || coalesce(' PARTITION(' || partition_spec || ')', '') || '.' || target_col || ' ' || dep
            || ' [' || sources || ']', chr(10)
          ORDER BY target_table, partition_spec NULLS FIRST, target_col) AS details
        FROM targets GROUP BY query_id"""
    q["win1_assign_ids"] = f"WITH {_IDS.format(last=7)} SELECT * FROM ids"
    q["win2_pair_events"] = f"WITH {_RUNS} SELECT * FROM paired"
    q["win3_stage_end_times"] = f"""WITH {_MAPRED}
        SELECT query_id, stage_id AS stageId, coalesce(job_id, '') AS hadoopJobId,
          coalesce(array_to_string(children, ','), '') AS dependentChildren,
          coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY rn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), query_start) AS startTime,
          coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY rn
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), query_end) AS endTime
        FROM later"""
    q["tbl_workflows"] = f"WITH {_TABLES} SELECT * FROM workflows"
    q["tbl_components"] = f"WITH {_TABLES} SELECT * FROM components"
    q["tbl_executed_queries"] = f"WITH {_TABLES} SELECT * FROM executed"
    q["tbl_spark_stages"] = f"""WITH {_RUNS},
        listed AS (
          SELECT app, startTime, jobId, unnest([s1, s2, s3]) AS stageId FROM $spark_jobs),
        found AS (
          SELECT s.*, cast(substr(s.app, 4) AS bigint) AS run, coalesce(l.jobId, -1) AS jobId
          FROM $spark_stages s ASOF LEFT JOIN listed l
            ON s.app = l.app AND s.stageId = l.stageId AND s.completionTime >= l.startTime)
        SELECT qid, cid, wid, stageId, jobId, name, numTasks, coalesce(submissionTime, 0) AS submissionTime,
          completionTime
        FROM found f ASOF LEFT JOIN qu ON f.run = qu.run AND f.completionTime >= qu.ts"""
    q["tbl_hive_stages"] = f"""WITH {_RUNS}, timed AS ({q["win3_stage_end_times"]})
        SELECT qid, cid, wid, stageId, hadoopJobId, dependentChildren, '' AS hiveTaskInfos, startTime, endTime
        FROM timed JOIN qu ON qu.key % 100 = 1 AND qu.key // 100 = timed.query_id"""
    q["arc1_sort_logsets"] = f"WITH {_ENTRIES} SELECT * FROM entries ORDER BY timestamp, path"
    q["arc2_pack_archives"] = f"WITH RECURSIVE {_PACKED} SELECT path, day, archive_no FROM fold"
    q["arc2_pack_archives_by_joins"] = q["arc2_pack_archives"]
    q["arc3_archive_manifest"] = f"WITH RECURSIVE {_MANIFEST} SELECT * FROM manifest"
    q["arc4_already_archived"] = f"""WITH RECURSIVE {_MANIFEST}
        SELECT day, archive_no, dest_path, dest_path IN (
          SELECT dest_path FROM manifest WHERE entry_count % 2 = 0) AS archived FROM manifest"""
    q["arc5_archive_report"] = f"""WITH RECURSIVE {_MANIFEST},
        done AS (SELECT *, total_bytes // (entry_count + 2) + 1 AS compressed_bytes,
          entry_count * 700 AS millis FROM manifest)
        SELECT dest_path,
          round(cast(cast(total_bytes AS float) / cast(compressed_bytes AS float) AS double), 3)
            AS compress_ratio,
          round(CASE WHEN millis >= 1000
            THEN ((total_bytes // 1024) // (millis // 1000)) / 1024 END, 3) AS mb_per_sec,
          CASE WHEN total_bytes >= 1073741824 THEN total_bytes // 1073741824
            WHEN total_bytes >= 1048576 THEN total_bytes // 1048576 ELSE total_bytes // 1024 END
            AS size_shown,
          CASE WHEN total_bytes >= 1073741824 THEN 'GB' WHEN total_bytes >= 1048576 THEN 'MB'
            ELSE 'KB' END AS unit
        FROM done"""
    q["pln1_plan_nodes"] = f"""
        WITH tasks AS (
          SELECT DISTINCT query_id, stage_id, task_type FROM (
            SELECT query_id, stage_id, unnest(['MAP', 'REDUCE']) AS task_type FROM $plan_ops) x)
        SELECT t.query_id, t.stage_id, t.stage_id || t.task_type AS task_id, t.task_type, op_id,
          parent_op_id, {_SHOWN} AS op_type
        FROM tasks t LEFT JOIN $plan_ops o USING (query_id, stage_id, task_type)"""
    q["pln2_operator_comment"] = f"WITH {_COMMENT} SELECT * FROM commented"
    q["pln3_query_profile"] = f"""
        WITH {_COMMENT}, {_KEYS}, {_CONST}, {_EDGES}, {_OUTPUT}, {_FAILURE},
        st AS (SELECT query_id, count(*) AS n, string_agg(join_type, ',' ORDER BY stage_id) AS joins
          FROM keyed GROUP BY 1),
        cm AS (SELECT query_id, string_agg(comment, chr(10) ORDER BY stage_id, seq) AS comments FROM commented GROUP BY 1),
        ro AS (SELECT query_id, string_agg(stage_id, ',' ORDER BY stage_id) AS roots FROM $stages s
          WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'dependency' AND e.query_id = s.query_id
            AND e.to_stage = s.stage_id) GROUP BY 1),
        sk AS ({q["agg14_error_chain"]}), li AS ({q["agg18_lineage_report"]}),
        tb AS (SELECT query_id, string_agg(DISTINCT full_table, ',' ORDER BY full_table) AS tables
          FROM $stage_aliases GROUP BY 1),
        cf AS (SELECT query_id, count(*) AS n FROM const GROUP BY 1),
        ed AS (SELECT query_id, count(*) AS n FROM edges GROUP BY 1)
        SELECT q.query_id, q.query_string, q.end_time, st.n AS n_stages, coalesce(ed.n, 0) AS n_edges,
          coalesce(cf.n, 0) AS n_const_filters, tb.tables, coalesce(st.joins, '') AS join_types,
          coalesce(comments, '') AS comments, roots, stack, details, output_type, named_output, fail_code
        FROM $orders_as_queries q LEFT JOIN st USING (query_id) LEFT JOIN cm USING (query_id)
        LEFT JOIN tb USING (query_id) LEFT JOIN cf USING (query_id) LEFT JOIN ed USING (query_id)
        LEFT JOIN output USING (query_id) LEFT JOIN failure USING (query_id)
        LEFT JOIN ro USING (query_id) LEFT JOIN sk USING (query_id) LEFT JOIN li USING (query_id)"""
    q["src10_record_operators"] = f"""
        WITH {_COMMENT} SELECT o.query_id, o.stage_id AS "stageId", o.stage_id || o.task_type AS "taskId",
          o.op_id AS "operatorId", c.op_type AS "operatorType", p.op_id AS "parentId", c.comment
        FROM $plan_ops o JOIN commented c USING (query_id, stage_id, op_id)
        LEFT JOIN $plan_ops p ON p.query_id = o.query_id AND p.stage_id = o.stage_id AND p.task_type = o.task_type
          AND p.op_id = o.parent_op_id"""
    q["src10_record_stages"] = f"""
        WITH {_KEYS}, {_CONST}, {_EDGES},
        k AS (SELECT query_id, stage_id FROM $stages UNION SELECT query_id, stage_id FROM $plan_ops),
        child AS (SELECT DISTINCT query_id, to_stage FROM edges WHERE kind = 'dependency'),
        cf AS (SELECT query_id, stage_id, count(*)::INT AS n FROM const GROUP BY 1, 2),
        tk AS (SELECT query_id, stage_id, count(DISTINCT task_type)::INT AS n FROM $plan_ops GROUP BY 1, 2)
        SELECT k.query_id, k.stage_id AS "stageId", s.stage_type AS "stageType", s.job_id AS "hadoopJobId",
          s.stage_id IS NOT NULL AND c.to_stage IS NULL AS "isRoot", join_type AS "joinType",
          array_to_string(coalesce(children, []), ',') AS "dependentChildren",
          array_to_string(coalesce(conditional, []), ',') AS "conditionalChildren",
          array_to_string(coalesce(backup, []), ',') AS "backupChildren",
          coalesce(tk.n, 0) AS n_tasks, coalesce(cf.n, 0) AS n_filters, coalesce(join_keys, '') AS join_keys
        FROM k LEFT JOIN $stages s USING (query_id, stage_id) LEFT JOIN keyed USING (query_id, stage_id)
        LEFT JOIN child c ON c.query_id = k.query_id AND c.to_stage = k.stage_id
        LEFT JOIN cf USING (query_id, stage_id) LEFT JOIN tk USING (query_id, stage_id)"""
    q["src10_record_queries"] = f"""
        WITH {_OUTPUT}, {_FAILURE}, sk AS ({q["agg14_error_chain"]}), li AS ({q["agg18_lineage_report"]}),
        tb AS (SELECT query_id, string_agg(DISTINCT full_table, ',' ORDER BY full_table) AS tables
          FROM $stage_aliases GROUP BY 1),
        mr AS (SELECT query_id, count(*)::INT AS n FROM $stages WHERE stage_type = 'MAPRED' GROUP BY 1)
        SELECT q.query_id, CASE WHEN end_time IS NULL THEN 'executing' ELSE 'completed' END AS state,
          q.query_string AS "queryString", q.start_time AS "startTime", q.end_time AS "endTime", coalesce(mr.n, 0) AS "numMRJobs",
          named_output AS "namedOutput", output_type AS "outputType", coalesce(fail_code, 0) AS "failRetCode", fail_task AS "failTID",
          fail_job AS "failJID", fail_kind AS "failTaskKind", stack, version, details, tables
        FROM $orders_as_queries q LEFT JOIN output USING (query_id) LEFT JOIN failure USING (query_id)
        LEFT JOIN sk USING (query_id) LEFT JOIN li USING (query_id) LEFT JOIN tb USING (query_id) LEFT JOIN mr USING (query_id)"""
    q["pln4_preferred_record"] = f"""
        SELECT top, query_id, arg_max(record, (file = 'HiveQueryInfo.json')::int * 10 + {rank}) AS record
        FROM $query_files WHERE file LIKE 'Hive%' GROUP BY 1, 2"""
    return {key: duck(body) for key, body in q.items()}
