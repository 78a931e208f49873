"""The same results as SQL on the tables, without any event log in between (DuckDB)."""

from __future__ import annotations

from eventlens.functions import scalars as S
from eventlens.operators.report import METRIC_DESCRIPTIONS, STATISTICS_METRICS
from eventlens.operators.summary import BYTE_COLUMNS, METRIC_COLUMNS, SUMMARY_COLUMNS


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def r2(expr: str) -> str:
    """Two decimals from the exact binary value, halves to even."""
    return f"CAST(printf('%.2f', {expr}) AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {r2(f'(({part})::DOUBLE / nullif({whole}, 0)::DOUBLE) * 100.0')} ELSE 0.0 END"


def when_text(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S')"


def obj(fields: dict[str, str]) -> str:
    """JSON object from expressions that give JSON text."""
    return "'{' || " + " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in fields.items()) + " || '}'"


def num(expr: str) -> str:
    return f"coalesce(({expr})::VARCHAR, 'null')"


def txt(expr: str) -> str:
    return f"coalesce(to_json(({expr})::VARCHAR)::VARCHAR, 'null')"


def fixed(expr: str, decimals: int) -> str:
    return f"coalesce(printf('%.{decimals}f', {expr}), 'null')"


#: Metrics of the plan nodes by kind, with the number of each one's accumulator.
NODE_METRICS = {
    "write": {"number of written files": 0, "written output": 1, "number of output rows": 2, "task commit time": 9},
    "agg": {"time in aggregation build": 3},
    "shuffle": {"shuffle bytes written": 4, "shuffle records written": 10, "shuffle write time": 11},
    "filter": {"number of output rows": 5},
    "read": {"number of files read": 6, "size of files read": 7, "number of output rows": 8, "metadata time": 12, "number of partitions read": 13},
    "orc": {"number of files read": 14, "size of files read": 15, "number of output rows": 16},
}
NODE_METADATA = {
    "read": """'{"Format":"' || r_class || '","Location":"InMemoryFileIndex(1 paths)[hdfs://nn/in/' || o_orderstatus || ']","PartitionFilters":"[]"}'""",
    "orc": """'{"Format":"org.apache.OrcFileFormat","Location":"InMemoryFileIndex(1 paths)[hdfs://nn/more]","PartitionFilters":"[isnotnull(p#1)]"}'""",
}


def plan_json() -> str:
    """The plan of an execution (k) as JSON text, its keys in alphabetical order."""

    def node(name: str, text: str, kind: str | None, *children: str) -> str:
        metrics = [obj({"accumulatorId": num(f"k * 20 + {n}"), "metricType": txt("'sum'"), "name": txt(f"'{m}'")})
                   for m, n in NODE_METRICS.get(kind, {}).items()]
        listed = lambda items: "'[' || " + "".join(f"{x} || ',' || " for x in items[:-1]) + "".join(f"{x} || " for x in items[-1:]) + "']'"
        return obj({"children": listed(list(children)), "metadata": NODE_METADATA.get(kind, "'{}'"), "metrics": listed(metrics),
                    "nodeName": txt(f"'{name}'"), "simpleString": txt(text)})

    scan = node("Scan parquet ", "'FileScan parquet'", "read")
    plan = f"(CASE WHEN two THEN {node('Union', quoted('Union'), None, scan, node('Scan orc ', quoted('FileScan orc'), 'orc'))} ELSE {scan} END)"
    for name, text, kind in (
        ("Filter", "'Filter (o_totalprice#3 > 100.0)'", "filter"), ("Project", "'Project [o_orderkey#1, o_orderstatus#2]'", None),
        ("Coalesce", "'Coalesce 4'", None),
        ("Exchange", "'Exchange hashpartitioning(o_orderstatus#1, ' || (k % 7 + 1) || '), ENSURE_REQUIREMENTS, [plan_id=1]'", "shuffle"),
        ("HashAggregate", "'HashAggregate(keys=[o_orderstatus#1], functions=[])'", "agg"),
        ("WholeStageCodegen (2)", "'WholeStageCodegen (2)'", None), ("AdaptiveSparkPlan", "'AdaptiveSparkPlan isFinalPlan=false'", None),
        ("Execute InsertIntoHadoopFsRelationCommand",
         "'Execute InsertIntoHadoopFsRelationCommand hdfs://nn/out/' || o_orderpriority || ', false, ' || w_format || ', [path=x], ' || w_mode || ', [c]'", "write"),
    ):
        plan = node(name, text, kind, plan)
    return plan


# --- the application log -----------------------------------------------------------------------------------------

APPLICATION = f"""
o AS (SELECT 'application_' || o_custkey AS app_key, *, epoch_us(o_orderdate) // 1000 AS start_ms FROM orders),
t0 AS (SELECT o.app_key, o.o_orderkey, o.start_ms, l_orderkey * 10 + l_linenumber AS stage_id, l_linenumber,
    {big('l_quantity')} AS q, l_partkey, l_suppkey, l_returnflag AS flag, l_linestatus AS status,
    start_ms + l_linenumber * 60000 AS launch_ms, start_ms + l_linenumber * 60000 + {big('l_quantity')} * 1000 AS finish_ms,
    NOT (l_returnflag = 'A' AND l_suppkey % 5 = 0) AS m, {big('round(l_extendedprice * 100)')} AS price
    FROM lineitem JOIN o ON l_orderkey = o_orderkey),
t AS (SELECT *, CASE WHEN m THEN price ELSE 0 END AS input_bytes, CASE WHEN m THEN q ELSE 0 END AS input_records,
    CASE WHEN m AND status = 'F' THEN l_partkey * 1000 ELSE 0 END AS output_bytes,
    CASE WHEN m AND status = 'F' THEN q ELSE 0 END AS output_records,
    CASE WHEN m THEN l_suppkey * 1024 + l_partkey * 64 ELSE 0 END AS shuffle_read,
    CASE WHEN m THEN q * 4096 ELSE 0 END AS shuffle_write,
    CASE WHEN m AND flag = 'R' THEN q * 65536 ELSE 0 END AS spill_memory,
    CASE WHEN m AND flag = 'R' THEN q * 16384 ELSE 0 END AS spill_disk,
    CASE WHEN flag = 'R' AND status = 'O' THEN 'text' WHEN flag = 'N' AND l_linenumber = 6 THEN 'failed' ELSE 'ok' END AS outcome
    FROM t0),
st AS (SELECT app_key, stage_id, any_value(o_orderkey) AS o_orderkey, any_value(l_linenumber) AS l_linenumber,
    any_value(start_ms) AS start_ms, any_value(launch_ms) AS launch_ms,
    {big('count(*)')} AS tasks, {big('count(*) FILTER (m)')} AS measured_tasks, {big('sum(q * 1000)')} AS task_ms,
    {', '.join(f"{big(f'sum({c})')} AS {c}" for c in ('input_bytes', 'input_records', 'output_bytes', 'output_records', 'shuffle_read', 'shuffle_write', 'spill_memory', 'spill_disk'))},
    {big('max(shuffle_read)')} AS max_task_shuffle_read, {big('max(shuffle_write)')} AS max_task_shuffle_write,
    min(finish_ms) FILTER (m) AS first_ms, min(finish_ms) FILTER (spill_memory > 0) AS first_spill_memory_ms,
    min(finish_ms) FILTER (spill_disk > 0) AS first_spill_disk_ms FROM t GROUP BY app_key, stage_id),
tt AS (SELECT app_key, {', '.join(f"{big(f'sum({c})')} AS {c}" for c in ('tasks', 'task_ms', 'input_bytes', 'input_records', 'output_bytes', 'output_records', 'shuffle_read', 'shuffle_write', 'spill_memory', 'spill_disk'))},
    max(max_task_shuffle_read) AS max_task_shuffle_read, max(max_task_shuffle_write) AS max_task_shuffle_write
    FROM st GROUP BY app_key),
ms AS (SELECT app_key, {', '.join(f"max({c}) AS max_{c}, max_by(stage_id, ({c}, -first_ms, -stage_id)) AS max_{c}_stage_id" for c in ('shuffle_read', 'shuffle_write', 'spill_memory'))}
    FROM st WHERE measured_tasks > 0 GROUP BY app_key),
js AS (SELECT app_key, o_orderkey AS job_id, {big('sum(shuffle_read)')} AS shuffle_read, {big('sum(shuffle_write)')} AS shuffle_write,
    min((first_ms, stage_id)) AS first_at FROM st WHERE measured_tasks > 0 GROUP BY app_key, o_orderkey),
mj AS (SELECT app_key, {', '.join(f"max({c}) AS max_{c}, max_by(job_id, ({c}, -first_at[1], -first_at[2], -job_id)) AS max_{c}_job_id" for c in ('shuffle_read', 'shuffle_write'))}
    FROM js GROUP BY app_key),
apps AS (SELECT o.app_key, any_value(c_custkey) AS c_custkey, any_value(c_nationkey) AS c_nationkey, any_value(c_mktsegment) AS c_mktsegment,
    any_value(c_name) || '-' || strftime(min(o_orderdate), '%Y-%m-%d') AS app_name,
    min(start_ms) AS start_ms, max(start_ms) + 86400000 AS end_ms
    FROM o JOIN customer ON o_custkey = c_custkey GROUP BY o.app_key),
life AS (SELECT app_key, app_key AS app_id, app_name, start_ms, end_ms, {r2('(end_ms - start_ms) / 1000.0')} AS duration_sec,
    {when_text('start_ms')} AS start_date FROM apps),
env AS (SELECT app_key, {big('(c_custkey % 4 + 1.5) * 1073741824')} AS driver_memory, 2::BIGINT AS driver_cores,
    {big('c_nationkey % 4 + 1')} AS executor_cores, (c_nationkey % 8 + 1)::BIGINT * 1073741824 AS executor_memory,
    CASE WHEN c_custkey % 3 = 0 THEN 536870912::BIGINT
         ELSE greatest({big('floor((c_nationkey % 8 + 1)::BIGINT * 1073741824 * 0.1::DOUBLE)')}, 402653184::BIGINT) END AS executor_overhead,
    c_custkey % 10 AS executor_instances, c_mktsegment = 'BUILDING' AS dynamic_allocation, c_custkey % 20 AS max_executors_conf FROM apps),
ex AS (SELECT app_key, CASE WHEN o_orderkey % 4 = 0 THEN 'driver' ELSE (o_orderkey % 4)::VARCHAR END AS executor_id, start_ms AS ts,
      o_orderkey * 2 AS tie, 1 AS step, o_orderkey % 3 + 1 AS cores, false AS preempted FROM o
    UNION ALL SELECT app_key, CASE WHEN o_orderkey % 4 = 0 THEN 'driver' ELSE (o_orderkey % 4)::VARCHAR END, start_ms + (o_orderkey % 48) * 3600000,
      o_orderkey * 2 + 1, -1, NULL, o_orderkey % 7 = 0 FROM o WHERE o_orderstatus = 'F'),
bounds AS (SELECT app_key, start_ms, end_ms FROM apps),
late AS (SELECT app_key, count(*) AS n FROM t WHERE outcome = 'failed' AND EXISTS (
      SELECT 1 FROM ex WHERE ex.preempted AND ex.app_key = t.app_key AND ex.executor_id = (t.l_suppkey % 3 + 1)::VARCHAR) GROUP BY app_key),
pt AS (SELECT app_key, {big('sum(n)')} AS preempted_tasks FROM (
      SELECT app_key, count(*) AS n FROM t WHERE outcome = 'text' GROUP BY app_key UNION ALL SELECT * FROM late) GROUP BY app_key),
heap AS (SELECT app_key, greatest(max(l_partkey * 1000000) FILTER (m), 0) AS peak_heap FROM t GROUP BY app_key),
sq AS (SELECT *, o_orderkey AS k, {big('floor(o_totalprice)')} AS price, o_orderstatus <> 'P' AS ran, o_orderkey % 3 = 0 AS two,
    ['Overwrite', 'Append', 'ErrorIfExists', 'Ignore'][o_orderkey % 4 + 1] AS w_mode, ['Parquet', 'ORC', 'CSV', 'JSON', 'Text'][o_orderkey % 5 + 1] AS w_format,
    ['Parquet', 'x.OrcFileFormat', 'x.BinaryFileFormat', 'x.JsonFileFormat', 'x.CsvFileFormat', 'Avro', 'x.ParquetFileFormat'][o_orderkey % 7 + 1] AS r_class,
    ['Parquet', 'ORC', 'Binary', 'JSON', 'CSV', 'Avro', 'Parquet'][o_orderkey % 7 + 1] AS r_format FROM o),
tio AS (SELECT o_orderkey AS k, {big('sum(input_bytes)')} AS ib, {big('sum(input_records)')} AS ir, {big('sum(output_bytes)')} AS ob,
    {big('sum(output_records)')} AS orr, {big('count(*) FILTER (output_bytes > 0)')} AS files FROM t GROUP BY o_orderkey),
sx AS (SELECT sq.*, coalesce(ib, 0) AS ib, coalesce(ir, 0) AS ir, coalesce(ob, 0) AS ob, coalesce(orr, 0) AS orr, coalesce(files, 0) AS files
    FROM sq LEFT JOIN tio USING (k)),
wm AS (SELECT app_key, k AS execution_id, greatest(CASE WHEN ran THEN k % 3 ELSE 0 END, files) AS files_written,
    greatest(CASE WHEN ran THEN k % 100 ELSE 0 END, orr) AS rows, greatest(CASE WHEN ran THEN price * 2 ELSE 0 END, ob) AS bytes_written,
    'hdfs://nn/out/' || o_orderpriority AS file_path, w_format AS format, w_mode AS mode FROM sx),
wt AS (SELECT app_key, {big('sum(files_written)')} AS files_written, {big('sum(rows)')} AS rows_written, {big('sum(bytes_written)')} AS bytes_written,
    {big('CASE WHEN sum(files_written) > 0 THEN sum(bytes_written) // sum(files_written) ELSE 0 END')} AS average_file_size FROM wm GROUP BY app_key),
nodes AS (SELECT app_key, k, two, ran, o_orderstatus, o_orderpriority, price, w_mode, w_format, r_class, r_format, n.* FROM sq, LATERAL (
    SELECT * FROM (VALUES
      (0, 0, 'Execute InsertIntoHadoopFsRelationCommand', 'Execute InsertIntoHadoopFsRelationCommand hdfs://nn/out/' || o_orderpriority || ', false, ' || w_format || ', [path=x], ' || w_mode || ', [c]', 'write', 4),
      (1, 1, 'AdaptiveSparkPlan', 'AdaptiveSparkPlan isFinalPlan=false', NULL, 0),
      (2, 2, 'WholeStageCodegen (2)', 'WholeStageCodegen (2)', NULL, 0),
      (3, 3, 'HashAggregate', 'HashAggregate(keys=[o_orderstatus#1], functions=[])', 'agg', 1),
      (4, 4, 'Exchange', 'Exchange hashpartitioning(o_orderstatus#1, ' || (k % 7 + 1) || '), ENSURE_REQUIREMENTS, [plan_id=1]', 'shuffle', 3),
      (5, 5, 'Coalesce', 'Coalesce 4', 'coalesce', 0),
      (6, 6, 'Project', 'Project [o_orderkey#1, o_orderstatus#2]', 'project', 0),
      (7, 7, 'Filter', 'Filter (o_totalprice#3 > 100.0)', 'filter', 1),
      (8, 8, CASE WHEN two THEN 'Union' ELSE 'Scan parquet ' END, CASE WHEN two THEN 'Union' ELSE 'FileScan parquet' END, CASE WHEN two THEN NULL ELSE 'read' END, CASE WHEN two THEN 0 ELSE 5 END),
      (9, 9, 'Scan parquet ', 'FileScan parquet', 'read', 5),
      (10, 9, 'Scan orc ', 'FileScan orc', 'read', 3)
    ) v(pos, depth, node_name, simple_string, kind, metrics) WHERE two OR pos <= 8) n),
metric AS (SELECT nodes.*, v.* FROM nodes, LATERAL (SELECT * FROM (VALUES
      ('write', 'number of written files', 0, k % 3), ('write', 'written output', 1, price * 2), ('write', 'number of output rows', 2, k % 100),
      ('write', 'task commit time', 9, k % 700), ('agg', 'time in aggregation build', 3, k % 11 * 100),
      ('shuffle', 'shuffle bytes written', 4, k % 1000 * 1024), ('shuffle', 'shuffle records written', 10, k % 50), ('shuffle', 'shuffle write time', 11, k % 9 * 250000000),
      ('read', 'number of files read', 6, k % 4), ('read', 'size of files read', 7, price), ('read', 'metadata time', 12, k % 300), ('read', 'number of partitions read', 13, 1)
    ) m(node_kind, metric, acc, value)) v WHERE v.node_kind = nodes.kind AND nodes.ran AND node_name <> 'Scan orc '),
rm AS (SELECT app_key, k AS execution_id, CASE WHEN two THEN 9 ELSE 8 END AS node_pos,
    CASE WHEN ran THEN k % 4 ELSE 0 END AS f0, ir AS rows, greatest(CASE WHEN ran THEN price ELSE 0 END, ib) AS bytes_read,
    CASE WHEN ran THEN 1::BIGINT ELSE 0::BIGINT END AS partitions_read, 'hdfs://nn/in/' || o_orderstatus AS file_path, r_format AS format, 'None' AS partition_filters FROM sx),
rd AS (SELECT app_key, execution_id, node_pos, CASE WHEN f0 = 0 AND bytes_read > 0 THEN 1 ELSE f0 END AS files_read, rows, bytes_read, partitions_read, file_path, format, partition_filters FROM rm),
blocks AS (SELECT o_orderkey AS k, min(l_linenumber) AS n FROM st GROUP BY o_orderkey),
guess AS (SELECT sq.app_key, k, [x FOR x IN [k % 500, k % 77] IF x <> 0 AND x <> k % 50 AND x < k % 900 + n * 10] AS c1,
    CASE WHEN two THEN [x FOR x IN [k % 900 + n * 10, k % 500, k % 77] IF x <> 0 AND x <> k % 50 AND NOT (x >= k % 77 AND k % 77 > 0)] ELSE [] END AS c2
    FROM sq JOIN blocks USING (k)),
fi AS (SELECT app_key, k AS execution_id, coalesce(CASE WHEN k = 0 THEN NULL ELSE list_max(c1) END, list_max(c2)) AS inferred_rows FROM guess
    WHERE coalesce(CASE WHEN k = 0 THEN NULL ELSE list_max(c1) END, list_max(c2)) IS NOT NULL),
paths AS (SELECT DISTINCT app_key, 'input' AS direction, 'parquet' AS format, 'hdfs://nn/in/' || o_orderstatus AS path FROM sq
    UNION SELECT DISTINCT app_key, 'output', 'Output', 'hdfs://nn/in/' || o_orderstatus FROM sq
    UNION SELECT DISTINCT app_key, 'output', 'Output', 'hdfs://nn/out/' || substr(o_orderpriority, 1, 1) FROM sq)
"""

ACTIVITY = f"""
e AS (SELECT 'application_' || user_id AS app_key, *, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events),
bounds AS (SELECT app_key, min(ms) AS start_ms, max(ms) AS end_ms FROM e GROUP BY app_key),
ex AS (SELECT app_key, CASE WHEN event_id % 5 = 4 THEN 'driver' ELSE (event_id % 5)::VARCHAR END AS executor_id, ms AS ts, us AS moment, event_id AS tie,
    CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step, event_id % 4 + 1 AS cores, event_type = 'error' AND value > 100 AS preempted
    FROM e WHERE event_type IN ('signup', 'error')),
env AS (SELECT app_key, 0::BIGINT AS driver_memory, 0::BIGINT AS driver_cores, arg_max(event_id % 4 + 1, us) AS executor_cores, arg_max(event_id % 8 + 1, us) * 1073741824 AS executor_memory,
    greatest({big('floor(arg_max(event_id % 8 + 1, us) * 1073741824 * 0.1::DOUBLE)')}, 402653184::BIGINT) AS executor_overhead,
    0::BIGINT AS executor_instances, false AS dynamic_allocation, 0::BIGINT AS max_executors_conf FROM e WHERE event_type = 'view' GROUP BY app_key),
tt AS (SELECT app_key, {big('count(*)')} AS tasks, {big('sum(floor(value * 1000))')} AS task_ms FROM e WHERE event_type = 'purchase' GROUP BY app_key),
heap AS (SELECT app_key, {big('max(floor(value * 1000000))')} AS peak_heap FROM e WHERE event_type = 'click' GROUP BY app_key),
pt AS (SELECT app_key, {big('count(*)')} AS preempted_tasks FROM e WHERE event_type = 'purchase' AND value > 100 AND EXISTS (
    SELECT 1 FROM ex WHERE ex.preempted AND ex.app_key = e.app_key AND ex.executor_id = (e.event_id % 5)::VARCHAR AND ex.moment < e.us) GROUP BY app_key)
"""


def executors(at: str) -> str:
    """Executor results over `ex`, `bounds`, `env`, `tt`, ordered by (time, tie)."""
    return f"""
act0 AS (SELECT app_key, {at}, tie, step, lag(step, 1, -1) OVER (PARTITION BY app_key, executor_id ORDER BY {at}, tie) AS before FROM ex WHERE executor_id <> 'driver'),
act1 AS (SELECT app_key, sum(CASE WHEN step <> before THEN step ELSE 0 END) OVER (PARTITION BY app_key ORDER BY {at}, tie) AS n,
    sum(step) OVER (PARTITION BY app_key ORDER BY {at}, tie) AS plain, step FROM act0),
act AS (SELECT app_key, {big('greatest(max(n), 0)')} AS max_active_executors FROM act1 GROUP BY app_key),
counted AS (SELECT app_key, {big('greatest(coalesce(max(plain) FILTER (step = 1), 0), 0)')} AS max_active_executors FROM act1 GROUP BY app_key),
adds AS (SELECT app_key, executor_id, arg_max(ts, ({at}, tie)) AS ts, arg_max(cores, ({at}, tie)) AS cores, max(({at}, tie)) AS last FROM ex WHERE step = 1 GROUP BY ALL),
rems AS (SELECT app_key, executor_id, arg_max(ts, ({at}, tie)) AS ts, max(({at}, tie)) AS last FROM ex WHERE step = -1 GROUP BY ALL),
lt AS (SELECT coalesce(a.app_key, r.app_key) AS app_key, coalesce(a.executor_id, r.executor_id) AS executor_id, coalesce(a.ts, start_ms) AS start_ms, coalesce(r.ts, end_ms) AS end_ms
    FROM (SELECT * FROM adds WHERE executor_id <> 'driver') a FULL JOIN rems r ON a.app_key = r.app_key AND a.executor_id = r.executor_id
    JOIN bounds b ON b.app_key = coalesce(a.app_key, r.app_key)),
lc AS (SELECT a.app_key, a.executor_id, a.ts AS start_ms, CASE WHEN r.last > a.last THEN r.ts ELSE end_ms END AS end_ms, {big('a.cores')} AS cores
    FROM adds a LEFT JOIN rems r ON a.app_key = r.app_key AND a.executor_id = r.executor_id JOIN bounds b ON b.app_key = a.app_key),
cap AS (SELECT app_key, {big('sum(greatest(end_ms - start_ms, 0)) * coalesce(any_value(executor_cores), 1)')} AS capacity_ms FROM lt LEFT JOIN env USING (app_key) GROUP BY app_key),
idle AS (SELECT app_key, capacity_ms, task_ms, {pct('capacity_ms - task_ms', 'capacity_ms')} AS idle_pct FROM (
    SELECT coalesce(cap.app_key, tt.app_key) AS app_key, coalesce(capacity_ms, 0) AS capacity_ms, coalesce(task_ms, 0) AS task_ms FROM cap FULL JOIN tt ON cap.app_key = tt.app_key)),
pe AS (SELECT app_key, {big('count(*)')} AS preempted_executors FROM ex WHERE preempted GROUP BY app_key),
caps AS (SELECT app_key, coalesce(max_active_executors, 0) AS max_active_executors,
    CASE WHEN coalesce(CASE WHEN dynamic_allocation THEN max_executors_conf ELSE executor_instances END, 0) = 0 THEN coalesce(max_active_executors, 0)
      ELSE CASE WHEN dynamic_allocation THEN max_executors_conf ELSE executor_instances END END AS requested_executors,
    coalesce(max_active_executors, 0) * coalesce(executor_cores, 1) AS total_cores,
    coalesce(max_active_executors * (executor_memory + executor_overhead), 0) AS total_memory,
    coalesce(peak_heap, 0) AS peak_heap, {pct('coalesce(peak_heap, 0)', 'coalesce(executor_memory, 0)')} AS peak_memory_pct
    FROM bounds LEFT JOIN env USING (app_key) LEFT JOIN act USING (app_key) LEFT JOIN heap USING (app_key))"""


SUMMARY = f"""
summ AS (SELECT app_key, {', '.join(f'{source} AS "{name}"' for name, source in SUMMARY_COLUMNS.items())} FROM (
  SELECT life.app_key, start_date, app_id, app_name, duration_sec, driver_cores, driver_memory, executor_cores, executor_memory, executor_overhead,
    requested_executors, caps.max_active_executors, coalesce(preempted_executors, 0) AS preempted_executors, total_cores, total_memory,
    coalesce(idle_pct, 0.0) AS idle_pct, peak_memory_pct, caps.peak_heap,
    {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('input_bytes', 'output_bytes', 'rows_written', 'average_file_size', 'files_written', 'spill_memory', 'spill_disk', 'shuffle_read', 'shuffle_write', 'tasks', 'preempted_tasks'))},
    coalesce(ms.max_shuffle_read, 0) AS max_shuffle_read_stage, ms.max_shuffle_read_stage_id, coalesce(ms.max_shuffle_write, 0) AS max_shuffle_write_stage, ms.max_shuffle_write_stage_id,
    coalesce(ms.max_spill_memory, 0) AS max_spill_memory_stage, ms.max_spill_memory_stage_id,
    coalesce(mj.max_shuffle_read, 0) AS max_shuffle_read_job, mj.max_shuffle_read_job_id, coalesce(mj.max_shuffle_write, 0) AS max_shuffle_write_job, mj.max_shuffle_write_job_id
  FROM life LEFT JOIN env USING (app_key) LEFT JOIN tt USING (app_key) LEFT JOIN idle USING (app_key) LEFT JOIN caps USING (app_key) LEFT JOIN pt USING (app_key)
    LEFT JOIN pe USING (app_key) LEFT JOIN ms USING (app_key) LEFT JOIN mj USING (app_key) LEFT JOIN wt USING (app_key)))"""

ALT = f"""
spilled AS (SELECT app_key, {', '.join(f"max({c}) FILTER ({c} > 0) AS max_{c}, max_by(stage_id, ({c}, -first_{c}_ms, -stage_id)) FILTER ({c} > 0) AS max_{c}_stage_id" for c in ('spill_memory', 'spill_disk'))}
    FROM st GROUP BY app_key),
alt AS (SELECT life.app_key, app_id, app_name, CASE WHEN dynamic_allocation THEN max_executors_conf ELSE executor_instances END AS requested_executors,
    (life.end_ms - life.start_ms) / 1000.0::DOUBLE AS duration_sec,
    CASE WHEN lifetime_ms > 0 THEN ((lifetime_ms - coalesce(task_ms, 0))::DOUBLE / lifetime_ms::DOUBLE) * 100 ELSE 0.0 END AS idle_pct,
    (coalesce(any_heap, 0)::DOUBLE / executor_memory::DOUBLE) * 100 AS peak_memory_pct, coalesce(any_heap, 0) AS peak_heap, executor_memory,
    coalesce(spill_memory, 0) AS spill_memory, coalesce(spill_disk, 0) AS spill_disk, driver_cores, driver_memory, executor_cores, executor_overhead,
    coalesce(max_active_executors, 0) AS max_concurrent_executors, coalesce(max_active_executors, 0) * executor_cores AS total_cores,
    coalesce(max_active_executors, 0) * (executor_memory + executor_overhead) AS total_memory,
    coalesce(input_bytes, 0) AS input_bytes, coalesce(output_bytes, 0) AS output_bytes, coalesce(shuffle_read, 0) AS shuffle_read, coalesce(shuffle_write, 0) AS shuffle_write,
    coalesce(msr, 0) AS max_stage_shuffle_read, coalesce(msw, 0) AS max_stage_shuffle_write,
    coalesce(max_spill_memory, 0) AS max_spill_memory, max_spill_memory_stage_id, coalesce((max_spill_memory_stage_id // 10)::VARCHAR, 'Unknown') AS max_spill_memory_job_id,
    coalesce(max_spill_disk, 0) AS max_spill_disk, max_spill_disk_stage_id, coalesce((max_spill_disk_stage_id // 10)::VARCHAR, 'Unknown') AS max_spill_disk_job_id,
    coalesce(inputs, 0) AS input_paths, coalesce(outputs, 0) AS output_paths
  FROM life LEFT JOIN env USING (app_key) LEFT JOIN tt USING (app_key) LEFT JOIN counted USING (app_key) LEFT JOIN spilled USING (app_key)
    LEFT JOIN (SELECT app_key, max(l_partkey * 1000000) AS any_heap FROM t GROUP BY app_key) USING (app_key)
    LEFT JOIN (SELECT app_key, max(shuffle_read) AS msr, max(shuffle_write) AS msw FROM st GROUP BY app_key) USING (app_key)
    LEFT JOIN (SELECT app_key, {big('sum(greatest(end_ms - start_ms, 0) * cores)')} AS lifetime_ms FROM lc GROUP BY app_key) USING (app_key)
    LEFT JOIN (SELECT app_key, {big("count(*) FILTER (direction = 'input')")} AS inputs, {big("count(*) FILTER (direction = 'output')")} AS outputs FROM paths GROUP BY app_key) USING (app_key))"""


def app(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([APPLICATION, *more]) + "\n" + select


def act(select: str) -> str:
    return "WITH " + ",\n".join([ACTIVITY, executors("moment")]) + "\n" + select


EX = executors("ts")


def fmt(n: str) -> str:
    """Bytes as text, like printf('%.2f') of the scaled value."""
    cases = " ".join(
        f"WHEN {n} > {1024**k} THEN printf('%.2f {label}', {n} / {1024.0**k!r}::DOUBLE)"
        for k, label in reversed(list(enumerate(["KB", "MB", "GB", "TB"], start=1)))
    )
    return f"CASE {cases} ELSE printf('%.2f ', {n}::DOUBLE) END"


def unit(name: str, u: str) -> str:
    size = S.UNIT_BYTES[u]
    return f'(("{name}"::HUGEINT * 2000000 + {size}) // {2 * size})::DOUBLE / 1000000.0::DOUBLE'


def in_unit(name: str, u: str) -> str:
    return unit(name, u) if name in BYTE_COLUMNS else f'"{name}"::DOUBLE'


def unpivot(metrics: list[str], value, source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {value(m)} AS value FROM {source}" for m in metrics)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sizing(partition: int, factor: int) -> str:
    memory = int(partition * factor * 4 * 2 / 0.6) + 300 * S.MIB
    return app(f"""SELECT app_key, max_shuffle, p AS partitions, {big('ceil(p / 10.0)')} AS cores, {big('ceil(ceil(p / 10.0) / 4.0)')} AS executors, {memory}::BIGINT AS executor_memory
        FROM (SELECT app_key, max_shuffle, {big(f'ceil(max_shuffle::DOUBLE / {partition}.0)')} AS p
        FROM (SELECT app_key, greatest(max_shuffle_read, max_shuffle_write) AS max_shuffle FROM ms))""")


REPORT_LINES = [
    (1, quoted("=" * 120)), (2, "'🚀 Application Report: ' || app_name || ' (' || app_id || ')'"), (3, quoted("=" * 120)),
    (4, "printf('Duration: %.2f s', duration_sec)"), (5, "printf('Idle Cores: %.2f%%', idle_pct)"),
    (6, f"printf('Peak Memory Usage: %.2f%% (Peak Heap: ', peak_memory_pct) || {fmt('peak_heap')} || ' / ' || {fmt('executor_memory')} || ')'"),
    (7, f"'Total Spill: Memory=' || {fmt('spill_memory')} || ' , Disk=' || {fmt('spill_disk')}"),
    (8, f"CASE WHEN max_spill_memory > 0 THEN '  Max Memory Spill: ' || {fmt('max_spill_memory')} || ' (Job ID: ' || max_spill_memory_job_id || ', Stage ID: ' || max_spill_memory_stage_id || ')' END"),
    (9, f"CASE WHEN max_spill_disk > 0 THEN '  Max Disk Spill: ' || {fmt('max_spill_disk')} || ' (Job ID: ' || max_spill_disk_job_id || ', Stage ID: ' || max_spill_disk_stage_id || ')' END"),
    (10, f"'Shuffle Read: Total=' || {fmt('shuffle_read')} || ', Max/Stage=' || {fmt('max_stage_shuffle_read')}"),
    (11, f"'Shuffle Write: Total=' || {fmt('shuffle_write')} || ', Max/Stage=' || {fmt('max_stage_shuffle_write')}"),
    (12, quoted("-" * 60)), (13, "'Resource Configuration & Usage:'"),
    (14, f"'Driver: ' || driver_cores || ' Cores, ' || {fmt('driver_memory')} || ' Memory'"),
    (15, f"'Executor: ' || executor_cores || ' Cores, ' || {fmt('executor_memory')} || ' Memory, ' || {fmt('executor_overhead')} || ' Overhead'"),
    (16, "'Requested Executors: ' || requested_executors"), (17, "'Max Concurrent Executors: ' || max_concurrent_executors"),
    (18, f"'Total Resources (Peak): ' || total_cores || ' Cores, ' || {fmt('total_memory')} || ' Memory'"),
    (19, quoted("-" * 60)), (20, "'Input Data:'"),
    (21, f"'  Total Size: ' || CASE WHEN input_bytes > 0 THEN {fmt('input_bytes')} ELSE '0 B' END"),
    (23, quoted("-" * 60)), (24, "'Output Data:'"),
    (25, f"'  Total Size: ' || CASE WHEN output_bytes > 0 THEN {fmt('output_bytes')} ELSE '0 B' END"), (27, "chr(10)"),
]

STEPS = f"""
chosen AS (SELECT app_key, min(k) AS k FROM sq GROUP BY app_key, o_orderpriority),
heads AS (SELECT sx.*, {when_text('start_ms')} AS start_time, {r2('(k % 1000) / 1000.0')} AS duration_sec FROM sx JOIN chosen USING (app_key, k)),
ops AS (SELECT h.app_key, h.k, h.o_orderpriority, h.start_time, h.duration_sec, s.* FROM heads h LEFT JOIN fi ON fi.execution_id = h.k, LATERAL (SELECT * FROM (VALUES
  (1, 'Read Parquet', CASE WHEN ran AND h.k % 4 > 0 THEN h.k % 4 ELSE (greatest(CASE WHEN ran THEN price ELSE 0 END, ib) > 0)::BIGINT END, ir, greatest(CASE WHEN ran THEN price ELSE 0 END, ib),
     'hdfs://nn/in/' || o_orderstatus, r_format, NULL, 'None', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN ran AND h.k % 300 > 0 THEN {r2('(h.k % 300)::DOUBLE / 1000.0')} END),
  (2, CASE WHEN two THEN 'Read Orc' END, 0, 0, 0, 'hdfs://nn/more', 'ORC', NULL, '[isnotnull(p#1)]', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (3, CASE WHEN two THEN 'Union' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (4, 'Filter', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '(o_totalprice#3 > 100.0)', coalesce(inferred_rows, 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (5, 'Select', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'o_orderkey#1, o_orderstatus#2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (6, 'Repartition (Coalesce)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '4', NULL, NULL, NULL),
  (7, 'Shuffle', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'hashpartitioning(o_orderstatus#1, ' || (h.k % 7 + 1) || ')', (h.k % 7 + 1)::VARCHAR,
     CASE WHEN ran AND h.k % 1000 > 0 THEN h.k % 1000 * 1024 END, CASE WHEN ran AND h.k % 50 > 0 THEN h.k % 50 END, CASE WHEN ran AND h.k % 9 > 0 THEN {r2('(h.k % 9 * 250)::DOUBLE / 1000.0')} END),
  (8, 'Aggregate', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'o_orderstatus#1', '', true, NULL, NULL, NULL, NULL, CASE WHEN ran AND h.k % 11 > 0 THEN {r2('(h.k % 11 * 100)::DOUBLE / 1000.0')} END),
  (9, 'Write', greatest(CASE WHEN ran THEN h.k % 3 ELSE 0 END, files), greatest(CASE WHEN ran THEN h.k % 100 ELSE 0 END, orr), greatest(CASE WHEN ran THEN price * 2 ELSE 0 END, ob),
     'hdfs://nn/out/' || o_orderpriority, w_format, w_mode, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN ran AND h.k % 700 > 0 THEN {r2('(h.k % 700)::DOUBLE / 1000.0')} END)
  ) v(pos, operation, files, rows, bytes, file_path, format, mode, partition_filters, condition, output_rows, selected_fields, aggregate_keys, aggregate_functions, is_distinct,
      partitioning, num_partitions, shuffle_bytes, shuffle_records, operation_sec) WHERE operation IS NOT NULL) s)"""

_REL = 1_000_000_000_000


def oracle_sql() -> dict[str, str]:
    nodes = "SELECT app_key, k AS execution_id, pos::INTEGER AS pos"
    rerun_jobs = f"""rj AS (SELECT app_key, stage_id, CASE WHEN l_linenumber % 2 = 0 THEN stage_id + {_REL} ELSE o_orderkey END AS job_id, shuffle_read, shuffle_write
        FROM st WHERE measured_tasks > 0)"""
    sql = {
        "event_type_counts": app("""SELECT event, CAST(n AS BIGINT) AS lines FROM (
            SELECT 'SparkListenerApplicationStart' AS event, count(*) AS n FROM apps UNION ALL SELECT 'SparkListenerApplicationEnd', count(*) FROM apps
            UNION ALL SELECT 'SparkListenerEnvironmentUpdate', count(*) FROM apps UNION ALL SELECT 'SparkListenerExecutorAdded', count(*) FROM o
            UNION ALL SELECT 'SparkListenerExecutorRemoved', count(*) FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'SparkListenerJobStart', count(*) FROM o
            UNION ALL SELECT 'SparkListenerStageSubmitted', count(*) FROM st UNION ALL SELECT 'SparkListenerStageCompleted', count(*) FROM st
            UNION ALL SELECT 'SparkListenerTaskEnd', count(*) FROM t
            UNION ALL SELECT 'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart', count(*) FROM sq
            UNION ALL SELECT 'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd', count(*) FROM sq
            UNION ALL SELECT 'org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates', 2 * count(*) FROM sq WHERE ran)"""),
        "log_groups": app("""SELECT app_key, CAST(sum(n) AS BIGINT) AS lines, min(lo) AS first_ts, max(hi) AS last_ts FROM (
            SELECT app_key, 3 AS n, start_ms AS lo, end_ms AS hi FROM apps UNION ALL SELECT app_key, 2, start_ms, start_ms FROM o
            UNION ALL SELECT app_key, 1, ts, ts FROM ex WHERE step = -1 UNION ALL SELECT app_key, 2, NULL, NULL FROM st UNION ALL SELECT app_key, 1, NULL, NULL FROM t
            UNION ALL SELECT app_key, CASE WHEN ran THEN 4 ELSE 2 END, NULL, NULL FROM sq) GROUP BY app_key""", EX),
        "app_names": app("SELECT app_key, coalesce(app_name, 'File Not Found') AS app_name FROM (SELECT DISTINCT 'application_' || (c_custkey * 2) AS app_key FROM customer) LEFT JOIN life USING (app_key)"),
        "log_inventory": app("SELECT app_key, app_key AS filename, app_name, start_date AS date FROM life"),
        "log_search": app("SELECT app_key, app_key AS filename, app_name FROM life WHERE contains(lower(app_name), 'omer#0000001')"),
        "log_search_counts": app("SELECT count(*) AS total, count(*) FILTER (contains(lower(app_name), '-1995-0') OR contains(app_key, '_1')) AS shown FROM life"),
        "renamed_log_lines": app("""SELECT app_key, 'my-spark-job-' || right(app_name, 10) AS new_name, CAST(sum(n) AS BIGINT) AS lines, 1::BIGINT AS with_new_name, 0::BIGINT AS with_old_name FROM (
            SELECT app_key, 3 AS n FROM apps UNION ALL SELECT app_key, 2 FROM o UNION ALL SELECT app_key, 1 FROM ex WHERE step = -1 UNION ALL SELECT app_key, 2 FROM st UNION ALL SELECT app_key, 1 FROM t
            UNION ALL SELECT app_key, CASE WHEN ran THEN 4 ELSE 2 END FROM sq) JOIN life USING (app_key) GROUP BY ALL""", EX),
        "app_lifecycle": app("SELECT * FROM life"),
        "activity_lifecycle": act(f"""SELECT app_key, app_key AS app_id, 'user ' || substr(app_key, 13) AS app_name, start_ms, end_ms,
            {r2('(end_ms - start_ms) / 1000.0::DOUBLE')} AS duration_sec, {when_text('start_ms')} AS start_date FROM bounds"""),
        "app_environment": app("SELECT * FROM env"),
        "peak_heap": act("""SELECT app_key, coalesce(peak_heap, 0) AS peak_heap FROM (SELECT DISTINCT app_key FROM e WHERE event_type IN ('click', 'purchase')) LEFT JOIN heap USING (app_key)"""),
        "executor_timeline": act("""SELECT app_key, ts AS time, (ts - start_ms)::DOUBLE / 1000.0::DOUBLE AS seconds, CAST(n - least(0, low) AS BIGINT) AS count FROM (
            SELECT *, min(n) OVER (PARTITION BY app_key ORDER BY moment, tie) AS low FROM (SELECT *, sum(step) OVER (PARTITION BY app_key ORDER BY moment, tie) AS n FROM ex)) JOIN bounds USING (app_key)
            UNION ALL SELECT app_key, start_ms, 0.0, 0 FROM bounds"""),
        "max_active_executors": act("SELECT * FROM act"),
        "max_counted_executors": act("SELECT * FROM counted"),
        "executor_lifetimes": act("SELECT * FROM lt"),
        "executor_lifetimes_by_cores": act("SELECT * FROM lc"),
        "idle_cores": act("SELECT * FROM idle"),
        "capacity": act("SELECT * FROM caps"),
        "preempted_executors": act("SELECT * FROM pe"),
        "preempted_tasks": app("SELECT * FROM pt", EX),
        "preempted_tasks_by_executor": act("SELECT * FROM pt"),
        "task_totals": app("SELECT * FROM tt"),
        "stage_totals": app("SELECT * EXCLUDE (o_orderkey, l_linenumber, start_ms, launch_ms, first_ms, first_spill_memory_ms, first_spill_disk_ms) FROM st"),
        "job_shuffle": app(f"SELECT app_key, job_id, {big('sum(shuffle_read)')} AS shuffle_read, {big('sum(shuffle_write)')} AS shuffle_write FROM rj GROUP BY app_key, job_id", rerun_jobs),
        "max_shuffle_stage": app("SELECT * EXCLUDE (max_spill_memory, max_spill_memory_stage_id) FROM ms"),
        "max_spill_stage": app("SELECT app_key, max_spill_memory, max_spill_memory_stage_id FROM ms"),
        "max_shuffle_job": app("SELECT * FROM mj"),
        "max_positive_stages": app("""SELECT app_key, max_spill_memory, max_spill_memory_stage_id, (max_spill_memory_stage_id // 10)::VARCHAR AS max_spill_memory_job_id,
            max_spill_disk, max_spill_disk_stage_id, (max_spill_disk_stage_id // 10)::VARCHAR AS max_spill_disk_job_id FROM spilled WHERE max_spill_memory IS NOT NULL""", EX, ALT),
        "stage_detail": app(f"""SELECT st.app_key, stage_id, 'stage ' || l_linenumber AS stage_name,
            CASE WHEN l_linenumber % 3 = 0 THEN o_orderpriority WHEN l_linenumber % 2 = 0 THEN 'call at ' || l_linenumber ELSE 'stage ' || l_linenumber END AS description,
            CASE WHEN l_linenumber = 7 THEN 'Failed' ELSE 'Completed' END AS status, st.start_ms AS submission_time, launch_ms AS completion_time,
            tasks, input_bytes, input_records, output_bytes, output_records, shuffle_read, shuffle_write, spill_memory, spill_disk,
            l_linenumber * 60.0::DOUBLE AS duration_sec, {big('input_bytes // tasks')} AS average_input FROM st JOIN o ON o.o_orderkey = st.o_orderkey"""),
        "task_execution": app(f"""SELECT app_key, stage_id, q * 1000 AS duration_ms, CASE WHEN l_linenumber % 2 = 0 AND finish_ms > launch_ms + 25500 THEN o_orderkey + {_REL} ELSE o_orderkey END AS execution_id
            FROM t"""),
        "sql_executions": app("""SELECT app_key, k AS execution_id, o_orderpriority AS description, start_ms, 'Execute InsertIntoHadoopFsRelationCommand' AS plan_root,
            CASE WHEN two THEN 11 ELSE 9 END::BIGINT AS plan_nodes, CASE WHEN two THEN 9 ELSE 8 END::INTEGER AS plan_depth, 1::BIGINT AS jobs, k AS first_job, k AS last_job, """ + plan_json() + " AS plan FROM sq"),
        "execution_jobs": app("SELECT app_key, k AS execution_id, k AS job_id FROM sq"),
        "plan_nodes": app(f"""{nodes}, CASE WHEN pos = 9 AND two THEN 0 WHEN pos = 10 THEN 1 WHEN two THEN 10 - pos ELSE 8 - pos END::INTEGER AS post_pos, depth::INTEGER AS depth,
            CASE WHEN pos = 10 THEN '0.0.0.0.0.0.0.0.1' ELSE rtrim(repeat('0.', depth), '.') END AS path, node_name, simple_string FROM nodes"""),
        "tracked_nodes": app(f"{nodes}, kind, metrics::INTEGER AS metrics FROM nodes WHERE kind IS NOT NULL"),
        "op_details": app(f"""{nodes}, kind,
            CASE WHEN kind = 'write' THEN 'hdfs://nn/out/' || o_orderpriority WHEN pos = 10 THEN 'hdfs://nn/more' WHEN kind = 'read' THEN 'hdfs://nn/in/' || o_orderstatus END AS file_path,
            CASE WHEN pos = 10 THEN 'ORC' WHEN kind = 'read' THEN r_format WHEN kind = 'write' THEN w_format END AS format, CASE WHEN kind = 'write' THEN w_mode END AS mode,
            CASE WHEN pos = 10 THEN '[isnotnull(p#1)]' WHEN kind = 'read' THEN 'None' END AS partition_filters, CASE WHEN kind = 'filter' THEN '(o_totalprice#3 > 100.0)' END AS condition,
            CASE WHEN kind = 'project' THEN 'o_orderkey#1, o_orderstatus#2' END AS selected_fields, CASE WHEN kind = 'agg' THEN 'o_orderstatus#1' END AS aggregate_keys,
            CASE WHEN kind = 'agg' THEN '' END AS aggregate_functions, CASE WHEN kind = 'agg' THEN true END AS is_distinct,
            CASE WHEN kind = 'shuffle' THEN 'hashpartitioning(o_orderstatus#1, ' || (k % 7 + 1) || ')' END AS partitioning,
            CASE WHEN kind = 'shuffle' THEN (k % 7 + 1)::VARCHAR WHEN kind = 'coalesce' THEN '4' END AS num_partitions FROM nodes WHERE kind IS NOT NULL"""),
        "node_driver_metrics": app(f"{nodes}, metric, CAST(value AS BIGINT) AS value FROM metric"),
        "accumulator_rollup": app("""SELECT app_key, acc_id, max(v)::DOUBLE AS value FROM (
            SELECT app_key, o_orderkey * 20 + 5 AS acc_id, sum(q) AS v FROM t GROUP BY app_key, o_orderkey
            UNION ALL SELECT DISTINCT app_key, o_orderkey * 20 + 17, 0 FROM t
            UNION ALL SELECT app_key, k * 20 + acc, value FROM metric UNION ALL SELECT app_key, k * 20 + a, 999 FROM sq, (VALUES (6), (0)) x(a) WHERE ran)
            GROUP BY app_key, acc_id"""),
        "read_metrics": app(f"SELECT *, {big('CASE WHEN files_read > 0 THEN bytes_read // files_read ELSE 0 END')} AS average_file_size FROM rd WHERE files_read > 0 OR rows > 0"),
        "write_metrics": app(f"SELECT *, {big('CASE WHEN files_written > 0 THEN bytes_written // files_written ELSE 0 END')} AS average_file_size FROM wm"),
        "write_totals": app("SELECT * FROM wt"),
        "plan_text_paths": app("SELECT * FROM paths"),
        "filter_rows_inferred": app("SELECT * FROM fi"),
        "operation_list": app(f"""SELECT app_key, k AS execution_id, o_orderpriority AS description, start_time, duration_sec,
            CAST(row_number() OVER (PARTITION BY app_key, k ORDER BY pos) AS INTEGER) AS position, operation, files, rows, bytes,
            {big('CASE WHEN files > 0 THEN bytes // files WHEN files = 0 THEN 0 END')} AS average_size, file_path, format, mode, partition_filters, condition, output_rows, selected_fields,
            aggregate_keys, aggregate_functions, is_distinct, partitioning, num_partitions, shuffle_bytes, shuffle_records, operation_sec FROM ops""", STEPS),
        "app_summary": app("""SELECT *, 'http://history:18080/history/' || app_key || '/' AS "History Link" FROM summ""", EX, SUMMARY),
        "alt_profile": app("SELECT * FROM alt", EX, ALT),
        "app_report_lines": app(
            " UNION ALL ".join(f"SELECT app_key, {n} AS section, '' AS item, {text} AS line FROM alt WHERE {text} IS NOT NULL" for n, text in REPORT_LINES)
            + """ UNION ALL SELECT DISTINCT app_key, 22, format, '  Format: ' || format FROM paths WHERE direction = 'input'
            UNION ALL SELECT app_key, 22, format || ' ' || path, '    - ' || path FROM paths WHERE direction = 'input'
            UNION ALL SELECT app_key, 26, path, '    - ' || path FROM paths WHERE direction = 'output'""", EX, ALT),
        "summary_in_unit": app("SELECT app_key, " + ", ".join(
            f'{unit(n, "MB")} AS "{n} (MB)"' if n in BYTE_COLUMNS else f'"{n}"' for n in SUMMARY_COLUMNS) + " FROM summ", EX, SUMMARY),
        "metrics_long": app(
            f"SELECT app_key, metric, value, description FROM ({unpivot(METRIC_COLUMNS, lambda m: f'\"{m}\"::DOUBLE', 'summ', 'app_key')}) JOIN (VALUES "
            + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in METRIC_DESCRIPTIONS.items()) + ") d(metric, description) USING (metric)", EX, SUMMARY),
        "summary_stats": app(f"""SELECT metric, count(*) AS applications, min(value) AS min, max(value) AS max, median(value) AS median, round(avg(value), 2) AS avg
            FROM ({unpivot(STATISTICS_METRICS, lambda m: in_unit(m, 'KB'), 'summ', 'app_key')}) GROUP BY metric""", EX, SUMMARY),
        "metric_trend": app(f"""SELECT app_key, position, label, metric, value FROM ({unpivot(METRIC_COLUMNS, lambda m: in_unit(m, 'GB'), 'placed', 'app_key, position, label')})""", EX, SUMMARY,
            """placed AS (SELECT *, row_number() OVER (ORDER BY "Start Date", app_key) AS position, split_part("Start Date", ' ', 1) AS label FROM summ)"""),
        "results_ranked": app("SELECT app_key, app_name, duration_sec, row_number() OVER (ORDER BY lower(app_name) DESC, app_key) AS place FROM life"),
        "results_after_delete": app("""SELECT app_key, app_id AS "Application ID", app_name AS "Application Name" FROM life JOIN apps USING (app_key, app_name) WHERE c_mktsegment <> 'BUILDING'"""),
        "deletion_counts": app("SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS deleted_rows, count(*) FILTER (c_mktsegment <> 'BUILDING') AS remaining_count FROM apps"),
        "sizing_static": sizing(128 * S.MIB, 3),
        "sizing_dynamic": sizing(64 * S.MIB, 10),
        "sizing_choice": app("""SELECT name, runs, variation, CASE WHEN variation > 0.3 THEN 'dynamic' ELSE 'static' END AS strategy FROM (
            SELECT c_mktsegment AS name, count(*) AS runs, round(coalesce(stddev_samp(x) / nullif(avg(x), 0), 0), 6) AS variation
            FROM (SELECT c_mktsegment, greatest(max_shuffle_read, max_shuffle_write)::DOUBLE AS x FROM apps JOIN ms USING (app_key)) GROUP BY c_mktsegment)"""),
        "memory_breakdown": app(f"""SELECT app_key, executor_memory, overhead, unified, unified // 2 AS execution, unified - unified // 2 AS storage, coalesce(peak_heap, 0) AS peak_heap, coalesce(spill_memory, 0) AS spill_memory
            FROM (SELECT *, greatest({big('floor(executor_memory * 0.1::DOUBLE)')}, 402653184::BIGINT) AS overhead, {big('floor((executor_memory - 314572800)::DOUBLE * 0.6::DOUBLE)')} AS unified FROM env)
            LEFT JOIN heap USING (app_key) LEFT JOIN tt USING (app_key)"""),
        "findings": app("""SELECT app_key, "Peak Memory Usage (%)" >= 90 AS raise_memory, "Total Spill (Memory)" > 0 OR "Total Spill (Disk)" > 0 AS spills, "Avg Idle Cores (%)" >= 50 AS fewer_executors FROM summ""", EX, SUMMARY),
    }
    table = {
        "App ID": "app_id", "App Name": "app_name", "Duration (s)": "duration_sec", "Idle Cores (%)": "idle_pct", "Peak Mem (%)": "peak_memory_pct",
        "Peak Heap": fmt("peak_heap"), "Total Spill (Mem)": fmt("spill_memory"), "Total Spill (Disk)": fmt("spill_disk"),
        **{f"Max Spill {n}": f"{fmt(f'max_spill_{c}')} || ' (J:' || max_spill_{c}_job_id || ' S:' || coalesce(max_spill_{c}_stage_id::VARCHAR, 'None') || ')'" for n, c in (("Mem", "memory"), ("Disk", "disk"))},
        "Shuffle Read": fmt("shuffle_read"), "Shuffle Write": fmt("shuffle_write"), "Max Stage Read": fmt("max_stage_shuffle_read"), "Max Stage Write": fmt("max_stage_shuffle_write"),
        "Requested Executors": "requested_executors", "Max Executors": "max_concurrent_executors", "Total Cores": "total_cores", "Total Mem": fmt("total_memory"),
        "Input Size": fmt("input_bytes"), "Output Size": fmt("output_bytes"), "Driver Cores": "driver_cores", "Driver Memory": fmt("driver_memory"),
        "Executor Cores": "executor_cores", "Executor Memory": fmt("executor_memory"), "Executor Overhead": fmt("executor_overhead"),
    }
    sql["report_table"] = app("SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in table.items()) + " FROM alt", EX, ALT)
    zero = ("input_bytes", "output_bytes", "rows_written", "average_file_size", "files_written", "spill_memory", "spill_disk", "shuffle_read", "shuffle_write")
    empty_ids = ("max_shuffle_read_stage", "max_shuffle_write_stage", "max_spill_memory_stage", "max_shuffle_read_job", "max_shuffle_write_job")
    values = {
        "start_date": when_text("start_ms"), "app_id": "app_key", "app_name": "'user ' || substr(app_key, 13)", "duration_sec": r2("(end_ms - start_ms) / 1000.0::DOUBLE"),
        "executor_cores": "coalesce(executor_cores, 1)", "idle_pct": "coalesce(idle_pct, 0.0)", "peak_memory_pct": "peak_memory_pct",
        **{c: "0::BIGINT" for c in (*zero, *empty_ids)}, **{f"{c}_id": "NULL::BIGINT" for c in empty_ids},
    }
    columns = ", ".join(f'{values.get(source, f"coalesce({source}, 0)")} AS "{name}"' for name, source in SUMMARY_COLUMNS.items())
    sql["activity_summary"] = act(f"""SELECT app_key, {columns} FROM bounds LEFT JOIN env USING (app_key) LEFT JOIN tt USING (app_key) LEFT JOIN idle USING (app_key)
        LEFT JOIN caps USING (app_key) LEFT JOIN pt USING (app_key) LEFT JOIN pe USING (app_key)""")
    sql["summary_with_errors"] = app("SELECT app_key, " + ", ".join(
        {"Application ID": "CASE WHEN bad THEN app_key ELSE \"Application ID\" END", "Application Name": "CASE WHEN bad THEN 'Error: cut off' ELSE \"Application Name\" END",
         "Start Date": "CASE WHEN bad THEN 'Error' ELSE \"Start Date\" END"}.get(n, f'CASE WHEN NOT bad THEN "{n}" END') + f' AS "{n}"' for n in SUMMARY_COLUMNS)
        + " FROM (SELECT summ.*, c_mktsegment = 'BUILDING' AS bad FROM summ JOIN apps USING (app_key))", EX, SUMMARY)
    kinds = {"orc": "pos = 10", **{k: f"kind = '{k}'" for k in NODE_METRICS if k != "orc"}}
    by_kind = lambda texts: "CASE " + " ".join(f"WHEN {kinds[k]} THEN {t}" for k, t in texts.items()) + " ELSE '{}' END"
    metrics = by_kind({k: obj({m: num(f"k * 20 + {n}") for m, n in NODE_METRICS[k].items()}) for k in kinds})
    plain = lambda *names: {n: num(n) for n in names}
    texts = lambda *names: {n: txt(n) for n in names}
    entries = {
        "application": ("app_lifecycle", texts("app_id", "app_name")),
        "jobs": ("execution_jobs", plain("execution_id", "job_id")),
        "stages": ("stage_detail", {
            **plain("stage_id"), **texts("stage_name", "description", "status"), **plain(
                "submission_time", "completion_time", "tasks", "input_bytes", "input_records", "output_bytes", "output_records", "shuffle_read",
                "shuffle_write", "spill_memory", "spill_disk"), "duration_sec": fixed("duration_sec", 2), **plain("average_input")}),
        "sqlExecutions": ("sql_executions", {
            **plain("execution_id"), **texts("description"), **plain("start_ms"), **texts("plan_root"),
            **plain("plan_nodes", "plan_depth", "jobs", "first_job", "last_job"), "plan": "plan"}),
        "reads": ("read_metrics", {
            **plain("execution_id", "node_pos", "files_read", "rows", "bytes_read", "partitions_read"), **texts("file_path", "format", "partition_filters"),
            **plain("average_file_size")}),
        "writes": ("write_metrics", {
            **plain("execution_id", "files_written", "rows", "bytes_written"), **texts("file_path", "format", "mode"), **plain("average_file_size")}),
    }
    path = "CASE WHEN pos = 10 THEN '[0,0,0,0,0,0,0,0,1]' ELSE '[' || rtrim(repeat('0,', depth), ',') || ']' END"
    post = "CASE WHEN pos = 9 AND two THEN 0 WHEN pos = 10 THEN 1 WHEN two THEN 10 - pos ELSE 8 - pos END"
    of_nodes = obj({
        "execution_id": num("k"), "pos": num("pos"), "post_pos": num(post), "depth": num("depth"), "path": path, **texts("node_name", "simple_string"),
        "metadata": by_kind({k: t for k, t in NODE_METADATA.items() if k == "orc"} | {"read": NODE_METADATA["read"]}), "metrics": metrics})
    series = obj({"time": num("time"), "seconds": fixed("seconds", 3), "count": num("count")})
    sql["detail_documents"] = " UNION ALL ".join(
        f"SELECT app_key, '{part}' AS part, {obj(fields)} AS json FROM ({sql[name]})" for part, (name, fields) in entries.items()
    ) + " UNION ALL SELECT * FROM (" + app(f"SELECT app_key, 'planNodes' AS part, {of_nodes} AS json FROM nodes") + ") UNION ALL SELECT * FROM (" + app(
        f"""SELECT app_key, 'executorTimeSeries' AS part, {series} AS json FROM (
            SELECT app_key, ts AS time, (ts - start_ms)::DOUBLE / 1000.0::DOUBLE AS seconds, CAST(n - least(0, low) AS BIGINT) AS count FROM (
            SELECT *, min(n) OVER (PARTITION BY app_key ORDER BY ts, tie) AS low FROM (SELECT *, sum(step) OVER (PARTITION BY app_key ORDER BY ts, tie) AS n FROM ex)) JOIN bounds USING (app_key)
            UNION ALL SELECT app_key, start_ms, 0.0, 0 FROM bounds)""") + ")"
    sql["detail_parts"] = f"SELECT app_key, part, count(*) AS rows, CAST(sum(strlen(json)) AS BIGINT) AS bytes FROM ({sql['detail_documents']}) GROUP BY ALL"
    # without shuffle details, an exchange shows its write time alone, read as milliseconds
    bare = {"partitioning": "NULL", "num_partitions": "NULL", "shuffle_bytes": "NULL", "shuffle_records": "NULL",
            "operation_sec": f"CASE WHEN ran AND k % 9 > 0 THEN {r2('(k % 9 * 250000000)::DOUBLE / 1000.0')} END"}
    replaced = ", ".join(f"CASE WHEN operation = 'Shuffle' THEN {e} ELSE s.{c} END AS {c}" for c, e in bare.items())
    plain_columns = ("app_key", "execution_id", "description", "start_time", "duration_sec", "position", "operation", "files", "rows", "bytes", "average_size",
                                 "file_path", "format", "mode", "partition_filters", "condition", "output_rows", "selected_fields", "aggregate_keys",
                                 "aggregate_functions", "is_distinct")
    sql["operation_list_plain"] = f"""SELECT {", ".join("s." + c for c in plain_columns)}, {replaced}
        FROM ({sql["operation_list"]}) s JOIN (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS ran FROM orders) ON k = s.execution_id"""
    users = "(SELECT DISTINCT app_key, user_id FROM e)"
    sql["file_inventory"] = act(f"SELECT app_key, app_key AS filename, CASE WHEN user_id % 2 = 0 THEN app_key ELSE 'appstatus_' || app_key END AS file FROM {users}")
    sql["file_resolution"] = act(f"""SELECT 'application_' || n AS filename, CASE WHEN u.user_id % 2 = 0 THEN app_key ELSE 'appstatus_' || app_key END AS file
        FROM (SELECT user_id AS n FROM {users} UNION SELECT user_id + 1000 FROM {users}) LEFT JOIN {users} u ON u.user_id = n""")
    sql["file_groups"] = act("SELECT 'application_1_' || user_id AS app_key, 3::BIGINT AS files, count(*) + 2 AS lines FROM e GROUP BY user_id")
    sql["file_summary"] = f"""SELECT "Application ID" AS app_id, "Application Name" AS app_name, "Total Tasks" AS tasks,
        "Max Active Executors" AS max_active_executors, "Preempted Executors" AS preempted_executors FROM ({sql["activity_summary"]})"""
    file = r"'metrics_report_' || regexp_replace({}, '-\d{{4}}-\d{{2}}-\d{{2}}$', '') || '.txt'"
    doubles = ("Duration (s)", "Idle Cores (%)", "Peak Mem (%)")
    cells = ", ".join(f"coalesce(printf('%.2f', \"{n}\"), '')" if n in doubles else f"coalesce(\"{n}\"::VARCHAR, '')" for n in table)
    sql["report_document"] = f"""SELECT {file.format('app_name')} AS file_name, app_name, section, concat_ws(' ', app_key, item) AS item, line
        FROM ({sql['app_report_lines']}) JOIN (SELECT app_key, app_name FROM ({sql['app_lifecycle']})) USING (app_key)
        UNION ALL SELECT DISTINCT {file.format('"App Name"')}, chr(1114111), 99, '', {quoted(chr(9).join(table))} FROM ({sql['report_table']})
        UNION ALL SELECT {file.format('"App Name"')}, chr(1114111), 100, "App Name" || ' ' || "App ID", concat_ws(chr(9), {cells}) FROM ({sql['report_table']})"""
    return sql
