"""Small hand-written logs with results worked out by hand."""

import json

from tests.conftest import row

from eventlens.operators import alt, detail, flows, lifecycle, operations, report, summary, tasks
from eventlens.plans import tree

UI = "org.apache.spark.sql.execution.ui."


def start(ts=1000, **more):
    return {"Event": "SparkListenerApplicationStart", "App ID": "application_1", "App Name": "job", "Timestamp": ts, **more}


def end(ts):
    return {"Event": "SparkListenerApplicationEnd", "Timestamp": ts}


def env(**props):
    return {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {k.replace("_", "."): v for k, v in props.items()}}


def added(e, ts=0, cores=1):
    return {"Event": "SparkListenerExecutorAdded", "Timestamp": ts, "Executor ID": e, "Executor Info": {"Total Cores": cores}}


def removed(e, ts=0, **more):
    return {"Event": "SparkListenerExecutorRemoved", "Timestamp": ts, "Executor ID": e, **more}


def task(stage, launch=0, finish=0, executor="1", reason="Success", heap=0, metrics=True, **m):
    event = {
        "Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task End Reason": {"Reason": reason},
        "Task Info": {"Launch Time": launch, "Finish Time": finish, "Executor ID": executor},
        "Task Executor Metrics": {"JVMHeapMemory": heap},
    }
    if metrics:
        event["Task Metrics"] = {
            "Memory Bytes Spilled": m.get("spill", 0), "Disk Bytes Spilled": m.get("disk", 0),
            "Input Metrics": {"Bytes Read": m.get("read", 0), "Records Read": m.get("rows", 0)},
            "Output Metrics": {"Bytes Written": m.get("written", 0), "Records Written": m.get("out_rows", 0)},
            "Shuffle Read Metrics": {"Remote Bytes Read": m.get("remote", 0), "Local Bytes Read": m.get("local", 0)},
            "Shuffle Write Metrics": {"Shuffle Bytes Written": m.get("shuffled", 0)},
        }
    return event


def job(i, stages, execution=None):
    props = {} if execution is None else {"spark.sql.execution.id": str(execution)}
    return {"Event": "SparkListenerJobStart", "Job ID": i, "Stage IDs": stages, "Properties": props}


def node(name, text="", metrics=(), children=(), metadata=None):
    return {
        "nodeName": name, "simpleString": text, "children": list(children), "metadata": metadata or {},
        "metrics": [{"name": n, "accumulatorId": i, "metricType": "sum"} for n, i in metrics],
    }


def sql(execution, plan, description="q", time=0):
    return {"Event": f"{UI}SparkListenerSQLExecutionStart", "executionId": execution, "description": description, "time": time, "sparkPlanInfo": plan}


def updates(execution, *pairs):
    return {"Event": f"{UI}SparkListenerDriverAccumUpdates", "executionId": execution, "accumUpdates": [list(p) for p in pairs]}


def scan(files=6, size=7, rows=8, path="hdfs://nn/in"):
    return node("Scan parquet ", "FileScan", [("number of files read", files), ("size of files read", size), ("number of output rows", rows)],
                metadata={"Location": f"InMemoryFileIndex(1 paths)[{path}]", "Format": "Parquet", "PartitionFilters": "[]"})


def test_empty_and_malformed(make_log):
    got = row(summary.app_summary(make_log(["not json", "[1]", '{"Event":null}', ""])))
    assert (got["Application ID"], got["Application Name"], got["Start Date"], got["Executor Cores"]) == ("Unknown", "Unknown", "", 1)
    others = [v for k, v in got.items() if k not in ("app_key", "Application ID", "Application Name", "Start Date", "Executor Cores") and not k.endswith(" ID")]
    assert set(others) == {0}
    assert got["Max Shuffle Read Stage ID"] is None and len(got) == 39


def test_lifecycle_and_environment(make_log):
    log = make_log([
        start(0), start(86400000 + 1000), env(spark_executor_memory="2g", spark_executor_cores="3", spark_executor_instances="5"),
        env(spark_executor_memory="4g"), end(86400000 + 2005),
    ])
    life = row(lifecycle.app_lifecycle(log))
    assert (life["start_date"], life["duration_sec"]) == ("1970-01-02 00:00:01", round(1.005, 2))
    settings = row(lifecycle.app_environment(log))
    # the last event counts as a whole
    assert (settings["executor_memory"], settings["executor_cores"], settings["executor_instances"]) == (4 * 1024**3, 1, 0)
    assert settings["executor_overhead"] == int(4 * 1024**3 * 0.1)


def test_concurrency_and_timeline(make_log):
    log = make_log([start(1000), added("1", 2000), added("1", 3000), added("2", 4000), removed("3", 5000), removed("1", 6000), added("driver", 7500)])
    assert row(lifecycle.max_active_executors(log))["max_active_executors"] == 2
    assert row(lifecycle.max_counted_executors(log))["max_active_executors"] == 3
    line = lifecycle.executor_timeline(log).orderBy("seq").collect()
    assert [r["count"] for r in line] == [0, 1, 2, 3, 2, 1, 2]
    assert line[-1].seconds == 6.5


def test_timeline_never_drops_below_zero(make_log):
    log = make_log([removed("1", 1), added("1", 2), added("2", 3), removed("1", 4), removed("2", 5), removed("2", 6), added("3", 7)])
    assert [r["count"] for r in lifecycle.executor_timeline(log).orderBy("seq").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_capacity_of_executor_that_was_only_removed(make_log):
    log = make_log([start(1000), env(spark_executor_cores="4"), removed("1", 10000), task(1, 0, 9000), end(20000)])
    got = row(lifecycle.idle_cores(log, tasks.task_totals(log).select("app_key", "task_ms")))
    assert (got["capacity_ms"], got["task_ms"], got["idle_pct"]) == (36000, 9000, 75.0)


def test_idle_can_be_negative(make_log):
    log = make_log([start(1000), added("1", 1000), removed("1", 2000), task(1, 0, 3000), end(5000)])
    assert row(summary.app_summary(log))["Avg Idle Cores (%)"] == -200.0


def test_alternate_capacity_uses_own_cores_and_restarts(make_log):
    log = make_log([start(1000), added("driver", 1000, 2), added("1", 1000, 4), removed("1", 2000), added("1", 5000, 3), end(11000)])
    lives = {r.executor_id: (r.start_ms, r.end_ms, r.cores) for r in lifecycle.executor_lifetimes_by_cores(log).collect()}
    assert lives == {"driver": (1000, 11000, 2), "1": (5000, 11000, 3)}


def test_preemption_follows_log_order(make_log):
    gone = removed("1", 5, Reason="Container PREEMPTED")
    log = make_log([task(1, reason="ExceptionFailure"), gone, task(1, reason="ExceptionFailure"), task(1), task(2, executor="2", reason="ExceptionFailure"), gone])
    assert row(lifecycle.preempted_tasks(log))["preempted_tasks"] == 1
    assert row(lifecycle.preempted_executors(log))["preempted_executors"] == 2
    told = task(1)
    told["Task End Reason"] = {"Reason": "TaskKilled", "Kill Reason": "was Preempted"}
    assert row(lifecycle.preempted_tasks(make_log([told])))["preempted_tasks"] == 1


def test_largest_stage_ties_and_zero(make_log):
    log = make_log([job(0, [7, 3]), task(7, remote=5), task(3, remote=5), task(9, metrics=False)])
    got = row(tasks.max_stages(log))
    assert (got["max_shuffle_read"], got["max_shuffle_read_stage_id"]) == (5, 7)
    assert (got["max_spill_memory"], got["max_spill_memory_stage_id"]) == (0, 7)
    assert tasks.max_positive_stages(log).count() == 0


def test_stage_moves_to_last_job(make_log):
    log = make_log([job(0, [1, 2]), job(1, [2, 3]), task(1, remote=1), task(2, remote=10), task(3, remote=100)])
    assert {r.job_id: r.shuffle_read for r in tasks.job_shuffle(log).collect()} == {0: 1, 1: 110}


def test_task_without_metrics(make_log):
    empty = task(4, 0, 1000, heap=9)
    empty["Task Metrics"] = {}
    log = make_log([task(4, 0, 500, heap=7, metrics=False), empty, task(4, 0, 1, heap=3, read=2)])
    got = row(tasks.task_totals(log))
    assert (got["tasks"], got["task_ms"], got["input_bytes"]) == (3, 1501, 2)
    assert row(lifecycle.peak_heap(log))["peak_heap"] == 3
    assert row(alt.alt_profile(log))["peak_heap"] == 9


def test_heap_sources(make_log):
    events = [
        {"Event": "SparkListenerExecutorMetricsUpdate", "Executor Metrics": {"JVMHeapMemory": 5}, "executorsUpdates": {"1": {"JVMHeapMemory": 50}}},
        {"Event": "SparkListenerExecutorMetricsUpdate", "executorsUpdates": {"1": {"JVMHeapMemory": 7}, "2": {"JVMHeapMemory": 8}}},
        {"Event": "SparkListenerExecutorMetricsUpdate", "Executor Metrics Updated": [{"Stage ID": 1, "Executor Metrics": {"JVMHeapMemory": 20}}]},
        {"Event": "SparkListenerStageExecutorMetrics", "Executor Metrics": {"JVMHeapMemory": 30}},
    ]
    assert row(lifecycle.peak_heap(make_log(events)))["peak_heap"] == 8
    assert row(lifecycle.peak_heap(make_log(events), modern_heap=True))["peak_heap"] == 30


def test_execution_is_looked_up_in_order(make_log):
    log = make_log([task(5, 0, 9), job(0, [5], 1), task(5, 0, 1), job(1, [5], 2), job(2, [5]), task(5, 0, 2), task(6)])
    assert {(r.execution_id, r.duration_ms) for r in flows.task_execution(log).collect()} == {(1, 1), (2, 2)}


def test_first_scan_takes_task_input(make_log):
    plan = node("Union", children=[scan(), scan(16, 17, 18, "hdfs://nn/b")])
    log = make_log([sql(1, plan), job(0, [1], 1), task(1, read=100, rows=3)])
    got = row(flows.read_metrics(log))
    assert (got["node_pos"], got["bytes_read"], got["rows"], got["files_read"], got["average_file_size"]) == (1, 100, 3, 1, 100)
    assert (got["file_path"], got["format"], got["partition_filters"]) == ("hdfs://nn/in", "Parquet", "None")


def test_tasks_before_the_plan_do_not_count(make_log):
    log = make_log([job(0, [1], 1), task(1, read=7, rows=1), sql(1, scan()), task(1, read=100, rows=3)])
    assert row(flows.read_metrics(log))["bytes_read"] == 100


def test_reused_scan_counts_once(make_log):
    plan = node("Join", children=[scan(), node("ReusedExchange", children=[scan()])])
    log = make_log([sql(1, plan), updates(1, (6, 2), (7, 50), (8, 5))])
    got = row(flows.read_metrics(log))
    assert (got["files_read"], got["bytes_read"], got["rows"]) == (2, 50, 5)


def test_driver_updates_last_wins_after_plan(make_log):
    log = make_log([updates(1, (6, 9)), sql(1, scan()), updates(1, (6, 1), (6, 3)), updates(2, (7, 40)), updates(1, [8])])
    got = row(flows.read_metrics(log))
    assert (got["files_read"], got["bytes_read"]) == (3, 40)
    per_execution = tree.node_driver_metrics(tree.plan_nodes(log), tree.driver_values(log, True), ["app_key", "execution_id", "pos"])
    assert [(r.metric, r.value) for r in per_execution.collect()] == [("number of files read", 3)]


def test_write_metrics_and_totals(make_log):
    text = "Execute InsertIntoHadoopFsRelationCommand hdfs://nn/out, false, Parquet, [path=x], Overwrite, [c]"
    write = node("Execute InsertIntoHadoopFsRelationCommand", text,
                 [("number of written files", 1), ("written output", 2), ("number of output rows", 3)], [scan()])
    log = make_log([start(), sql(1, write), job(0, [1], 1), task(1, written=30, out_rows=3), task(1, written=31, out_rows=3), task(1, out_rows=1), updates(1, (1, 1), (3, 100))])
    got = row(flows.write_metrics(log))
    assert (got["files_written"], got["rows"], got["bytes_written"], got["average_file_size"]) == (2, 100, 61, 30)
    assert (got["file_path"], got["format"], got["mode"]) == ("hdfs://nn/out", "Parquet", "Overwrite")
    whole = row(summary.app_summary(log))
    assert (whole["Write Partitions (Files)"], whole["Total Output Rows"], whole["Write File Avg Size"]) == (2, 100, 30)


def test_accumulators(make_log):
    t = task(1)
    t["Task Info"]["Accumulables"] = [{"ID": 1, "Update": "5"}, {"ID": 2, "Update": 9}, {"ID": 3, "Update": "1.5"}, {"ID": "x", "Update": "1"}, {"ID": 4}]
    log = make_log([t, t, updates(1, (1, 7), (9, -2))])
    assert {r.acc_id: r.value for r in tree.accumulator_rollup(log).collect()} == {1: 10.0, 2: 0.0, 3: 3.0, 4: 0.0, 9: 0.0}


def test_stage_detail(make_log):
    submitted = {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 1, "Stage Name": "s", "Submission Time": 1000}, "Properties": None}
    described = {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 2, "Stage Name": "s"}, "Properties": {"spark.job.description": "d", "callSite.short": "c"}}
    completed = {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Completion Time": 3500, "Failure Reason": "x"}}
    retried = {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Completion Time": 4500}}
    log = make_log([submitted, described, completed, task(1, read=5), task(1, read=6), task(3), retried])
    got = {r.stage_id: r for r in detail.stage_detail(log).collect()}
    assert (got[1].status, got[1].description, got[1].duration_sec, got[1].tasks, got[1].average_input) == ("Completed", "s", 3.5, 2, 5)
    assert (got[2].status, got[2].description, got[2].completion_time) == ("Running", "d", 0)
    assert (got[3].status, got[3].stage_name, got[3].description) == (None, None, "")


def test_sql_executions(make_log):
    log = make_log([job(9, [1], 1), sql(1, node("A", children=[node("B")]), time=5), job(0, [1], 1), job(1, [2], 1)])
    got = row(detail.sql_executions(log))
    assert (got["jobs"], got["first_job"], got["last_job"], got["plan_root"], got["plan_nodes"]) == (2, 0, 1, "A", 2)
    assert json.loads(got["plan"]) == node("A", children=[node("B")])


def test_plan_nodes_of_any_shape(make_log):
    """Pre-order and post-order of a wide and deep tree, names listed twice, missing fields, plans that are none."""
    tree_of = lambda depth, tag: node(tag, f"t{tag}", [("m", depth), ("m", depth + 1), ("k", 7)], [
        tree_of(depth - 1, f"{tag}.{i}") for i in range(3 if depth % 2 else 11)] if depth else [])
    plan = tree_of(3, "r")
    wanted, done = [], iter(range(10**6))

    def walk(n, path):
        at = len(wanted)
        wanted.append(None)
        for i, child in enumerate(n["children"]):
            walk(child, [*path, i])
        wanted[at] = (at, next(done), len(path), path, n["nodeName"])

    walk(plan, [])
    odd = [sql(i, p) for i, p in enumerate(["text", [1], 5, None, {}, {"children": None, "metrics": None, "metadata": None}], 10)]
    nodes = tree.plan_nodes(make_log([sql(1, plan), *odd])).orderBy("execution_id", "pos").collect()
    got = [(r.pos, r.post_pos, r.depth, r.path, r.node_name) for r in nodes if r.execution_id == 1]
    assert got == wanted and len(got) > 130
    assert nodes[0].metrics == {"m": 4, "k": 7} and nodes[0].simple_string == "tr"
    rest = [(r.execution_id, r.pos, r.post_pos, r.node_name, r.simple_string, r.metrics) for r in nodes if r.execution_id != 1]
    assert rest == [(14, 0, 0, "Unknown", "", {}), (15, 0, 0, "Unknown", "", {})]


def test_operation_list(make_log):
    filt = node("Filter", "Filter (a > 1)", [("number of output rows", 5)], [scan()])
    exchange = node("Exchange", "Exchange hashpartitioning(a, 4), ENSURE_REQUIREMENTS", [("shuffle bytes written", 20), ("shuffle write time", 21)],
                    [node("Project", "Project [a]", (), [node("Project", "Project [a]", (), [filt])])])
    plan = node("AdaptiveSparkPlan", children=[node("WholeStageCodegen (1)", children=[exchange])])
    blocks = {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Accumulables": [
        {"ID": 8, "Name": "number of output rows", "Value": "100"}, {"ID": 99, "Name": "number of output rows", "Value": 40},
        {"ID": 98, "Name": "number of output rows", "Value": 30}, {"ID": 20, "Name": "shuffle records written", "Value": "40"}]}}
    ended = {"Event": f"{UI}SparkListenerSQLExecutionEnd", "executionId": 1, "time": 2500}
    log = make_log([sql(1, plan, time=1000), sql(2, scan()), job(0, [1], 1), blocks, updates(1, (21, 1500000000), (20, 64)), ended])
    got = operations.operation_list(log).orderBy("position").collect()
    assert [r.operation for r in got] == ["Read Parquet", "Filter", "Select", "Shuffle"]  # execution 2 shares the description
    assert got[1].output_rows == 30  # 40 is the shuffle's
    assert (got[3].num_partitions, got[3].shuffle_bytes, got[3].operation_sec, got[3].duration_sec) == ("4", 64, 1.5, 1.5)
    plain = operations.operation_list(log, full_shuffle=False).filter("operation = 'Shuffle'").first()
    assert (plain.num_partitions, plain.shuffle_bytes, plain.operation_sec) == (None, None, 1500000.0)


def test_steps_are_dealt_out_once(make_log):
    """What is found for nodes is added without dealing the nodes out by their signatures; of several rows all are kept."""
    log = make_log([sql(1, node("Filter", "Filter (a > 1)", [("number of output rows", 5)], [scan()])), updates(1, (6, 3))])
    plan = operations.operation_list(log)._jdf.queryExecution().executedPlan().toString()
    assert "signature" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    nodes = tree.plan_nodes(log).withColumn("signature", tree.node_signature())
    of_scan = nodes.filter("pos = 1").select(*operations.NODE)
    twice = of_scan.selectExpr("*", "1 as n").unionByName(of_scan.selectExpr("*", "2 as n"))
    got = operations._add(nodes, twice, several=True).select("pos", "n").collect()
    assert sorted(map(tuple, got), key=str) == [(0, None), (1, 1), (1, 2)]


def test_results_of_many_parts_are_stored(make_log):
    """No part of a summary or of detail documents is shuffled by what reads them."""
    log = make_log([start(), added("1", 2000), sql(1, node("W", "", [("number of written files", 1)], [scan()])), job(0, [1], 1), task(1, read=5), end(9000)])
    for df in (summary.app_summary(log), detail.detail_documents(log)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_deep_plan_is_whole(make_log):
    plan = node("Scan x")
    for _ in range(150):
        plan = node("Project", children=[plan])
    nodes = tree.plan_nodes(make_log([sql(1, plan)]))
    deepest = nodes.orderBy("pos", ascending=False).first()
    assert (nodes.count(), deepest.depth, deepest.post_pos, deepest.node_name) == (151, 150, 0, "Scan x")


def test_adaptive_plan_option(make_log):
    update = {"Event": f"{UI}SparkListenerSQLAdaptiveExecutionUpdate", "executionId": 1, "sparkPlanInfo": node("New")}
    log = make_log([sql(1, node("Old")), sql(2, node("Kept")), update])
    assert {r.node_name for r in tree.plan_nodes(log).collect()} == {"Old", "Kept"}
    assert {r.node_name for r in tree.plan_nodes(log, adaptive=True).collect()} == {"New", "Kept"}


def test_plan_text_paths(make_log):
    text = "Scan parquet \n Location: InMemoryFileIndex [hdfs://nn/a]\nScan orc\n x Location: s3://b/c,\nWrite Location: file:///out)\nScan csv Location: s3a://z"
    event = {"Event": f"{UI}SparkListenerSQLExecutionStart", "executionId": 1, "physicalPlanDescription": text}
    got = {(r.direction, r.format, r.path) for r in flows.plan_text_paths(make_log([event, event])).collect()}
    assert got == {("input", "parquet", "hdfs://nn/a"), ("input", "orc", "s3://b/c"),
                   ("output", "Output", "hdfs://nn/a"), ("output", "Output", "s3://b/c"), ("output", "Output", "file:///out")}
    more = flows.plan_text_paths(make_log([event]), more_schemes=True)
    assert more.filter("path = 's3a://z' and direction = 'input'").count() == 1


def test_renaming(make_log):
    log = make_log([start(**{"App Name": "x"}), '{"n":"old-2024-01-02-z"}', '{"n":"old-2025-05-05-z old-2024-01-02-z"}'])
    got = [r.value for r in report.renamed_log_lines(log.lines, r"(old-(\d{4}-\d{2}-\d{2})-z)").orderBy("seq").collect()]
    assert got[1:] == ['{"n":"my-spark-job-2024-01-02"}', '{"n":"old-2025-05-05-z my-spark-job-2024-01-02"}']


def test_detail_documents(spark, make_log, tmp_path):
    """Each application's entries, also of one that is written by several tasks, are one JSON document in its files' order."""
    events, apps = [], []
    for app, n in (("big", 400), ("small", 2)):
        command = "Execute InsertIntoHadoopFsRelationCommand"
        write = node(command, f"{command} hdfs://o, false, Parquet, [path=x], Overwrite, [c]", [("number of written files", 1)], [scan()])
        of_app = [start(), added("1", 2000), sql(1, write), *[job(i, [i], 1) for i in range(n)], updates(1, (6, 3), (1, 2)), *[task(i, read=5) for i in range(n)]]
        events += of_app
        apps += [app] * len(of_app)
    documents = detail.detail_documents(make_log(events, apps))
    detail.write_documents(documents, f"file://{tmp_path}/detail")
    for app, n in (("big", 400), ("small", 2)):
        files = sorted((tmp_path / "detail" / f"app_key={app}").glob("part-*"))
        assert app != "big" or len(files) > 1
        whole = json.loads("".join(f.read_text() for f in files))
        assert list(whole) == list(detail.PARTS)
        assert [j["job_id"] for j in whole["jobs"]] == [s["stage_id"] for s in whole["stages"]] == list(range(n))
        assert whole["stages"][0]["input_bytes"] == 5 and whole["reads"][0]["files_read"] == 3 and whole["writes"][0]["mode"] == "Overwrite"
        assert [p["node_name"] for p in whole["planNodes"]] == [command, "Scan parquet "]
        assert whole["sqlExecutions"][0]["plan"]["children"][0]["nodeName"] == "Scan parquet "
        assert whole["executorTimeSeries"][-1] == {"time": 2000, "seconds": 1.0, "count": 1}


def test_totals_do_not_depend_on_partitions(spark, make_log):
    events = [start()] + [task(i % 5, 0, i, remote=i, spill=i % 3) for i in range(200)] + [end(9000)]
    log = make_log(events)
    shuffled = type(log)(log.lines.repartition(7, "value"))
    assert row(summary.app_summary(log)) == row(summary.app_summary(shuffled))
    stages = tasks.stage_totals(log)
    assert stages.groupBy().sum("shuffle_read").first()[0] == row(tasks.task_totals(log))["shuffle_read"]


def spilled(stage, memory=0, disk=0):
    event = task(stage)
    event["Task Metrics"] = {"Executor Run Time": 1, "Memory Bytes Spilled": memory, "Disk Bytes Spilled": disk}
    return event


def test_of_equal_spills_the_first_to_spill_counts(make_log):
    """Stage 1 has the first task, stage 2 the first spill; both spill the same in the end."""
    log = make_log([spilled(1), spilled(2, 50, 9), spilled(1, 50, 9)])
    got = row(tasks.max_positive_stages(log))
    assert (got["max_spill_memory_stage_id"], got["max_spill_disk_stage_id"]) == (2, 2)
    assert row(tasks.max_stages(log))["max_spill_memory_stage_id"] == 1  # the summary goes by the first task


def test_one_stage_holds_nearly_all_tasks(make_log):
    events = [job(0, [5, 6], 1), *[task(5, 0, i) for i in range(180)], job(1, [5], 2), *[task(5, 0, 1000 + i) for i in range(180)], task(6, 0, 1)]
    got = flows.task_execution(make_log(events)).collect()
    assert len(got) == 361 and all(r.execution_id == (2 if r.duration_ms >= 1000 else 1) for r in got)


def test_one_log_holds_nearly_all_lines(spark, make_log):
    lines = [f"spark-app-1 of job-2024-01-02 line {i}" for i in range(300)] + ["job-2023-05-06", "no name"]
    log = make_log(lines, ["big"] * 300 + ["small", "none"])
    got = report.renamed_log_lines(log.lines, r"(job-(\d{4}-\d{2}-\d{2}))").collect()
    assert len(got) == 301 and all((r.new_name in r.value) and ("job-2024" not in r.value.replace(r.new_name, "")) for r in got)


def test_report_sinks(spark, make_log, tmp_path):
    log = make_log([start(1000), task(1, 1, 2), end(5000)])
    profile, paths = alt.alt_profile(log), flows.plan_text_paths(log)
    document = report.report_document(profile, paths)
    report.write_report(document, f"file://{tmp_path}/report")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").rglob("part-*")))
    assert text.count("\n") >= document.count() and text.rstrip().split("\n")[-1].startswith("application_1\tjob\t4.00")
    renamed = report.renamed_log_lines(make_log(["job-2024-01-02 a", "b of job-2024-01-02"]).lines, r"(job-(\d{4}-\d{2}-\d{2}))")
    report.write_renamed_logs(renamed, f"file://{tmp_path}/logs")
    written = "".join(p.read_text() for p in sorted((tmp_path / "logs" / "app_key=a").glob("part-*")))
    assert written == "my-spark-job-2024-01-02 a\nb of my-spark-job-2024-01-02\n"
    results = summary.app_summary(make_log([start(1000), start(2)], ["a", "b"]))
    summary.write_csv(results.withColumn("Application ID", results["app_key"]), f"file://{tmp_path}/results")
    counts = report.rewrite_without(spark, f"file://{tmp_path}/results", spark.createDataFrame([("a",)], "`Application ID` string"), f"file://{tmp_path}/after")
    assert tuple(counts.first()) == (1, 1)
    assert [r["Application ID"] for r in summary.read_csv(spark, f"file://{tmp_path}/after").collect()] == ["b"]


def test_levels_decoded_at_once_and_below_are_alike(make_log):
    """Trees that end above, at and below the levels decoded at once; malformed children and metrics on either side."""
    for depth in (tree.LEVELS - 1, tree.LEVELS, tree.LEVELS + 1, 2 * tree.LEVELS + 1):
        plan = {"nodeName": "last", "metadata": {"k": "v"}, "children": "none", "metrics": [
            {"name": "m", "accumulatorId": 1}, {"name": "m", "accumulatorId": 2}, {"accumulatorId": 3}]}
        for _ in range(depth - 1):
            plan = {"nodeName": "inner", "children": [7, plan]}
        nodes = sorted(tree.plan_nodes(make_log([sql(1, plan)])).collect(), key=lambda r: r.pos)
        assert len(nodes) == 2 * depth - 1
        assert [n.node_name for n in nodes] == ["inner"] + ["Unknown", "inner"] * (depth - 2) + ["Unknown", "last"]
        assert nodes[-1].path == [1] * (depth - 1) and nodes[-1].depth == depth - 1
        assert (nodes[-1].metadata, nodes[-1].metrics) == ({"k": "v"}, {"m": 2})
        assert nodes[0].post_pos == 2 * depth - 2


def test_the_plan_of_the_last_start_counts(make_log):
    """Also if it came with the last event only; an execution whose last start has no plan has none."""
    log = make_log([sql(1, node("Old")), sql(2, node("Other")), sql(1, node("New")), sql(3, node("Gone")), sql(3, [1])])
    assert sorted((r.execution_id, r.node_name) for r in tree.plan_nodes(log).collect()) == [(1, "New"), (2, "Other")]
