"""Event logs written from the star-schema tables, line by line as JSON.

Each log is what a cluster would have logged if every customer were an application, every order a job and every
line item a task (`application_log`), or if every user were an application with executors coming and going
(`activity_log`). The lines go through the same views as lines read from files. Line order is a decimal of
(phase, epoch time, id).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.ordering import times_cleared
from eventlens.sources.events import SQL_UI, VIEWS, EventLog
from eventlens.sources.files import state_of

PHASES = {
    "app_start": 0, "environment": 1, "executors": 2, "sql_start": 3, "job_start": 4, "stage_submitted": 5,
    "driver_updates": 6, "tasks": 7, "stage_completed": 8, "sql_end": 9, "app_end": 10,
}
ACCS = 20  # accumulator ids per execution
RERUN = 1_000_000_000_000  # offset of the ids of re-listed executions and jobs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def position(phase: str, time: Column, tie: Column | None = None) -> Column:
    """Order of a line: phase, then time, then id."""
    high = F.lit(PHASES[phase] << 53).cast("bigint") + time
    low = F.lit(0).cast("bigint") if tie is None else tie.cast("bigint")
    return (
        high.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    ).cast("decimal(38,0)")


def _lines(df: DataFrame, key: str, seq: Column, event: str, **fields: Column) -> DataFrame:
    body = F.to_json(F.struct(F.lit(event).alias("Event"), *[c.alias(n) for n, c in fields.items()]))
    return df.select(
        F.concat(F.lit("application_"), F.col(key)).alias("app_key"), seq.alias("seq"), body.alias("value"),
        F.lit(event).alias("event"),
    )


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _named(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Star:
    """The tables and their joins, each built once per log."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as SQL executions differ in what they write, how, and in the class that reads their input."""
        one_of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
        return self.table("orders").repartition("o_orderkey").withColumns({
            "start_ms": millis("o_orderdate"),
            "o_mode": one_of("Overwrite", "Append", "ErrorIfExists", "Ignore"),
            "o_written": one_of("Parquet", "ORC", "CSV", "JSON", "Text"),
            "o_reader": one_of("Parquet", "x.OrcFileFormat", "x.BinaryFileFormat", "x.JsonFileFormat", "x.CsvFileFormat", "Avro", "x.ParquetFileFormat"),
        })

    @cached_property
    def lineitem(self) -> DataFrame:
        """Dealt out by order, as the joins and groups below need it; a table stored as one split gets to all cores."""
        return self.table("lineitem").repartition("l_orderkey")

    @cached_property
    def items(self) -> DataFrame:
        """Line items with their order: one row per task."""
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({
            "stage_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
            "launch_ms": F.col("start_ms") + F.col("l_linenumber") * 60000,
            "quantity": F.col("l_quantity").cast("bigint"),
        })

    @cached_property
    def stages(self) -> DataFrame:
        columns = ["o_custkey", "o_orderkey", "l_linenumber", "o_orderpriority", "start_ms", "launch_ms", "stage_id"]
        return self.items.select(*columns).distinct()

    @cached_property
    def apps(self) -> DataFrame:
        spans = self.orders.groupBy("o_custkey").agg(
            F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"),
            F.min(F.to_date("o_orderdate")).alias("first_day"),
        )
        return spans.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def executors(self) -> DataFrame:
        """An order adds an executor; an order with status F removes it after some hours."""
        number = F.col("o_orderkey") % 4
        return self.orders.withColumns({
            "executor": F.when(number == 0, "driver").otherwise(number.cast("string")),
            "gone_ms": F.col("start_ms") + (F.col("o_orderkey") % 48) * 3600000,
        })


def _app_start(star: Star) -> DataFrame:
    return _lines(
        star.apps, "o_custkey", position("app_start", F.col("first_ms")), "SparkListenerApplicationStart",
        **{
            "App ID": F.concat(F.lit("application_"), F.col("o_custkey")),
            "App Name": F.concat(F.col("c_name"), F.lit("-"), F.col("first_day").cast("string")),
            "Timestamp": F.col("first_ms"),
        },
    )


def _app_end(star: Star) -> DataFrame:
    end = F.col("last_ms") + 86400000
    return _lines(
        star.apps, "o_custkey", position("app_end", end), "SparkListenerApplicationEnd", Timestamp=end
    )


def _environment(star: Star) -> DataFrame:
    # 3 of 4 applications set their overhead to the default
    settings = F.struct(
        F.concat(F.col("c_nationkey") % 8 + 1, F.lit("g")).alias("spark.executor.memory"),
        (F.col("c_nationkey") % 4 + 1).cast("string").alias("spark.executor.cores"),
        F.concat(F.col("c_custkey") % 4 + 1, F.lit(".5g")).alias("spark.driver.memory"),
        F.lit("2").alias("spark.driver.cores"),
        (F.col("c_custkey") % 10).cast("string").alias("spark.executor.instances"),
        F.when(F.col("c_mktsegment") == "BUILDING", "true").otherwise("false").alias("spark.dynamicAllocation.enabled"),
        (F.col("c_custkey") % 20).cast("string").alias("spark.dynamicAllocation.maxExecutors"),
        F.when(F.col("c_custkey") % 3 == 0, "512m").alias("spark.executor.memoryOverhead"),
    )
    return _lines(
        star.apps, "o_custkey", position("environment", F.col("first_ms")), "SparkListenerEnvironmentUpdate",
        **{"Spark Properties": settings},
    )


def _executor_added(star: Star) -> DataFrame:
    return _lines(
        star.executors, "o_custkey", position("executors", F.col("start_ms"), F.col("o_orderkey") * 2),
        "SparkListenerExecutorAdded",
        **{
            "Timestamp": F.col("start_ms"),
            "Executor ID": F.col("executor"),
            "Executor Info": _named({"Host": F.lit("node"), "Total Cores": (F.col("o_orderkey") % 3 + 1).cast("int")}),
        },
    )


def _executor_removed(star: Star) -> DataFrame:
    return _lines(
        star.executors.filter("o_orderstatus = 'F'"), "o_custkey",
        position("executors", F.col("gone_ms"), F.col("o_orderkey") * 2 + 1), "SparkListenerExecutorRemoved",
        **{
            "Timestamp": F.col("gone_ms"),
            "Executor ID": F.col("executor"),
            "Removed Reason": F.when(F.col("o_orderkey") % 7 == 0, "Container was PREEMPTED.").otherwise("idle"),
        },
    )


def _job_start(star: Star) -> DataFrame:
    # at most seven line numbers per order
    stages = star.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("numbers"))
    orders = star.orders.join(stages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ids = F.transform(F.array_sort(F.coalesce("numbers", F.array().cast("array<int>"))), lambda n: F.col("o_orderkey") * 10 + n)
    properties = F.struct(
        F.col("o_orderkey").cast("string").alias("spark.sql.execution.id"),
        F.lit("default").alias("spark.scheduler.pool"),
    )
    return _lines(
        orders, "o_custkey", position("job_start", F.col("start_ms"), F.col("o_orderkey")), "SparkListenerJobStart",
        **{"Job ID": F.col("o_orderkey"), "Submission Time": F.col("start_ms"), "Stage IDs": ids, "Properties": properties},
    )


def _job_reruns(star: Star) -> DataFrame:
    """A second job lists every even-numbered stage of a SQL execution again, in the middle of its tasks."""
    again = (
        star.items.filter("l_linenumber % 2 = 0")
        .select("o_custkey", "o_orderkey", "stage_id", "launch_ms").distinct()
    )
    return _lines(
        again, "o_custkey", position("tasks", F.col("launch_ms") + 25500, F.col("stage_id")), "SparkListenerJobStart",
        **{
            "Job ID": F.col("stage_id") + RERUN,
            "Stage IDs": F.array("stage_id"),
            "Properties": F.struct((F.col("o_orderkey") + RERUN).cast("string").alias("spark.sql.execution.id")),
        },
    )


def _stage_submitted(star: Star) -> DataFrame:
    number = F.col("l_linenumber")
    return _lines(
        star.stages, "o_custkey", position("stage_submitted", F.col("start_ms"), F.col("stage_id")),
        "SparkListenerStageSubmitted",
        **{
            "Stage Info": _named({
                "Stage ID": F.col("stage_id"), "Stage Name": F.concat(F.lit("stage "), number), "Submission Time": F.col("start_ms"),
            }),
            "Properties": F.struct(
                F.when(number % 3 == 0, F.col("o_orderpriority")).alias("spark.job.description"),
                F.when(number % 2 == 0, F.concat(F.lit("call at "), number)).alias("callSite.short"),
            ),
        },
    )


def _stage_completed(star: Star) -> DataFrame:
    key, number = F.col("o_orderkey"), F.col("l_linenumber")
    acc = lambda k: key * ACCS + k
    counter = lambda k, name, value: _struct(ID=acc(k), Name=F.lit(name), Value=value)
    counters = F.array(
        counter(8, "number of output rows", (key % 900 + number * 10).cast("string")),
        counter(5, "number of output rows", (key % 500).cast("string")),
        counter(16, "number of output rows", (key % 77).cast("string")),
        counter(10, "shuffle records written", (key % 50).cast("string")),
    )
    return _lines(
        star.stages, "o_custkey", position("stage_completed", F.col("launch_ms"), F.col("stage_id")),
        "SparkListenerStageCompleted",
        **{
            "Stage Info": _named({
                "Stage ID": F.col("stage_id"), "Completion Time": F.col("launch_ms"),
                "Failure Reason": F.when(number == 7, "Job aborted"), "Accumulables": counters,
            }),
        },
    )


def _task_end(star: Star) -> DataFrame:
    items = star.items.withColumn("finish_ms", F.col("launch_ms") + F.col("quantity") * 1000)
    quantity, flag, status = F.col("quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    spilled = F.when(flag == "R", quantity * 65536).otherwise(F.lit(0).cast("bigint"))
    written = F.when(status == "F", F.col("l_partkey") * 1000).otherwise(F.lit(0).cast("bigint"))
    metrics = _named({
        "Executor Run Time": quantity * 1000,
        "Memory Bytes Spilled": spilled,
        "Disk Bytes Spilled": F.floor(spilled / 4),
        "Input Metrics": _named({"Bytes Read": F.round(F.col("l_extendedprice") * 100).cast("bigint"), "Records Read": quantity}),
        "Output Metrics": _named({"Bytes Written": written, "Records Written": F.when(status == "F", quantity).otherwise(F.lit(0).cast("bigint"))}),
        "Shuffle Read Metrics": _named({"Remote Bytes Read": F.col("l_suppkey") * 1024, "Local Bytes Read": F.col("l_partkey") * 64}),
        "Shuffle Write Metrics": _named({"Shuffle Bytes Written": quantity * 4096}),
    })
    lost = (flag == "R") & (status == "O")
    failed = (flag == "N") & (F.col("l_linenumber") == 6)
    reason = F.struct(
        F.when(lost, "ExecutorLostFailure").when(failed, "ExceptionFailure").otherwise("Success").alias("Reason"),
        F.when(lost, "Container was preempted.").alias("Loss Reason"),
    )
    acc = F.col("o_orderkey") * ACCS
    update = lambda k, value: _struct(ID=acc + k, Name=F.lit("number of output rows"), Update=value)
    # one array of objects of unlike types, as in a real log: SQL updates are quoted, internal ones are not
    accumulables = F.concat(
        F.lit("["), F.to_json(update(5, quantity.cast("string"))), F.lit(","), F.to_json(update(17, quantity)), F.lit("]")
    )
    info = _named({
        "Launch Time": F.col("launch_ms"), "Finish Time": F.col("finish_ms"),
        "Executor ID": (F.col("l_suppkey") % 3 + 1).cast("string"),
        "Accumulables": F.lit("@ACCUMULABLES@"),
    })
    body = F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("stage_id").alias("Stage ID"),
        F.lit("ResultTask").alias("Task Type"),
        reason.alias("Task End Reason"),
        info.alias("Task Info"),
        F.struct((F.col("l_partkey") * 1000000).alias("JVMHeapMemory")).alias("Task Executor Metrics"),
        F.when(~((flag == "A") & (F.col("l_suppkey") % 5 == 0)), metrics).alias("Task Metrics"),
    ))
    return items.select(
        F.concat(F.lit("application_"), F.col("o_custkey")).alias("app_key"),
        position("tasks", F.col("finish_ms"), F.col("stage_id")).alias("seq"),
        F.replace(body, F.lit('"@ACCUMULABLES@"'), accumulables).alias("value"),
        F.lit("SparkListenerTaskEnd").alias("event"),
    )


def _plan(two_scans: bool) -> str:
    """SQL text of a plan: write <- adaptive <- codegen <- aggregate <- exchange <- coalesce <- project <- filter <- scan(s).

    The plan is written as JSON with `{sql}` where a value depends on the row.
    """

    def node(name: str, text: str, children: list[dict], metrics: dict[str, int], metadata: dict | None = None) -> dict:
        listed = [
            {"name": metric, "accumulatorId": f"{{o_orderkey * {ACCS} + {k}}}", "metricType": "sum"}
            for metric, k in metrics.items()
        ]
        return {"nodeName": name, "simpleString": text, "children": children, "metadata": metadata or {}, "metrics": listed}

    plan = node(
        "Scan parquet ", "FileScan parquet", [],
        {"number of files read": 6, "size of files read": 7, "number of output rows": 8, "metadata time": 12,
         "number of partitions read": 13},
        {"Location": "InMemoryFileIndex(1 paths)[hdfs://nn/in/{o_orderstatus}]", "Format": "{o_reader}", "PartitionFilters": "[]"},
    )
    if two_scans:
        other = node(
            "Scan orc ", "FileScan orc", [],
            {"number of files read": 14, "size of files read": 15, "number of output rows": 16},
            {"Location": "InMemoryFileIndex(1 paths)[hdfs://nn/more]", "Format": "org.apache.OrcFileFormat",
             "PartitionFilters": "[isnotnull(p#1)]"},
        )
        plan = node("Union", "Union", [plan, other], {})
    steps = [
        ("Filter", "Filter (o_totalprice#3 > 100.0)", {"number of output rows": 5}),
        ("Project", "Project [o_orderkey#1, o_orderstatus#2]", {}),
        ("Coalesce", "Coalesce 4", {}),
        ("Exchange", "Exchange hashpartitioning(o_orderstatus#1, {o_orderkey % 7 + 1}), ENSURE_REQUIREMENTS, [plan_id=1]",
         {"shuffle bytes written": 4, "shuffle records written": 10, "shuffle write time": 11}),
        ("HashAggregate", "HashAggregate(keys=[o_orderstatus#1], functions=[])", {"time in aggregation build": 3}),
        ("WholeStageCodegen (2)", "WholeStageCodegen (2)", {}),
        ("AdaptiveSparkPlan", "AdaptiveSparkPlan isFinalPlan=false", {}),
        ("Execute InsertIntoHadoopFsRelationCommand",
         "Execute InsertIntoHadoopFsRelationCommand hdfs://nn/out/{o_orderpriority}, false, {o_written}, [path=x], {o_mode}, [c]",
         {"number of written files": 0, "written output": 1, "number of output rows": 2, "task commit time": 9}),
    ]
    for name, text, metrics in steps:
        plan = node(name, text, [plan], metrics)
    value = r"\{(o_[^{}]*)\}"
    text = json.dumps(plan, separators=(",", ":"))
    values = re.findall(value, text)
    text = re.sub(rf'(?<="accumulatorId":)"{value}"', "%s", text)  # ids are numbers
    text = re.sub(value, "%s", text)
    return f"format_string('{text}', {', '.join(values)})"


def _sql_start(star: Star) -> DataFrame:
    key, start = F.col("o_orderkey"), F.col("start_ms")
    event = f"{SQL_UI}SparkListenerSQLExecutionStart"
    plan_text = F.concat(
        F.lit("== Physical Plan ==\nExecute InsertIntoHadoopFsRelationCommand\n+- Scan parquet \n   Location: InMemoryFileIndex [hdfs://nn/in/"),
        F.col("o_orderstatus"), F.lit("]\n   Output\n   Location: hdfs://nn/out/"), F.substring("o_orderpriority", 1, 1), F.lit("\n"),
    )
    head = F.to_json(_struct(
        Event=F.lit(event), executionId=key, description=F.col("o_orderpriority"), time=start,
        physicalPlanDescription=plan_text,
    ))
    plan = F.expr(f"if(o_orderkey % 3 = 0, {_plan(True)}, {_plan(False)})")
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"sparkPlanInfo":'), plan, F.lit("}"))
    return star.orders.select(
        F.concat(F.lit("application_"), F.col("o_custkey")).alias("app_key"),
        position("sql_start", start, key).alias("seq"), body.alias("value"), F.lit(event).alias("event"),
    )


def _driver_updates(star: Star) -> DataFrame:
    ran = star.orders.filter("o_orderstatus != 'P'")
    key, start = F.col("o_orderkey"), F.col("start_ms")
    price = F.floor("o_totalprice").cast("bigint")
    pair = lambda k, value: F.array(key * ACCS + k, value.cast("bigint"))
    updates = F.array(
        pair(6, key % 4), pair(7, price), pair(12, key % 300), pair(13, F.lit(1)),
        pair(0, key % 3), pair(1, price * 2), pair(2, key % 100), pair(9, key % 700),
        pair(4, key % 1000 * 1024), pair(10, key % 50), pair(11, key % 9 * 250000000), pair(3, key % 11 * 100),
    )
    event = f"{SQL_UI}SparkListenerDriverAccumUpdates"
    early = F.array(pair(6, F.lit(999)), pair(0, F.lit(999)))  # values that a later update replaces
    return _lines(
        ran, "o_custkey", position("driver_updates", start, key * 2), event, executionId=key, accumUpdates=early
    ).unionByName(
        _lines(ran, "o_custkey", position("driver_updates", start, key * 2 + 1), event, executionId=key, accumUpdates=updates)
    )


def _sql_end(star: Star) -> DataFrame:
    key, start = F.col("o_orderkey"), F.col("start_ms")
    return _lines(
        star.orders, "o_custkey", position("sql_end", start, key),
        f"{SQL_UI}SparkListenerSQLExecutionEnd", executionId=key, time=start + key % 1000,
    )


_LOGS: dict[tuple, EventLog] = {}


def _log_once(spark: SparkSession, sf_dir: str, kind: str, tables: list[str], build: Callable[[], EventLog]) -> EventLog:
    """One log for all queries of a session on the same tables, so that these parse a view's lines once and share what
    several of them need. Tables that were replaced, and steps whose files were deleted, make it a new one."""
    state = state_of(spark, [f"{sf_dir}/{name}.parquet" for name in tables])
    key = (spark.sparkContext.applicationId, sf_dir, kind, times_cleared(), state)
    if key not in _LOGS:
        _LOGS[key] = build()
    return _LOGS[key]


def application_log(spark: SparkSession, sf_dir: str, reruns: bool = False) -> EventLog:
    """Customers as applications, orders as jobs, line items as tasks, every order also as a SQL execution. With `reruns`
    some stages are listed again by later jobs."""
    star = Star(spark, sf_dir)
    apps = star.orders.select(F.concat(F.lit("application_"), F.col("o_custkey")).alias("app_key"))
    once = EventLog(apps=apps, keep_views=True, parts={
        "SparkListenerApplicationStart": lambda: _app_start(star),
        "SparkListenerEnvironmentUpdate": lambda: _environment(star),
        "SparkListenerExecutorAdded": lambda: _executor_added(star),
        "SparkListenerExecutorRemoved": lambda: _executor_removed(star),
        f"{SQL_UI}SparkListenerSQLExecutionStart": lambda: _sql_start(star),
        "SparkListenerJobStart": lambda: _job_start(star),
        "SparkListenerStageSubmitted": lambda: _stage_submitted(star),
        f"{SQL_UI}SparkListenerDriverAccumUpdates": lambda: _driver_updates(star),
        "SparkListenerTaskEnd": lambda: _task_end(star),
        "SparkListenerStageCompleted": lambda: _stage_completed(star),
        f"{SQL_UI}SparkListenerSQLExecutionEnd": lambda: _sql_end(star),
        "SparkListenerApplicationEnd": lambda: _app_end(star),
    })
    tables = ["customer", "orders", "lineitem"]
    log = _log_once(spark, sf_dir, "application", tables, lambda: once)
    if not reruns:
        return log
    again = EventLog(apps=apps, keep_views=True, parts={"SparkListenerJobStart": lambda: _job_reruns(star)})

    def views(name: str) -> DataFrame:
        relisted = VIEWS[name].event == "SparkListenerJobStart"
        return log.view(name).unionByName(again.view(name)) if relisted else log.view(name)

    return _log_once(spark, sf_dir, "application with reruns", tables, lambda: EventLog(
        lambda: log.lines.unionByName(again.lines), apps=apps, views=views))


def activity_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """Users as applications: sign-ups add executors, errors remove them, purchases are tasks."""
    events = table(spark, sf_dir, "events").withColumn("ms", millis("ts")).withColumn(
        "us", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    event_id, value, ms = F.col("event_id"), F.col("value"), F.col("ms")
    at = position("tasks", F.col("us"), event_id)
    executor = (event_id % 5).cast("string")
    with_driver = F.when(event_id % 5 == 4, "driver").otherwise(executor)
    of = lambda kind: events.filter(F.col("event_type") == kind)
    users = events.groupBy("user_id").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    heap = F.floor(value * 1000000).cast("bigint")
    apps = events.select(F.concat(F.lit("application_"), F.col("user_id")).alias("app_key"))
    return _log_once(spark, sf_dir, "activity", ["events"], lambda: EventLog(apps=apps, keep_views=True, parts={
        "SparkListenerApplicationStart": lambda: _lines(
            users, "user_id", position("app_start", F.col("first_ms")), "SparkListenerApplicationStart",
            **{"App ID": F.concat(F.lit("application_"), F.col("user_id")), "App Name": F.concat(F.lit("user "), F.col("user_id")),
               "Timestamp": F.col("first_ms")}),
        "SparkListenerExecutorAdded": lambda: _lines(
            of("signup"), "user_id", at, "SparkListenerExecutorAdded",
            **{"Timestamp": ms, "Executor ID": with_driver,
               "Executor Info": F.struct((event_id % 4 + 1).cast("int").alias("Total Cores"))}),
        "SparkListenerExecutorRemoved": lambda: _lines(
            of("error"), "user_id", at, "SparkListenerExecutorRemoved",
            **{"Timestamp": ms, "Executor ID": with_driver,
               "Removed Reason": F.when(value > 100, "Executor was preempted").otherwise("gone")}),
        "SparkListenerTaskEnd": lambda: _lines(
            of("purchase"), "user_id", at, "SparkListenerTaskEnd",
            **{"Stage ID": event_id,
               "Task End Reason": F.struct(F.when(value > 100, "ExceptionFailure").otherwise("Success").alias("Reason")),
               "Task Info": _named({"Launch Time": ms, "Finish Time": ms + F.floor(value * 1000).cast("bigint"), "Executor ID": executor})}),
        "SparkListenerExecutorMetricsUpdate": lambda: _lines(
            of("click"), "user_id", at, "SparkListenerExecutorMetricsUpdate",
            **{"Executor Metrics": F.when(event_id % 2 == 0, F.struct(heap.alias("JVMHeapMemory"))),
               "executorsUpdates": F.when(event_id % 2 == 1, F.struct(F.struct(heap.alias("JVMHeapMemory")).alias("1")))}),
        "SparkListenerEnvironmentUpdate": lambda: _lines(
            of("view"), "user_id", at, "SparkListenerEnvironmentUpdate",
            **{"Spark Properties": F.struct(
                F.concat(event_id % 8 + 1, F.lit("g")).alias("spark.executor.memory"),
                (event_id % 4 + 1).cast("string").alias("spark.executor.cores"))}),
        "SparkListenerApplicationEnd": lambda: _lines(
            users, "user_id", position("app_end", F.col("last_ms")), "SparkListenerApplicationEnd", Timestamp=F.col("last_ms")),
    }))
