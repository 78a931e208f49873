"""Typed views over event-log lines.

A log is a DataFrame of lines:

    app_key string   the application (or file) the line belongs to
    seq              number that orders the lines of one application (bigint or decimal)
    value string     one JSON event
    event string     optional: the event's name, where the source knows it (a partition column of stored lines)

Each view parses only its own event type with a narrow schema. With the optional `event` column Spark prunes the
other types before reading them; without it a substring test skips most lines before the JSON is parsed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.ordering import checkpointed, storing

SQL_UI = "org.apache.spark.sql.execution.ui."


@dataclass(frozen=True)
class View:
    event: str
    ddl: str
    columns: dict[str, str]
    sql_ui: bool = False  # logged under a package name; matched by its ending


_ACCUMULABLES = "Accumulables:array<struct<ID:bigint,Name:string,Value:string>>"

VIEWS: dict[str, View] = {
    "app_start": View(
        "SparkListenerApplicationStart",
        "`App ID` string, `App Name` string, Timestamp bigint",
        {"app_id": "e.`App ID`", "app_name": "e.`App Name`", "ts": "e.Timestamp"},
    ),
    "app_end": View("SparkListenerApplicationEnd", "Timestamp bigint", {"ts": "e.Timestamp"}),
    "environment": View(
        "SparkListenerEnvironmentUpdate",
        "`Spark Properties` map<string,string>",
        {"props": "e.`Spark Properties`"},
    ),
    "job_start": View(
        "SparkListenerJobStart",
        "`Job ID` bigint, `Stage IDs` array<bigint>, Properties map<string,string>",
        {
            "job_id": "e.`Job ID`",
            "stage_ids": "e.`Stage IDs`",
            "execution_id": "try_cast(e.Properties['spark.sql.execution.id'] as bigint)",
        },
    ),
    "stage_submitted": View(
        "SparkListenerStageSubmitted",
        "`Stage Info` struct<`Stage ID`:bigint,`Stage Name`:string,`Submission Time`:bigint>,"
        " Properties map<string,string>",
        {
            "stage_id": "e.`Stage Info`.`Stage ID`",
            "stage_name": "coalesce(e.`Stage Info`.`Stage Name`, '')",
            "submission_time": "coalesce(e.`Stage Info`.`Submission Time`, 0)",
            "job_description": "e.Properties['spark.job.description']",
            "call_site": "e.Properties['callSite.short']",
        },
    ),
    "stage_completed": View(
        "SparkListenerStageCompleted",
        "`Stage Info` struct<`Stage ID`:bigint,`Completion Time`:bigint,`Failure Reason`:string>",
        {
            "stage_id": "e.`Stage Info`.`Stage ID`",
            "completion_time": "coalesce(e.`Stage Info`.`Completion Time`, 0)",
            "failed": "e.`Stage Info`.`Failure Reason` is not null",
        },
    ),
    "stage_accumulables": View(
        "SparkListenerStageCompleted",
        f"`Stage Info` struct<`Stage ID`:bigint,{_ACCUMULABLES}>",
        {"stage_id": "e.`Stage Info`.`Stage ID`", "accumulables": "e.`Stage Info`.Accumulables"},
    ),
    "task_end": View(
        "SparkListenerTaskEnd",
        "`Stage ID` bigint, `Task End Reason` string,"
        " `Task Info` struct<`Launch Time`:bigint,`Finish Time`:bigint,`Executor ID`:string>,"
        " `Task Executor Metrics` struct<JVMHeapMemory:bigint>,"
        " `Task Metrics` struct<`Executor Run Time`:bigint,`Memory Bytes Spilled`:bigint,`Disk Bytes Spilled`:bigint,"
        "`Input Metrics`:struct<`Bytes Read`:bigint,`Records Read`:bigint>,"
        "`Output Metrics`:struct<`Bytes Written`:bigint,`Records Written`:bigint>,"
        "`Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint>,"
        "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint>>",
        {
            "stage_id": "e.`Stage ID`",
            "reason": "e.`Task End Reason`",
            "executor_id": "e.`Task Info`.`Executor ID`",
            "duration_ms": "coalesce(e.`Task Info`.`Finish Time`, 0) - coalesce(e.`Task Info`.`Launch Time`, 0)",
            "heap": "coalesce(e.`Task Executor Metrics`.JVMHeapMemory, 0)",
            # an absent or empty object counts as "no metrics"
            "has_metrics": "coalesce(e.`Task Metrics`.`Executor Run Time`, e.`Task Metrics`.`Memory Bytes Spilled`,"
            " e.`Task Metrics`.`Disk Bytes Spilled`) is not null or e.`Task Metrics`.`Input Metrics` is not null"
            " or e.`Task Metrics`.`Output Metrics` is not null or e.`Task Metrics`.`Shuffle Read Metrics` is not null"
            " or e.`Task Metrics`.`Shuffle Write Metrics` is not null",
            "spill_memory": "coalesce(e.`Task Metrics`.`Memory Bytes Spilled`, 0)",
            "spill_disk": "coalesce(e.`Task Metrics`.`Disk Bytes Spilled`, 0)",
            "input_bytes": "coalesce(e.`Task Metrics`.`Input Metrics`.`Bytes Read`, 0)",
            "input_records": "coalesce(e.`Task Metrics`.`Input Metrics`.`Records Read`, 0)",
            "output_bytes": "coalesce(e.`Task Metrics`.`Output Metrics`.`Bytes Written`, 0)",
            "output_records": "coalesce(e.`Task Metrics`.`Output Metrics`.`Records Written`, 0)",
            "shuffle_read": "coalesce(e.`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read`, 0)"
            " + coalesce(e.`Task Metrics`.`Shuffle Read Metrics`.`Local Bytes Read`, 0)",
            "shuffle_write": "coalesce(e.`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`, 0)",
        },
    ),
    "task_accumulables": View(
        "SparkListenerTaskEnd",
        # an update keeps its type: whether it is quoted decides if it is added up
        "`Task Info` struct<Accumulables:array<struct<ID:string,Update:variant>>>,"
        " `Task Metrics` struct<Accumulators:array<struct<ID:string,Update:variant>>>",
        {
            "accumulables": "case when size(e.`Task Info`.Accumulables) > 0 then e.`Task Info`.Accumulables"
            " else e.`Task Metrics`.Accumulators end"
        },
    ),
    "executor_added": View(
        "SparkListenerExecutorAdded",
        "Timestamp bigint, `Executor ID` string, `Executor Info` struct<`Total Cores`:int>",
        {
            "ts": "e.Timestamp",
            "executor_id": "e.`Executor ID`",
            "cores": "coalesce(e.`Executor Info`.`Total Cores`, 1)",
        },
    ),
    "executor_removed": View(
        "SparkListenerExecutorRemoved",
        "Timestamp bigint, `Executor ID` string, `Removed Reason` string, Reason string",
        {
            "ts": "e.Timestamp",
            "executor_id": "e.`Executor ID`",
            "removed_reason": "e.`Removed Reason`",
            "reason": "e.Reason",
        },
    ),
    "heap_update": View(
        "SparkListenerExecutorMetricsUpdate",
        "`Executor Metrics` struct<JVMHeapMemory:bigint>, executorsUpdates map<string,struct<JVMHeapMemory:bigint>>,"
        " `Executor Metrics Updated` array<struct<`Executor Metrics`:struct<JVMHeapMemory:bigint>>>",
        {
            "direct": "e.`Executor Metrics`",
            "by_executor": "e.executorsUpdates",
            "updated": "e.`Executor Metrics Updated`",
        },
    ),
    "stage_executor_metrics": View(
        "SparkListenerStageExecutorMetrics",
        "`Executor Metrics` struct<JVMHeapMemory:bigint>",
        {"heap": "e.`Executor Metrics`.JVMHeapMemory"},
    ),
    "sql_start": View(
        "SparkListenerSQLExecutionStart",
        "executionId bigint, description string, time bigint",
        {
            "execution_id": "e.executionId",
            "description": "e.description",
            "time": "coalesce(e.time, 0)",
        },
        sql_ui=True,
    ),
    "sql_plan": View(
        "SparkListenerSQLExecutionStart",
        # the whole plan tree, and what else a start event tells: its line is long to parse
        "executionId bigint, description string, time bigint, sparkPlanInfo variant",
        {
            "execution_id": "e.executionId",
            "description": "e.description",
            "time": "coalesce(e.time, 0)",
            "plan": "e.sparkPlanInfo",
        },
        sql_ui=True,
    ),
    "adaptive_plan": View(
        "SparkListenerSQLAdaptiveExecutionUpdate",
        "executionId bigint, sparkPlanInfo variant",
        {"execution_id": "e.executionId", "plan": "e.sparkPlanInfo"},
        sql_ui=True,
    ),
    "sql_plan_text": View(
        "SparkListenerSQLExecutionStart",
        "executionId bigint, physicalPlanDescription string",
        {"execution_id": "e.executionId", "plan_text": "coalesce(e.physicalPlanDescription, '')"},
        sql_ui=True,
    ),
    "sql_end": View(
        "SparkListenerSQLExecutionEnd",
        "executionId bigint, time bigint",
        {"execution_id": "e.executionId", "time": "coalesce(e.time, 0)"},
        sql_ui=True,
    ),
    "driver_updates": View(
        "SparkListenerDriverAccumUpdates",
        "executionId bigint, accumUpdates array<array<bigint>>",
        {"execution_id": "e.executionId", "updates": "e.accumUpdates"},
        sql_ui=True,
    ),
}

#: Views whose columns another one of the same lines has, too: if that one is kept, no line is parsed again.
WIDER = {"sql_start": "sql_plan"}


class EventLog:
    """Lines of any number of applications, with one typed view per event type.

    `apps` (app_key) lists the logs that must appear in per-application results even when they hold no event;
    by default these are the applications that have at least one line. A source that keeps event types apart
    gives `parts` (event name -> function that returns its lines) instead of one frame of lines; `lines` may also be a
    function, for lines that are seldom asked for.
    With `stored`, a function that parses the lines once and returns all events (see `store_events`), the views read
    typed columns and no line is parsed twice. `keep_views` is for sources that keep event types apart: each view is parsed
    from its own lines at its first use and kept as typed columns, so that nothing is parsed that no result asks for. A log
    made of others gives `views`, a function of a view's name. `errors` returns (app_key, error) of logs that cannot be read
    to the end.
    """

    def __init__(
        self,
        lines: DataFrame | Callable[[], DataFrame] | None = None,
        apps: DataFrame | None = None,
        parts: dict[str, Callable[[], DataFrame]] | None = None,
        stored: Callable[[EventLog], DataFrame] | None = None,
        errors: Callable[[], DataFrame] | None = None,
        keep_views: bool = False,
        views: Callable[[str], DataFrame] | None = None,
    ):
        self._lines = lines
        self._keep_views = keep_views
        self._views = views
        self._apps = apps
        self._stored = stored
        self._errors = errors
        self._parts = parts or {}
        self._memo: dict[str, DataFrame] = {}

    @property
    def lines(self) -> DataFrame:
        if callable(self._lines):
            return self.memo("lines", self._lines)
        if self._lines is not None:
            return self._lines
        parts = [self.memo(f"part {event}", part) for event, part in self._parts.items()]
        return reduce(DataFrame.unionByName, parts)

    def memo(self, name: str, build):
        """Build a shared intermediate once per log (checkpointed steps must not run twice)."""
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    def apps(self) -> DataFrame:
        apps = self.lines if self._apps is None else self._apps
        return apps.select("app_key").distinct()

    def stored_events(self) -> DataFrame:
        """All events as typed columns, parsed at the first use."""
        return self.memo("stored events", lambda: self._stored(self))

    def errors(self) -> DataFrame | None:
        return None if self._errors is None else self.memo("errors", self._errors)

    def view(self, name: str) -> DataFrame:
        def build() -> DataFrame:
            if self._views is not None:
                return self._views(name)
            spec = VIEWS[name]
            wider = self._memo.get(f"view {WIDER.get(name)}")
            if self._keep_views and wider is not None:
                return wider.select("app_key", "seq", *spec.columns)
            if self._stored is not None:
                parsed = self.stored_events().filter(F.col("event") == spec.event)
            else:
                parsed = self._parsed(spec)
            view = parsed.selectExpr(
                "app_key", "seq", *[f"{source} AS {column}" for column, source in spec.columns.items()]
            )
            return checkpointed(view) if self._keep_views else view

        return self.memo(f"view {name}", build)

    def _of_event(self, spec: View) -> DataFrame:
        if self._lines is not None:
            return self.lines
        for event in self._parts:
            if event.removeprefix(SQL_UI) == spec.event:
                return self.memo(f"part {event}", self._parts[event])
        any_event = next(iter(self._parts))  # an event type that this source never logs
        return self.memo(f"part {any_event}", self._parts[any_event]).filter(F.lit(False))

    def _parsed(self, spec: View) -> DataFrame:
        lines = self._of_event(spec)
        if "event" in lines.columns:
            mine = F.col("event").endswith(spec.event) if spec.sql_ui else F.col("event") == spec.event
            return lines.filter(mine).select("app_key", "seq", F.from_json("value", spec.ddl).alias("e"))
        parsed = lines.filter(F.col("value").contains(spec.event)).select(
            "app_key", "seq", F.from_json("value", f"Event string, {spec.ddl}").alias("e")
        )
        mine = F.col("e.Event").endswith(spec.event) if spec.sql_ui else F.col("e.Event") == spec.event
        return parsed.filter(mine)


def per_log(operator):
    """Build an operator's DataFrame once per log and arguments, so that shared steps share their plan."""

    @wraps(operator)
    def once(log: EventLog, *args, **kwargs):
        return log.memo(f"{operator.__module__}.{operator.__name__}{args}{kwargs}", lambda: operator(log, *args, **kwargs))

    return once


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type with the fields of both; other types must be equal."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a}
        for f in b:
            fields[f.name] = _merged(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if a != b:
        raise ValueError(f"one field as {a} and {b}")
    return a


def event_schema() -> T.StructType:
    """All fields that any view reads, so that one parse of a line serves every view."""
    return reduce(_merged, [T.StructType.fromDDL(v.ddl) for v in VIEWS.values()], T.StructType.fromDDL("Event string"))


def store_events(lines: DataFrame, path: str, rebalance: bool = False) -> None:
    """Parse each line once and write its fields as typed columns, in a folder for each event type.

    Lines that are no events of interest keep nothing but their place. `rebalance` evens out the files of lines that are
    not sorted by event type yet: a very common event is split over many files, the rare ones get one each.
    """
    plain = sorted({v.event for v in VIEWS.values() if not v.sql_ui})
    name = F.when(F.col("e.Event").isin(plain), F.col("e.Event"))
    for event in sorted({v.event for v in VIEWS.values() if v.sql_ui}):
        name = name.when(F.col("e.Event").endswith(event), F.lit(event))
    # No filter here: Spark would parse the lines once more for it.
    rest = [c for c in lines.columns if c not in ("app_key", "seq", "value", "event")]
    parsed = lines.select("app_key", "seq", *rest, F.from_json("value", event_schema()).alias("e"))
    events = parsed.withColumn("event", F.coalesce(name, F.lit("other"))).withColumn(
        "e", F.when(F.col("event") != "other", F.col("e")))
    with storing(lines.sparkSession):
        (events.hint("rebalance", "event") if rebalance else events).write.partitionBy("event").parquet(path)


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_log(spark: SparkSession, path: str) -> EventLog:
    """A log whose events were stored; its raw lines are no longer there."""
    events = stored_events(spark, path)
    return EventLog(apps=events, stored=lambda _: events)
