"""The summary: one row of 38 metrics per application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators import flows, lifecycle, tasks
from eventlens.operators.ordering import checkpointed
from eventlens.sources.events import EventLog

# Column names in display order, and where each comes from.
SUMMARY_COLUMNS = {
    "Start Date": "start_date",
    "Application ID": "app_id",
    "Application Name": "app_name",
    "Duration (Sec)": "duration_sec",
    "Driver Cores": "driver_cores",
    "Driver Memory": "driver_memory",
    "Executor Cores": "executor_cores",
    "Executor Memory": "executor_memory",
    "Executor Overhead Memory": "executor_overhead",
    "Requested Executors": "requested_executors",
    "Max Active Executors": "max_active_executors",
    "Preempted Executors": "preempted_executors",
    "Total Cores Capacity": "total_cores",
    "Total Memory Capacity": "total_memory",
    "Avg Idle Cores (%)": "idle_pct",
    "Peak Memory Usage (%)": "peak_memory_pct",
    "Peak Heap Usage": "peak_heap",
    "Total Input": "input_bytes",
    "Total Output": "output_bytes",
    "Total Output Rows": "rows_written",
    "Write File Avg Size": "average_file_size",
    "Write Partitions (Files)": "files_written",
    "Total Spill (Memory)": "spill_memory",
    "Total Spill (Disk)": "spill_disk",
    "Total Shuffle Read": "shuffle_read",
    "Total Shuffle Write": "shuffle_write",
    "Max Shuffle Read (Stage)": "max_shuffle_read_stage",
    "Max Shuffle Read Stage ID": "max_shuffle_read_stage_id",
    "Max Shuffle Write (Stage)": "max_shuffle_write_stage",
    "Max Shuffle Write Stage ID": "max_shuffle_write_stage_id",
    "Max Spill Memory (Stage)": "max_spill_memory_stage",
    "Max Spill Stage ID": "max_spill_memory_stage_id",
    "Max Shuffle Read (Job)": "max_shuffle_read_job",
    "Max Shuffle Read Job ID": "max_shuffle_read_job_id",
    "Max Shuffle Write (Job)": "max_shuffle_write_job",
    "Max Shuffle Write Job ID": "max_shuffle_write_job_id",
    "Total Tasks": "tasks",
    "Preempted Tasks": "preempted_tasks",
}

# Columns that hold bytes.
BYTE_COLUMNS = [
    "Total Input", "Total Output", "Write File Avg Size",
    "Driver Memory", "Executor Memory", "Executor Overhead Memory", "Total Memory Capacity",
    "Peak Heap Usage", "Total Shuffle Read", "Total Shuffle Write",
    "Max Shuffle Read (Stage)", "Max Shuffle Write (Stage)",
    "Max Shuffle Read (Job)", "Max Shuffle Write (Job)",
    "Total Spill (Memory)", "Total Spill (Disk)",
    "Max Spill Memory (Stage)",
]

# Columns that are no measures.
LABEL_COLUMNS = [
    "Start Date", "Application ID", "Application Name",
    "Max Shuffle Read Stage ID", "Max Shuffle Write Stage ID", "Max Spill Stage ID",
    "Max Shuffle Read Job ID", "Max Shuffle Write Job ID",
]

METRIC_COLUMNS = [c for c in SUMMARY_COLUMNS if c not in LABEL_COLUMNS]

_NULLABLE = {source for name, source in SUMMARY_COLUMNS.items() if name in LABEL_COLUMNS and name.endswith("ID")}


def _renamed(df: DataFrame, kind: str, keep_name: str) -> DataFrame:
    """max_x / max_x_<kind>_id -> max_x_<kind> / max_x_<kind>_id."""
    return df.select("app_key", *[
        F.col(c).alias(c if c.endswith(keep_name) else f"{c}_{kind}") for c in df.columns if c != "app_key"
    ])


def app_summary(log: EventLog, modern_heap: bool = False, history_url: str | None = None) -> DataFrame:
    """38 metrics per application, also for logs without any event. `history_url` adds a link column.

    Every part is reduced to one row per application before it is joined, so the joins are small however large
    one application is. The parts are stored one by one, so that the shuffle files of only one are on disk at a time, and
    the summary is, so that no later step makes it again.
    """
    task_ms = tasks.task_totals(log).select("app_key", "task_ms")
    parts = [
        lifecycle.app_lifecycle(log).select("app_key", "app_id", "app_name", "duration_sec", "start_date"),
        lifecycle.app_environment(log),
        tasks.task_totals(log).drop("input_records", "output_records", "max_task_shuffle_read", "max_task_shuffle_write"),
        lifecycle.idle_cores(log, task_ms).select("app_key", "idle_pct"),
        lifecycle.max_active_executors(log),
        lifecycle.peak_heap(log, modern_heap),
        lifecycle.preempted_tasks(log),
        lifecycle.preempted_executors(log),
        _renamed(tasks.max_stages(log), "stage", "_stage_id"),
        _renamed(tasks.max_jobs(log), "job", "_job_id"),
        flows.write_totals(log),
    ]
    joined = log.apps()
    for part in parts:
        joined = joined.join(checkpointed(part), "app_key", "left")
    joined = joined.na.fill({"app_id": "Unknown", "app_name": "Unknown", "start_date": "", "executor_cores": 1,
                             "dynamic_allocation": False})
    joined = joined.na.fill(0, [c for c in joined.columns if c not in _NULLABLE])
    capacity = lifecycle.capacity_columns(
        F.col("executor_cores"), F.col("executor_memory"), F.col("executor_overhead"), F.col("executor_instances"),
        F.col("dynamic_allocation"), F.col("max_executors_conf"), F.col("max_active_executors"),
    )
    ready = joined.withColumns(
        {**capacity, "peak_memory_pct": S.percent(F.col("peak_heap"), F.col("executor_memory"))}
    )
    columns: list[Column] = [F.col(source).alias(name) for name, source in SUMMARY_COLUMNS.items()]
    if history_url:
        columns.append(S.history_link(history_url, F.col("app_id")).alias("History Link"))
    result = checkpointed(ready.select("app_key", *columns))
    # a log that cannot be read to its end gets no half-summed row
    return result if log.errors() is None else with_error_rows(result, log.errors())


def with_error_rows(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """Replace the rows of unreadable logs (app_key, error) by error rows: id = log name, name = the error."""
    rows = errors.select(
        "app_key",
        F.col("app_key").alias("Application ID"),
        F.concat(F.lit("Error: "), F.col("error")).alias("Application Name"),
        F.lit("Error").alias("Start Date"),
    )
    return summary.join(errors, "app_key", "left_anti").unionByName(rows, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; missing values are empty."""
    df.drop("app_key").write.option("header", True).option("quoteAll", quote_all).option("emptyValue", "").csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """Results as they were written, missing values as empty text."""
    return spark.read.option("header", True).csv(path).na.fill("")
