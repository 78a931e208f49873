"""Every operator as a query over the star-schema tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import alt, detail, flows, lifecycle, operations, report, sizing, summary, tasks
from eventlens.operators.ordering import new_path
from eventlens.plans import tree
from eventlens.sources import logs
from eventlens.sources.files import write_files
from eventlens.sources.tables import activity_log, application_log, position, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- sources ---------------------------------------------------------------------------------------------------


@query
def event_type_counts(spark, sf_dir):
    return logs.event_type_counts(application_log(spark, sf_dir))


@query
def log_groups(spark, sf_dir):
    return logs.log_groups(application_log(spark, sf_dir))


@query
def app_names(spark, sf_dir):
    """Names of all applications that customers could have; some have no log."""
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("application_"), F.col("c_custkey") * 2).alias("app_key"))
    return logs.app_names(application_log(spark, sf_dir), asked)


@query
def log_inventory(spark, sf_dir):
    log = application_log(spark, sf_dir)
    started = lifecycle.app_lifecycle(log).select("app_key", F.col("start_date").alias("date"))
    return logs.app_names(log).join(started, "app_key").withColumn("filename", F.col("app_key")).orderBy(F.desc("date"), "filename")


@query
def log_search(spark, sf_dir):
    names = logs.app_names(application_log(spark, sf_dir)).withColumn("filename", F.col("app_key"))
    return report.log_search(names, "OMER#0000001")


@query
def log_search_counts(spark, sf_dir):
    names = logs.app_names(application_log(spark, sf_dir)).withColumn("filename", F.col("app_key"))
    hit = F.lower("app_name").contains("-1995-0") | F.lower("filename").contains("_1")
    return names.agg(F.count("*").alias("total"), F.count_if(hit).alias("shown"))


@query
def renamed_log_lines(spark, sf_dir):
    """Lines per application after its job name was replaced, with the number that carry the new or old name."""
    lines = application_log(spark, sf_dir).lines
    renamed = report.renamed_log_lines(lines, r"(Customer#\d+-(\d{4}-\d{2}-\d{2}))")
    return renamed.groupBy("app_key", "new_name").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("value").contains(F.col("new_name"))).alias("with_new_name"),
        F.count_if(F.col("value").contains(F.col("old_name"))).alias("with_old_name"),
    )


# --- logs in files ---------------------------------------------------------------------------------------------


def _file_lines(spark, sf_dir):
    """Lines of the activity log with the names of the files that hold them: applications with an even number have one plain
    file, the others rolling ones, up to a day and from then on, under an empty anchor."""
    lines = activity_log(spark, sf_dir).lines
    number = F.substring_index("app_key", "_", -1).cast("bigint")
    middle = position("tasks", F.unix_micros(F.lit("2024-01-15").cast("timestamp")))
    rolling = F.concat(F.lit("events_"), F.when(F.col("seq") < middle, "9").otherwise("10"), F.lit("_"), F.col("app_key"))
    anchors = lines.filter(number % 2 == 1).select("app_key").distinct().select(
        F.concat(F.lit("appstatus_"), "app_key").alias("file_name"), F.lit(0).cast("decimal(38,0)").alias("seq"), F.lit(None).cast("string").alias("value"))
    return lines.select(F.when(number % 2 == 0, F.col("app_key")).otherwise(rolling).alias("file_name"), "seq", "value").unionByName(anchors)


def _written_logs(spark, sf_dir):
    """Folder of the files, written anew for each query."""
    folder = new_path(spark)
    write_files(_file_lines(spark, sf_dir), folder)
    return folder


def _base_name(path):
    return F.element_at(F.split(path, "/"), -1)


@query
def file_inventory(spark, sf_dir):
    """Logs that a user can pick from a folder, and the file that stands for each."""
    return logs.inventory(spark, _written_logs(spark, sf_dir)).select("app_key", "filename", _base_name("path").alias("file"))


@query
def file_resolution(spark, sf_dir):
    """Files for the names of all users, and of some that have no log."""
    asked = table(spark, sf_dir, "events").select(F.explode(F.array("user_id", F.col("user_id") + 1000)).alias("n")).distinct()
    names = asked.select(F.concat(F.lit("application_"), "n").alias("filename"))
    return logs.resolve(logs.inventory(spark, _written_logs(spark, sf_dir)), names).select("filename", _base_name("path").alias("file"))


@query
def file_groups(spark, sf_dir):
    """Part files of one application belong together: their number and lines."""
    lines = activity_log(spark, sf_dir).lines
    before = lambda phase: F.col("seq") < position(phase, F.lit(0))
    number = F.when(before("tasks"), "1").when(before("app_end"), "2").otherwise("3")
    part = F.concat(F.lit("application_1_"), F.substring_index("app_key", "_", -1), F.lit("_part_00"), number)
    folder = new_path(spark)
    write_files(lines.select(part.alias("file_name"), "seq", "value"), folder)
    files = logs.log_files(spark, folder).groupBy(logs.group_name(F.col("file_name")).alias("app_key")).agg(F.count("*").alias("files"))
    counted = logs.log_groups(logs.read_logs(spark, folder, group_parts=True)).select("app_key", "lines")
    return files.join(counted, "app_key")


@query
def file_summary(spark, sf_dir):
    """The summary of logs read from files, plain and rolling, written as CSV and read again."""
    folder = new_path(spark)
    summary.write_csv(summary.app_summary(logs.read_logs(spark, _written_logs(spark, sf_dir))), folder)
    return summary.read_csv(spark, folder).select(
        F.col("Application ID").alias("app_id"), F.col("Application Name").alias("app_name"),
        F.col("Total Tasks").cast("bigint").alias("tasks"), F.col("Max Active Executors").cast("bigint").alias("max_active_executors"),
        F.col("Preempted Executors").cast("bigint").alias("preempted_executors"))


# --- lifecycle and resources -----------------------------------------------------------------------------------


@query
def app_lifecycle(spark, sf_dir):
    return lifecycle.app_lifecycle(application_log(spark, sf_dir))


@query
def activity_lifecycle(spark, sf_dir):
    return lifecycle.app_lifecycle(activity_log(spark, sf_dir))


@query
def app_environment(spark, sf_dir):
    return lifecycle.app_environment(application_log(spark, sf_dir))


@query
def peak_heap(spark, sf_dir):
    return lifecycle.peak_heap(activity_log(spark, sf_dir))


@query
def executor_timeline(spark, sf_dir):
    return lifecycle.executor_timeline(activity_log(spark, sf_dir)).drop("seq")


@query
def max_active_executors(spark, sf_dir):
    return lifecycle.max_active_executors(activity_log(spark, sf_dir))


@query
def max_counted_executors(spark, sf_dir):
    return lifecycle.max_counted_executors(activity_log(spark, sf_dir))


@query
def executor_lifetimes(spark, sf_dir):
    return lifecycle.executor_lifetimes(activity_log(spark, sf_dir))


@query
def executor_lifetimes_by_cores(spark, sf_dir):
    return lifecycle.executor_lifetimes_by_cores(activity_log(spark, sf_dir))


@query
def idle_cores(spark, sf_dir):
    log = activity_log(spark, sf_dir)
    return lifecycle.idle_cores(log, tasks.task_totals(log).select("app_key", "task_ms"))


@query
def capacity(spark, sf_dir):
    return lifecycle.capacity(activity_log(spark, sf_dir))


@query
def preempted_executors(spark, sf_dir):
    return lifecycle.preempted_executors(activity_log(spark, sf_dir))


@query
def preempted_tasks(spark, sf_dir):
    return lifecycle.preempted_tasks(application_log(spark, sf_dir))


@query
def preempted_tasks_by_executor(spark, sf_dir):
    return lifecycle.preempted_tasks(activity_log(spark, sf_dir))


# --- tasks, stages, jobs ---------------------------------------------------------------------------------------


@query
def task_totals(spark, sf_dir):
    return tasks.task_totals(application_log(spark, sf_dir))


@query
def stage_totals(spark, sf_dir):
    return tasks.stage_totals(application_log(spark, sf_dir)).select(*tasks.STAGE_COLUMNS)


@query
def job_shuffle(spark, sf_dir):
    return tasks.job_shuffle(application_log(spark, sf_dir, reruns=True)).drop("first_seq")


@query
def max_shuffle_stage(spark, sf_dir):
    return tasks.max_stages(application_log(spark, sf_dir)).drop("max_spill_memory", "max_spill_memory_stage_id")


@query
def max_spill_stage(spark, sf_dir):
    return tasks.max_stages(application_log(spark, sf_dir)).select("app_key", "max_spill_memory", "max_spill_memory_stage_id")


@query
def max_shuffle_job(spark, sf_dir):
    return tasks.max_jobs(application_log(spark, sf_dir))


@query
def max_positive_stages(spark, sf_dir):
    return tasks.max_positive_stages(application_log(spark, sf_dir))


@query
def stage_detail(spark, sf_dir):
    return detail.stage_detail(application_log(spark, sf_dir))


# --- SQL executions and plans ----------------------------------------------------------------------------------


@query
def task_execution(spark, sf_dir):
    return flows.task_execution(application_log(spark, sf_dir, reruns=True)).drop("seq")


@query
def sql_executions(spark, sf_dir):
    return detail.sql_executions(application_log(spark, sf_dir, reruns=True))


@query
def execution_jobs(spark, sf_dir):
    return detail.execution_jobs(application_log(spark, sf_dir)).drop("seq")


@query
def plan_nodes(spark, sf_dir):
    path = F.array_join(F.col("path").cast("array<string>"), ".")
    return tree.plan_nodes(application_log(spark, sf_dir)).select(
        "app_key", "execution_id", "pos", "post_pos", "depth", path.alias("path"), "node_name", "simple_string"
    )


@query
def tracked_nodes(spark, sf_dir):
    nodes = tree.tracked_nodes(tree.plan_nodes(application_log(spark, sf_dir)))
    return nodes.select("app_key", "execution_id", "pos", "kind", F.size("metrics").alias("metrics"))


@query
def op_details(spark, sf_dir):
    nodes = tree.op_details(tree.tracked_nodes(tree.plan_nodes(application_log(spark, sf_dir))))
    return nodes.select(
        "app_key", "execution_id", "pos", "kind", "file_path", "format", "mode", "partition_filters", "condition",
        "selected_fields", "aggregate_keys", "aggregate_functions", "is_distinct", "partitioning", "num_partitions",
    )


@query
def node_driver_metrics(spark, sf_dir):
    log = application_log(spark, sf_dir)
    values = tree.driver_values(log, per_execution=True)
    return tree.node_driver_metrics(tree.plan_nodes(log), values, ["app_key", "execution_id", "pos"])


@query
def accumulator_rollup(spark, sf_dir):
    return tree.accumulator_rollup(application_log(spark, sf_dir))


@query
def read_metrics(spark, sf_dir):
    return flows.read_metrics(application_log(spark, sf_dir))


@query
def write_metrics(spark, sf_dir):
    return flows.write_metrics(application_log(spark, sf_dir))


@query
def write_totals(spark, sf_dir):
    return flows.write_totals(application_log(spark, sf_dir))


@query
def plan_text_paths(spark, sf_dir):
    return flows.plan_text_paths(application_log(spark, sf_dir))


@query
def filter_rows_inferred(spark, sf_dir):
    return operations.filter_rows_inferred(application_log(spark, sf_dir)).drop("signature")


@query
def operation_list(spark, sf_dir):
    return operations.operation_list(application_log(spark, sf_dir))


@query
def operation_list_plain(spark, sf_dir):
    """Steps without details of exchanges."""
    return operations.operation_list(application_log(spark, sf_dir), full_shuffle=False)


# --- summaries and reports -------------------------------------------------------------------------------------


@query
def app_summary(spark, sf_dir):
    return summary.app_summary(application_log(spark, sf_dir), history_url="http://history:18080/")


@query
def activity_summary(spark, sf_dir):
    return summary.app_summary(activity_log(spark, sf_dir))


@query
def alt_profile(spark, sf_dir):
    return alt.alt_profile(application_log(spark, sf_dir))


@query
def app_report_lines(spark, sf_dir):
    log = application_log(spark, sf_dir)
    return report.app_report_lines(alt.alt_profile(log), flows.plan_text_paths(log))


@query
def report_table(spark, sf_dir):
    return report.report_table(alt.alt_profile(application_log(spark, sf_dir)))


@query
def report_document(spark, sf_dir):
    log = application_log(spark, sf_dir)
    return report.report_document(alt.alt_profile(log), flows.plan_text_paths(log))


@query
def detail_documents(spark, sf_dir):
    return detail.detail_documents(application_log(spark, sf_dir)).select("app_key", "part", "json")


@query
def detail_parts(spark, sf_dir):
    """Number of entries of each part of the detail documents, and bytes of their text."""
    return detail.detail_documents(application_log(spark, sf_dir)).groupBy("app_key", "part").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("json")).alias("bytes"))


@query
def summary_with_errors(spark, sf_dir):
    """The summary if the logs of one market segment could not be read to their end."""
    broken = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").join(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    errors = broken.select(F.concat(F.lit("application_"), F.col("c_custkey")).alias("app_key"), F.lit("cut off").alias("error"))
    return summary.with_error_rows(summary.app_summary(application_log(spark, sf_dir)), errors)


@query
def summary_in_unit(spark, sf_dir):
    return report.summary_in_unit(summary.app_summary(application_log(spark, sf_dir)), "MB")


@query
def metrics_long(spark, sf_dir):
    return report.metrics_long(summary.app_summary(application_log(spark, sf_dir)))


@query
def summary_stats(spark, sf_dir):
    return report.summary_stats(summary.app_summary(application_log(spark, sf_dir)), "KB")


@query
def metric_trend(spark, sf_dir):
    return report.metric_trend(summary.app_summary(application_log(spark, sf_dir)), "GB")


@query
def results_ranked(spark, sf_dir):
    results = lifecycle.app_lifecycle(application_log(spark, sf_dir)).select("app_key", "app_name", "duration_sec")
    return report.results_ranked(results, "app_name", descending=True)


def _results_to_delete(spark, sf_dir):
    results = lifecycle.app_lifecycle(application_log(spark, sf_dir)).select(
        "app_key", F.col("app_id").alias("Application ID"), F.col("app_name").alias("Application Name")
    )
    unwanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return results, unwanted.select(F.concat(F.lit("application_"), F.col("c_custkey")).alias("Application ID"))


@query
def results_after_delete(spark, sf_dir):
    return report.delete_applications(*_results_to_delete(spark, sf_dir))


@query
def deletion_counts(spark, sf_dir):
    return report.deletion_counts(*_results_to_delete(spark, sf_dir))


# --- sizing ----------------------------------------------------------------------------------------------------


def _max_shuffle(log):
    return tasks.max_stages(log).select("app_key", F.greatest("max_shuffle_read", "max_shuffle_write").alias("max_shuffle"))


@query
def sizing_static(spark, sf_dir):
    return sizing.sizing_static(_max_shuffle(application_log(spark, sf_dir)))


@query
def sizing_dynamic(spark, sf_dir):
    return sizing.sizing_dynamic(_max_shuffle(application_log(spark, sf_dir)))


@query
def sizing_choice(spark, sf_dir):
    """Customers of one market segment count as runs of the same job on different days."""
    log = application_log(spark, sf_dir)
    day = F.regexp_extract("app_name", r"(-\d{4}-\d{2}-\d{2})$", 1)
    segments = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("application_"), F.col("c_custkey")).alias("app_key"), "c_mktsegment"
    )
    runs = (
        lifecycle.app_lifecycle(log).join(segments, "app_key").join(_max_shuffle(log), "app_key")
        .select(F.concat("c_mktsegment", day).alias("app_name"), "max_shuffle")
    )
    return sizing.sizing_choice(runs)


@query
def memory_breakdown(spark, sf_dir):
    log = application_log(spark, sf_dir)
    return sizing.memory_breakdown(lifecycle.app_environment(log), lifecycle.peak_heap(log), tasks.task_totals(log))


@query
def findings(spark, sf_dir):
    return sizing.findings(summary.app_summary(application_log(spark, sf_dir)))
