"""What SQL executions read and wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators.ordering import as_of, checkpointed
from eventlens.operators.tasks import shared_stage_totals
from eventlens.plans import tree
from eventlens.sources.events import EventLog, per_log


def _stage_listings(log: EventLog) -> DataFrame:
    """(stage, SQL execution) as listed by job starts."""
    return (
        log.view("job_start").filter("execution_id is not null")
        .select("app_key", "seq", "execution_id", F.explode("stage_ids").alias("stage_id"))
    )


@per_log
def _listed_stages(log: EventLog) -> DataFrame:
    """Each stage once, with its first listing and whether its listings name more than one execution."""
    return _stage_listings(log).groupBy("app_key", "stage_id").agg(
        F.min("seq").alias("listed_seq"),
        F.min("execution_id").alias("execution_id"),
        (F.min("execution_id") != F.max("execution_id")).alias("changes"),
    )


def with_execution(rows: DataFrame, log: EventLog) -> DataFrame:
    """Add `execution_id` to rows (app_key, stage_id, seq, ...): the execution of the latest earlier job start that
    lists the stage. Rows without one are left out."""
    return as_of(rows, _stage_listings(log), ["app_key", "stage_id"], "seq", "execution_id")


def task_execution(log: EventLog) -> DataFrame:
    """SQL execution of each task."""
    return with_execution(log.view("task_end").select("app_key", "stage_id", "seq", "duration_ms"), log)


@per_log
def execution_io(log: EventLog) -> DataFrame:
    """Task input and output per SQL execution, counting tasks that end after the execution has started.

    A stage belongs as a whole to its execution when it never changes it and all its tasks end after the listing
    and the start; then its totals are enough. Only tasks of other stages are looked up one by one.
    """
    io = ["input_bytes", "input_records", "output_bytes", "output_records"]
    on = ["app_key", "stage_id"]
    keys = ["app_key", "execution_id"]
    starts = tree.executions(log).select(*keys, "start_seq")
    ordered = F.col("first_any_seq") > F.greatest("listed_seq", "start_seq")
    # stored, as three steps read it
    placed = checkpointed(
        shared_stage_totals(log).select(*on, "first_any_seq", *io, "writing_tasks")
        .join(_listed_stages(log), on)
        .join(starts, keys, "left")
        .withColumn("whole", ~F.col("changes") & ordered)
        .select(*keys, "stage_id", "changes", "whole", *io, "writing_tasks")
    )
    totals = [F.col(c).alias(f"task_{c}") for c in io]
    parts = placed.filter("whole").select(*keys, *totals, F.col("writing_tasks").alias("task_files"))
    single = placed.filter("changes or not whole").select(*on)
    tasks = log.view("task_end").select(*on, "seq", *io).filter(" or ".join(f"{c} > 0" for c in io))
    late = with_execution(tasks.join(single, on, "left_semi"), log).join(starts, keys).filter("start_seq < seq")
    parts = parts.unionByName(
        late.select(*keys, *totals, (F.col("output_bytes") > 0).cast("bigint").alias("task_files"))
    )
    return checkpointed(parts.groupBy(*keys).agg(*[
        F.sum(c).alias(c) for c in [f"task_{c}" for c in io] + ["task_files"]
    ]))


def _metric(name: str, column: str):
    return F.max(F.when(F.col("metric") == name, F.col("value"))).alias(column)


def read_metrics(log: EventLog) -> DataFrame:
    """Files, rows, bytes, partitions, average size, path, format and filters of every scan that read something.

    Driver-side values and task input are alternative measures of the same thing, so the larger counts. Task
    input cannot be told apart between scans of one execution and goes to the first of them.
    """
    nodes = tree.shared_nodes(log).filter(F.col("node_name").contains("Scan") & (F.size("metrics") > 0))
    at = F.struct("start_seq", "pos")
    # the same scan can be part of several plans (cached data); the last plan owns it
    scans = nodes.withColumn("signature", tree.node_signature()).groupBy("app_key", "signature").agg(
        F.min(at).alias("first_at"),
        F.max_by(F.struct("execution_id", "start_seq", "pos", "metadata", "metrics"), at).alias("n"),
    ).select("app_key", "signature", "first_at", "n.*")
    keys = ["app_key", "signature"]
    scans = checkpointed(scans)
    values = checkpointed(tree.node_driver_metrics(scans, tree.driver_values(log, per_execution=False), keys).groupBy(*keys).agg(
        _metric("number of files read", "acc_files"),
        _metric("number of output rows", "acc_rows"),
        _metric("size of files read", "acc_bytes"),
        _metric("number of partitions read", "acc_partitions"),
    ))
    first = scans.groupBy("app_key", "execution_id").agg(F.min_by("signature", "first_at").alias("signature"))
    task_input = execution_io(log).join(first, ["app_key", "execution_id"]).select(
        *keys, "task_input_bytes", "task_input_records"
    )
    size = F.greatest(S.zero_if_null(F.col("acc_bytes")), S.zero_if_null(F.col("task_input_bytes")))
    rows = F.greatest(S.zero_if_null(F.col("acc_rows")), S.zero_if_null(F.col("task_input_records")))
    files = S.zero_if_null(F.col("acc_files"))
    return (
        scans.join(values, keys, "left")
        .join(task_input, keys, "left")
        .select(
            "app_key",
            "execution_id",
            F.col("pos").alias("node_pos"),
            F.when((files == 0) & (size > 0), S.bigint(1)).otherwise(files).alias("files_read"),
            rows.alias("rows"),
            size.alias("bytes_read"),
            S.zero_if_null(F.col("acc_partitions")).alias("partitions_read"),
            S.scan_path(F.col("metadata")).alias("file_path"),
            S.scan_format(F.col("metadata")).alias("format"),
            S.scan_partition_filters(F.col("metadata")).alias("partition_filters"),
        )
        .filter("files_read > 0 or rows > 0")
        .withColumn("average_file_size", average_size("bytes_read", "files_read"))
    )


def average_size(size: str, files: str):
    """Whole bytes per file, 0 without files."""
    return F.when(F.col(files) > 0, F.expr(f"{size} div nullif({files}, 0)")).otherwise(S.bigint(0))


def write_metrics(log: EventLog) -> DataFrame:
    """Files, rows, bytes, average size, path, format and mode of every SQL execution that writes files."""
    write_nodes = tree.shared_nodes(log).filter(F.map_contains_key("metrics", F.lit("number of written files")))
    keys = ["app_key", "execution_id"]
    first = checkpointed(write_nodes.groupBy(*keys).agg(
        F.min_by(F.struct("start_seq", "node_name", "simple_string", "metrics"), "pos").alias("n")
    ).select(*keys, "n.*"))
    values = checkpointed(tree.node_driver_metrics(first, tree.driver_values(log, per_execution=True), keys).groupBy(*keys).agg(
        _metric("number of written files", "acc_files"),
        _metric("number of output rows", "acc_rows"),
        _metric("written output", "acc_bytes"),
    ))
    path, fmt, mode = S.write_target(F.col("node_name"), F.col("simple_string"))

    def larger(driver: str, task: str):
        return F.greatest(S.zero_if_null(F.col(driver)), S.zero_if_null(F.col(task)))

    return (
        first.join(values, keys, "left")
        .join(execution_io(log), keys, "left")
        .select(
            *keys,
            larger("acc_files", "task_files").alias("files_written"),
            larger("acc_rows", "task_output_records").alias("rows"),
            larger("acc_bytes", "task_output_bytes").alias("bytes_written"),
            path.alias("file_path"),
            fmt.alias("format"),
            mode.alias("mode"),
        )
        .withColumn("average_file_size", average_size("bytes_written", "files_written"))
    )


def write_totals(log: EventLog) -> DataFrame:
    return (
        write_metrics(log).groupBy("app_key")
        .agg(
            F.sum("files_written").alias("files_written"),
            F.sum("rows").alias("rows_written"),
            F.sum("bytes_written").alias("bytes_written"),
        )
        .withColumn("average_file_size", average_size("bytes_written", "files_written"))
    )


# Locations in a physical plan's text.
PLAN_PATH = r"(?:hdfs://\S+|s3://\S+|file://\S+|viewfs://\S+)"
MORE_PLAN_PATH = r"(?:hdfs://\S+|s3a?://\S+|file:/\S+|viewfs://\S+)"
PATH_EDGE = "\",)]}"


def plan_text_paths(log: EventLog, more_schemes: bool = False) -> DataFrame:
    """Distinct input (format, path) and output paths named in physical plan texts, as rows.

    A plan text has outputs when it mentions a write command; every location in it then counts as output too.
    `more_schemes` also accepts s3a:// and file:/ with one slash.
    """
    where = MORE_PLAN_PATH if more_schemes else PLAN_PATH
    text = F.col("plan_text")
    # How a plan's text names scans, and the words of write commands.
    scan = rf"(?s)Scan\s+(\w+).*?Location:.*?({where})"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(scan), 1).alias("format"),
        F.regexp_extract_all(text, F.lit(scan), 2).alias("path"),
    )
    plans = log.view("sql_plan_text")
    inputs = plans.select("app_key", F.explode(found).alias("f")).select(
        "app_key", F.lit("input").alias("direction"), F.col("f.format").alias("format"), F.col("f.path").alias("path")
    )
    writes = text.contains("InsertInto") | text.contains("Write") | text.contains("SaveInto")
    outputs = plans.filter(writes).select(
        "app_key", F.explode(F.regexp_extract_all(text, F.lit(rf"Location:.*?({where})"), 1)).alias("path")
    ).select("app_key", F.lit("output").alias("direction"), F.lit("Output").alias("format"), "path")
    return (
        inputs.unionByName(outputs)
        .withColumn("path", F.btrim("path", F.lit(PATH_EDGE)))
        .distinct()
    )
