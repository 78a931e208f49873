"""Totals over finished tasks: per application, stage and job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators.ordering import checkpointed
from eventlens.sources.events import EventLog, per_log

MEASURES = [
    "input_bytes", "input_records", "output_bytes", "output_records",
    "shuffle_read", "shuffle_write", "spill_memory", "spill_disk",
]


@per_log
def stage_totals(log: EventLog) -> DataFrame:
    """Totals per stage over all attempts: the one pass over the tasks that everything else builds on.

    Partial sums are made before the shuffle, so a huge stage sends one row per input partition. Only tasks with
    metrics add to the measures; `first_seq` is the first such task and breaks ties between stages.
    """
    measured = F.col("has_metrics")
    return log.view("task_end").groupBy("app_key", "stage_id").agg(
        F.count("*").alias("tasks"),
        F.sum(measured.cast("bigint")).alias("measured_tasks"),
        F.sum("duration_ms").alias("task_ms"),
        *[S.zero_if_null(F.sum(F.when(measured, F.col(m)))).alias(m) for m in MEASURES],
        S.zero_if_null(F.max(F.when(measured, F.col("shuffle_read")))).alias("max_task_shuffle_read"),
        S.zero_if_null(F.max(F.when(measured, F.col("shuffle_write")))).alias("max_task_shuffle_write"),
        F.min(F.when(measured, F.col("seq"))).alias("first_seq"),
        F.min("seq").alias("first_any_seq"),
        *[F.min(F.when(measured & (F.col(m) > 0), F.col("seq"))).alias(f"first_{m}_seq") for m in ("spill_memory", "spill_disk")],
        F.count_if(F.col("output_bytes") > 0).alias("writing_tasks"),
        F.count_if(S.mentions_preemption(F.col("reason"))).alias("preempted_by_text"),
        S.zero_if_null(F.max(F.when(measured, F.col("heap")))).alias("max_heap"),
        F.max("heap").alias("max_heap_any"),
    )


STAGE_COLUMNS = [
    "app_key", "stage_id", "tasks", "measured_tasks", "task_ms", *MEASURES, "max_task_shuffle_read", "max_task_shuffle_write",
]


@per_log
def shared_stage_totals(log: EventLog) -> DataFrame:
    """Stage totals for results that use them several times: one pass over the tasks, kept in the checkpoint folder
    (one row per stage)."""
    return checkpointed(stage_totals(log))


@per_log
def task_totals(log: EventLog) -> DataFrame:
    totals = ["tasks", "task_ms", *MEASURES]
    return shared_stage_totals(log).groupBy("app_key").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in totals],
        F.max("max_task_shuffle_read").alias("max_task_shuffle_read"),
        F.max("max_task_shuffle_write").alias("max_task_shuffle_write"),
    )


@per_log
def stage_jobs(log: EventLog) -> DataFrame:
    """Job of each stage. The last job that lists a stage wins, so a skipped stage moves to the later job."""
    listed = log.view("job_start").select("app_key", "seq", "job_id", F.explode("stage_ids").alias("stage_id"))
    return listed.groupBy("app_key", "stage_id").agg(F.max_by("job_id", "seq").alias("job_id"))


@per_log
def job_shuffle(log: EventLog) -> DataFrame:
    """Shuffle totals per job: the sum over the stages that belong to it."""
    measured = shared_stage_totals(log).filter("measured_tasks > 0 and stage_id is not null")
    return (
        measured.join(stage_jobs(log), ["app_key", "stage_id"])
        .filter("job_id is not null")
        .groupBy("app_key", "job_id")
        .agg(
            F.sum("shuffle_read").alias("shuffle_read"),
            F.sum("shuffle_write").alias("shuffle_write"),
            F.min("first_seq").alias("first_seq"),
        )
    )


def _largest(df: DataFrame, key: str, measures: dict[str, str], first: str = "first_seq") -> DataFrame:
    """Largest value of each measure per application and its key; the one whose `first` comes first wins a tie."""
    aggregates = []
    for measure, name in measures.items():
        order = F.struct(F.col(measure), -F.col(first), -F.col(key))
        aggregates += [F.max(measure).alias(name), F.max_by(key, order).alias(f"{name}_{key}")]
    return df.groupBy("app_key").agg(*aggregates)


def max_stages(log: EventLog) -> DataFrame:
    """Stages with most shuffle read, shuffle write and spilled memory (a stage is named even if all are 0)."""
    measured = shared_stage_totals(log).filter("measured_tasks > 0 and stage_id is not null")
    return _largest(measured, "stage_id", {
        "shuffle_read": "max_shuffle_read", "shuffle_write": "max_shuffle_write", "spill_memory": "max_spill_memory",
    })


def max_jobs(log: EventLog) -> DataFrame:
    return _largest(job_shuffle(log), "job_id", {
        "shuffle_read": "max_shuffle_read", "shuffle_write": "max_shuffle_write",
    })


def max_positive_stages(log: EventLog) -> DataFrame:
    """Alternate rule: only stages that spilled at all, for memory and for disk, with the job of each. Of equal ones
    counts the stage that spilled first, even if another had started before."""
    stages = shared_stage_totals(log).filter("stage_id is not null")
    jobs = stage_jobs(log)
    out = None
    for measure in ("spill_memory", "spill_disk"):
        spilled = stages.filter(F.col(measure) > 0)
        best = (
            _largest(spilled, "stage_id", {measure: f"max_{measure}"}, f"first_{measure}_seq")
            .join(jobs.withColumnRenamed("stage_id", f"max_{measure}_stage_id"), ["app_key", f"max_{measure}_stage_id"], "left")
            .withColumn(f"max_{measure}_job_id", F.coalesce(F.col("job_id").cast("string"), F.lit("Unknown")))
            .drop("job_id")
        )
        out = best if out is None else out.join(best, "app_key", "full")
    return out
