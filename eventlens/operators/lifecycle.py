"""Application lifecycle, configuration, executors and heap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators.ordering import CHUNK, before_chunk, in_chunks
from eventlens.operators.tasks import shared_stage_totals
from eventlens.sources.events import EventLog, per_log


def _last(column: str, seq: str = "seq") -> Column:
    """Value of the latest event that carries one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(seq)))


@per_log
def app_times(log: EventLog) -> DataFrame:
    """Last start and end of each application in ms, 0 where none was logged."""
    starts = log.view("app_start").groupBy("app_key").agg(
        _last("app_id").alias("app_id"),
        _last("app_name").alias("app_name"),
        F.max_by(S.zero_if_null(F.col("ts")), "seq").alias("start_ms"),
    )
    ends = log.view("app_end").groupBy("app_key").agg(
        F.max_by(S.zero_if_null(F.col("ts")), "seq").alias("end_ms")
    )
    return starts.join(ends, "app_key", "full").select(
        "app_key",
        F.coalesce("app_id", F.lit("Unknown")).alias("app_id"),
        F.coalesce("app_name", F.lit("Unknown")).alias("app_name"),
        S.zero_if_null(F.col("start_ms")).alias("start_ms"),
        S.zero_if_null(F.col("end_ms")).alias("end_ms"),
    )


def app_lifecycle(log: EventLog) -> DataFrame:
    """Id, name, start, end, duration in seconds (0 unless both times are known) and local start date."""
    start, end = F.col("start_ms"), F.col("end_ms")
    return app_times(log).select(
        "*",
        S.seconds_between(start, end).alias("duration_sec"),
        S.local_time(start).alias("start_date"),
    )


@per_log
def app_environment(log: EventLog) -> DataFrame:
    """Driver and executor settings of the last environment event."""
    props = F.col("props")
    executor_memory = S.memory_bytes(props["spark.executor.memory"])
    settings = log.view("environment").select(
        "app_key",
        "seq",
        F.struct(
            S.memory_bytes(props["spark.driver.memory"]).alias("driver_memory"),
            S.int_setting(props, "spark.driver.cores", 0).alias("driver_cores"),
            S.int_setting(props, "spark.executor.cores", 1).alias("executor_cores"),
            executor_memory.alias("executor_memory"),
            S.default_overhead(props["spark.executor.memoryOverhead"], executor_memory).alias("executor_overhead"),
            S.int_setting(props, "spark.executor.instances", 0).alias("executor_instances"),
            F.coalesce(props["spark.dynamicAllocation.enabled"] == "true", F.lit(False)).alias("dynamic_allocation"),
            S.int_setting(props, "spark.dynamicAllocation.maxExecutors", 0).alias("max_executors_conf"),
        ).alias("s"),
    )
    return settings.groupBy("app_key").agg(F.max_by("s", "seq").alias("s")).select("app_key", "s.*")


def peak_heap(log: EventLog, modern_heap: bool = False) -> DataFrame:
    """Largest JVM heap over task ends (with metrics) and executor updates.

    Older logs carry one `Executor Metrics` object or an `executorsUpdates` map. `modern_heap` also reads what
    current Spark writes: the array form and the per-stage executor metrics.
    """
    stages = shared_stage_totals(log).select("app_key", F.col("max_heap").alias("heap"))
    updates = log.view("heap_update")
    from_map = F.array_max(F.transform(F.map_values("by_executor"), lambda v: v["JVMHeapMemory"]))
    heap = F.when(F.col("direct").isNotNull(), F.col("direct.JVMHeapMemory")).otherwise(from_map)
    if modern_heap:
        from_array = F.array_max(F.transform("updated", lambda v: v["Executor Metrics"]["JVMHeapMemory"]))
        heap = F.greatest(heap, from_array)
    sources = stages.unionByName(updates.select("app_key", heap.alias("heap")))
    if modern_heap:
        sources = sources.unionByName(log.view("stage_executor_metrics").select("app_key", "heap"))
    return sources.groupBy("app_key").agg(F.greatest(F.max("heap"), S.bigint(0)).alias("peak_heap"))


@per_log
def executor_events(log: EventLog) -> DataFrame:
    """Executor additions (+1) and removals (-1), and application starts (0), in log order, in chunks."""
    added = log.view("executor_added").select("app_key", "seq", "ts", "executor_id", F.lit(1).alias("step"))
    removed = log.view("executor_removed").select("app_key", "seq", "ts", "executor_id", F.lit(-1).alias("step"))
    start = log.view("app_start").select(
        "app_key", "seq", "ts", F.lit(None).cast("string").alias("executor_id"), F.lit(0).alias("step")
    )
    return in_chunks(added.unionByName(removed).unionByName(start), ["app_key"], ["seq"])


def _running(rows: DataFrame, delta: str) -> DataFrame:
    """Running sum of `delta` per application (column `total`) and its running minimum (`lowest`, at most 0)."""
    so_far = Window.partitionBy("app_key", CHUNK).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_sum", F.sum(delta).over(so_far)).withColumn("_low", F.min("_sum").over(so_far))
    chunks = rows.groupBy("app_key", CHUNK).agg(F.sum(delta).alias("_chunk_sum"))
    before = before_chunk(["app_key"])
    carried = chunks.select(
        "app_key", CHUNK, F.coalesce(F.sum("_chunk_sum").over(before), F.lit(0)).alias("_base")
    )
    lows = (
        inside.groupBy("app_key", CHUNK).agg(F.min("_low").alias("_chunk_low"))
        .join(carried, ["app_key", CHUNK])
        .select(
            "app_key", CHUNK, "_base", F.min(F.col("_chunk_low") + F.col("_base")).over(before).alias("_low_before")
        )
    )
    return inside.join(lows, ["app_key", CHUNK]).select(
        *rows.columns,
        (F.col("_base") + F.col("_sum")).alias("total"),
        F.least(F.lit(0), F.col("_low_before"), F.col("_base") + F.col("_low")).alias("lowest"),
    )


def executor_timeline(log: EventLog) -> DataFrame:
    """Executor count after every start, addition and removal; all executors count and it never drops below 0."""
    events = executor_events(log)
    counted = _running(events, "step")
    first = events.filter("ts is not null").groupBy("app_key").agg(F.min_by("ts", "seq").alias("first_ts"))
    return (
        counted.filter("ts is not null")
        .join(first, "app_key")
        .select(
            "app_key",
            "seq",
            F.col("ts").alias("time"),
            ((F.col("ts") - F.col("first_ts")).cast("double") / 1000.0).alias("seconds"),
            # a count clamped at 0 is the plain sum minus its lowest dip below 0
            F.when(F.col("step") == 0, F.lit(0))
            .otherwise(F.col("total") - F.col("lowest"))
            .cast("bigint")
            .alias("count"),
        )
    )


def max_active_executors(log: EventLog) -> DataFrame:
    """Largest set of live executors in log order; repeated additions and unknown removals change nothing."""
    rows = executor_events(log).filter("step != 0 and executor_id != 'driver'")
    group = ["app_key", "executor_id", CHUNK]
    carried = (
        rows.groupBy(*group)
        .agg(F.max_by("step", "seq").alias("_last"))
        .select(*group, F.lag("_last").over(Window.partitionBy("app_key", "executor_id").orderBy(CHUNK)).alias("_before"))
    )
    inside = F.lag("step").over(Window.partitionBy(*group).orderBy("seq"))
    alive = F.coalesce("_previous", "_before", F.lit(-1))
    changes = (
        rows.withColumn("_previous", inside)
        .join(carried, group)
        .select("app_key", CHUNK, "seq", F.when(alive != F.col("step"), F.col("step")).otherwise(F.lit(0)).alias("delta"))
    )
    return _largest_total(changes)


def max_counted_executors(log: EventLog) -> DataFrame:
    """Largest plain count of additions minus removals (no set, no floor), taken at additions; driver left out."""
    rows = executor_events(log).filter("step != 0 and executor_id != 'driver'")
    return _largest_total(rows.withColumnRenamed("step", "delta"))


def _largest_total(rows: DataFrame) -> DataFrame:
    """Largest running total per application; only one row per chunk leaves the chunk."""
    so_far = Window.partitionBy("app_key", CHUNK).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    chunks = (
        rows.withColumn("_sum", F.sum("delta").over(so_far))
        .groupBy("app_key", CHUNK)
        .agg(F.sum("delta").alias("_chunk_sum"), F.max(F.when(F.col("delta") > 0, F.col("_sum"))).alias("_peak"))
    )
    base = F.coalesce(F.sum("_chunk_sum").over(before_chunk(["app_key"])), F.lit(0))
    return (
        chunks.select("app_key", (base + F.col("_peak")).alias("_peak"))
        .groupBy("app_key")
        .agg(F.greatest(F.max("_peak"), S.bigint(0)).alias("max_active_executors"))
        .withColumn("max_active_executors", S.zero_if_null(F.col("max_active_executors")))
    )


def executor_lifetimes(log: EventLog) -> DataFrame:
    """Start and end of every executor. One only seen in a removal starts with the application; one never removed
    ends with it. An added driver is left out, a removed one is not."""
    added = (
        log.view("executor_added").filter("executor_id != 'driver'")
        .groupBy("app_key", "executor_id").agg(F.max_by("ts", "seq").alias("added_ms"))
    )
    removed = log.view("executor_removed").groupBy("app_key", "executor_id").agg(
        F.max_by("ts", "seq").alias("removed_ms")
    )
    return (
        added.join(removed, ["app_key", "executor_id"], "full")
        .join(app_times(log).select("app_key", "start_ms", "end_ms"), "app_key", "left")
        .select(
            "app_key",
            "executor_id",
            F.coalesce("added_ms", "start_ms", S.bigint(0)).alias("start_ms"),
            F.coalesce(F.nullif(F.col("removed_ms"), S.bigint(0)), "end_ms", S.bigint(0)).alias("end_ms"),
        )
    )


def executor_lifetimes_by_cores(log: EventLog) -> DataFrame:
    """Alternate rule: each executor's own cores, driver included, only executors that were added; an executor
    that is added again starts anew."""
    added = log.view("executor_added").groupBy("app_key", "executor_id").agg(
        F.max_by(F.struct("ts", "cores"), "seq").alias("a"), F.max("seq").alias("added_seq")
    )
    # the last removal of all is after the last addition exactly when any is
    removed = log.view("executor_removed").groupBy("app_key", "executor_id").agg(
        F.max_by("ts", "seq").alias("last_ms"), F.max("seq").alias("removed_seq")
    )
    return (
        added.join(removed, ["app_key", "executor_id"], "left")
        .withColumn("removed_ms", F.when(F.col("removed_seq") > F.col("added_seq"), F.col("last_ms")))
        .join(app_times(log).select("app_key", F.col("end_ms").alias("app_end_ms")), "app_key", "left")
        .select(
            "app_key",
            "executor_id",
            F.col("a.ts").alias("start_ms"),
            F.coalesce(F.nullif(F.col("removed_ms"), S.bigint(0)), "app_end_ms", S.bigint(0)).alias("end_ms"),
            F.col("a.cores").cast("bigint").alias("cores"),
        )
    )


def lifetime_total(lifetimes: DataFrame, weight: Column) -> DataFrame:
    """Sum of lifetime times `weight` per application; negative lifetimes do not count."""
    life = F.greatest(F.col("end_ms") - F.col("start_ms"), S.bigint(0))
    return lifetimes.groupBy("app_key").agg(S.zero_if_null(F.sum(life * weight)).alias("lifetime_ms"))


def idle_cores(log: EventLog, task_ms: DataFrame) -> DataFrame:
    """Core capacity (lifetime x configured executor cores) and the share of it that ran no task.

    The share is negative when tasks took longer than the capacity. `task_ms` is (app_key, task_ms).
    """
    cores = app_environment(log).select("app_key", "executor_cores")
    capacity = (
        lifetime_total(executor_lifetimes(log), S.bigint(1))
        .join(cores, "app_key", "left")
        .select(
            "app_key", (F.col("lifetime_ms") * F.coalesce("executor_cores", S.bigint(1))).alias("capacity_ms")
        )
    )
    return (
        capacity.join(task_ms, "app_key", "full")
        .select("app_key", S.zero_if_null(F.col("capacity_ms")).alias("capacity_ms"), S.zero_if_null(F.col("task_ms")).alias("task_ms"))
        .withColumn("idle_pct", S.percent(F.col("capacity_ms") - F.col("task_ms"), F.col("capacity_ms")))
    )


def capacity_columns(
    cores: Column, memory: Column, overhead: Column, instances: Column, dynamic: Column, limit: Column, active: Column
) -> dict[str, Column]:
    requested = F.when(dynamic, limit).otherwise(instances)
    return {
        "requested_executors": F.when(requested == 0, active).otherwise(requested),
        "total_cores": active * cores,
        "total_memory": active * (memory + overhead),
    }


def capacity(log: EventLog) -> DataFrame:
    """Requested executors (falling back to the largest active set), total cores and memory, peak memory %."""
    joined = (
        log.apps()
        .join(app_environment(log), "app_key", "left")
        .join(max_active_executors(log), "app_key", "left")
        .join(peak_heap(log), "app_key", "left")
        .na.fill({"executor_cores": 1, "dynamic_allocation": False})
        .na.fill(0)
    )
    columns = capacity_columns(
        F.col("executor_cores"), F.col("executor_memory"), F.col("executor_overhead"), F.col("executor_instances"),
        F.col("dynamic_allocation"), F.col("max_executors_conf"), F.col("max_active_executors"),
    )
    return joined.select(
        "app_key",
        "max_active_executors",
        *[c.alias(name) for name, c in columns.items()],
        "peak_heap",
        S.percent(F.col("peak_heap"), F.col("executor_memory")).alias("peak_memory_pct"),
    )


def preempted_removals(log: EventLog) -> DataFrame:
    reason = S.removal_reason(F.col("removed_reason"), F.col("reason"))
    return log.view("executor_removed").filter(S.mentions_preemption(reason)).select("app_key", "executor_id", "seq")


def preempted_executors(log: EventLog) -> DataFrame:
    """Number of removals by preemption (events, not distinct executors)."""
    return preempted_removals(log).groupBy("app_key").agg(F.count("*").alias("preempted_executors"))


def preempted_tasks(log: EventLog) -> DataFrame:
    """Tasks whose end reason mentions preemption, or that failed on an executor preempted earlier in the log."""
    by_text = shared_stage_totals(log).groupBy("app_key").agg(F.sum("preempted_by_text").alias("preempted_tasks"))
    by_text = by_text.filter("preempted_tasks > 0")
    removals = preempted_removals(log)
    tasks = log.view("task_end").select("app_key", "seq", "executor_id", "reason")
    told = S.mentions_preemption(F.col("reason"))
    outcome = F.coalesce(F.get_json_object("reason", "$.Reason"), F.lit(""))
    first = removals.groupBy("app_key", "executor_id").agg(F.min("seq").alias("preempted_seq"))
    by_executor = (
        tasks.filter(~told & (outcome != "Success"))
        .join(first, ["app_key", "executor_id"])  # one row per executor: no fan-out
        .filter("preempted_seq < seq")
        .groupBy("app_key")
        .agg(F.count("*").alias("preempted_tasks"))
    )
    return by_text.unionByName(by_executor).groupBy("app_key").agg(F.sum("preempted_tasks").alias("preempted_tasks"))
