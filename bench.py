"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from eventlens.operators.ordering import clear
from eventlens.queries.registry import QUERIES
from eventlens.sources.tables import activity_log, application_log

HEADLINE = [
    "max_shuffle_stage", "stage_detail", "write_metrics", "executor_timeline", "idle_cores", "app_summary",
    "read_metrics", "operation_list", "task_execution", "accumulator_rollup", "summary_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='eventlens-bench-')}")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name, log in (("store_application_log", application_log), ("store_activity_log", activity_log)):
        started = time.perf_counter()
        log(spark, sf_dir).view("task_end")  # keeps the tasks alone; other views are kept by the queries
        seconds[name] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
