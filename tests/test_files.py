"""Logs in files: plain, parts, rolling, zstd, a real one."""

import json
import tempfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlens.operators import detail, flows, lifecycle, report, summary, tasks
from eventlens.sources import files, logs, store
from eventlens.sources.events import store_events, stored_log


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="eventlens-test-"))


def zstd(path, text):
    with pa.OSFile(str(path), "wb") as sink, pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(text.encode())


def values(log):
    return [r.value for r in log.lines.orderBy("app_key", "seq").collect()]


def test_rolling_files_in_numeric_order(spark, folder):
    for n in (2, 10, 1):
        (folder / f"events_{n}_application_1_1").write_text(f'{{"n":{n}}}\n{{"m":{n}}}\n')
    (folder / "appstatus_application_1_1").write_text("")
    (folder / "other.txt").write_text("x\n")
    log = logs.read_logs(spark, str(folder))
    assert values(log) == ['{"n":1}', '{"m":1}', '{"n":2}', '{"m":2}', '{"n":10}', '{"m":10}']
    assert [r.app_key for r in log.apps().collect()] == ["application_1_1"]
    listed = logs.inventory(spark, str(folder)).collect()
    assert [(r.filename, r.path.split("/")[-1]) for r in listed] == [("application_1_1", "appstatus_application_1_1")]


def test_line_order_over_many_splits(spark, folder):
    lines = [f'{{"n":{i}}}' for i in range(20000)]
    (folder / "application_7_7").write_text("\n".join(lines) + "\n")
    for i in range(6):
        (folder / f"application_8_{i}").write_text(f"{i}\n" * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        log = logs.read_logs(spark, str(folder))
        got = [r.value for r in log.lines.filter("app_key = 'application_7_7'").orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == lines


def test_zstd_larger_than_a_split(spark, folder):
    lines = [json.dumps({"n": i, "x": str(i * 7919)}) for i in range(30000)]
    zstd(folder / "events_1_application_2_2.zstd", "\n".join(lines[:20000]) + "\n")
    zstd(folder / "events_2_application_2_2.zstd", "\n".join(lines[20000:]) + "\n")
    zstd(folder / "application_3_3.zst", "a\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        log = logs.read_logs(spark, str(folder))
        assert values(log) == lines + ["a", "b"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_zstd_is_streamed(spark, folder):
    """Files far larger than what a task holds are read whole, also with several frames, long lines and any line end."""
    lines = [f"{i} {'x' * (i % 97)}" for i in range(5000)] + ["y" * 50_000, "", "last"]
    parts = ("\n".join(lines[:3000]) + "\r\n", "\r".join(lines[3000:]))
    frames = [pa.compress(part.encode(), codec="zstd", asbytes=True) for part in parts]
    (folder / "application_1_1.zstd").write_bytes(b"".join(frames))
    (folder / "application_1_2.zstd").write_bytes(b"")
    for chunk in (1000, 1 << 20):
        assert values(logs.read_logs(spark, str(folder), chunk=chunk)) == lines
    assert [next(files.lines_of(iter([b"a\r", b"\nb\r", b"c"])), None), list(files.lines_of(iter([b"\r"])))] == [[b"a"], [[b""]]]


def test_cut_off_zstd_keeps_what_it_holds(spark, folder):
    text = "".join(f"{i * 7919}\n" for i in range(50_000))
    zstd(folder / "application_1_1.zstd", text)
    data = (folder / "application_1_1.zstd").read_bytes()
    (folder / "application_1_1.zstd").write_bytes(data[: len(data) * 2 // 3])
    rows = logs.zstd_lines(logs.log_files(spark, str(folder)), chunk=4096).orderBy("seq").collect()
    held = [r.value for r in rows[:-1]]
    assert held == text.split("\n")[: len(held)] and len(held) > 1000
    assert rows[-1].value is None and rows[-1].error


def test_listing_by_tasks(spark, folder):
    for name in ("application_1_1", "a/application_2_2", "a/b/c/appstatus_application_3_3", "a/b/empty/application_4_4", "a/other.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("" if "4_4" in name else "x\n")
    (folder / "nothing").mkdir()
    got = files.list_files(spark, str(folder)).collect()
    found = [p for p in folder.rglob("*") if p.is_file()]
    assert sorted(r.path for r in got) == sorted(f"file://{p}" for p in found)
    assert {r.file_name: (r.length, int(r.modified.timestamp())) for r in got} == {p.name: (p.stat().st_size, int(p.stat().st_mtime)) for p in found}
    by_driver = files._listed_by_driver(spark, files.qualified(spark, str(folder)))
    assert {(r.path, r.folder, r.length) for r in by_driver.collect()} == {(r.path, r.folder, r.length) for r in got}
    assert logs.log_files(spark, str(folder)).count() == 4


def finished(stage):
    return json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Launch Time": 0, "Finish Time": 5}, "Task Metrics": {"Memory Bytes Spilled": 1}}) + "\n"


def test_only_new_and_changed_files_are_parsed(spark, folder):
    source, where = folder / "logs", str(folder / "store")
    source.mkdir()
    totals = lambda: {r.app_key: r.tasks for r in tasks.task_totals(logs.read_logs(spark, str(source), stored_in=where)).collect()}
    lines_in = lambda batch: spark.read.parquet(f"{where}/events/batch={batch}").count()
    (source / "application_1_1").write_text(finished(1) * 3)
    zstd(source / "application_2_2.zstd", finished(1) * 2)
    assert totals() == {"application_1_1": 3, "application_2_2": 2}
    assert totals() == {"application_1_1": 3, "application_2_2": 2}
    assert len(store.batches(spark, where)) == 1  # the second time nothing was parsed
    (source / "application_3_3").write_text(finished(4))
    zstd(source / "application_2_2.zstd", finished(1) * 7)  # changed
    assert totals() == {"application_1_1": 3, "application_2_2": 7, "application_3_3": 1}
    first, second = store.batches(spark, where)
    assert (lines_in(first), lines_in(second)) == (5, 8)
    (source / "application_1_1").unlink()
    assert totals() == {"application_2_2": 7, "application_3_3": 1}
    assert len(store.batches(spark, where)) == 2
    # a batch that was never committed is not read
    spark.read.parquet(f"{where}/events/batch={second}").write.partitionBy("event").parquet(f"{where}/events/batch=00000009-broken")
    assert totals() == {"application_2_2": 7, "application_3_3": 1}


def test_folders_without_lines(spark, folder):
    (folder / "application_1_1").write_text("")
    for path in (folder, folder / "none"):
        path.mkdir(exist_ok=True)
        log = logs.read_logs(spark, str(path))
        got = {r["app_key"]: r["Total Tasks"] for r in summary.app_summary(log).collect()}
        assert got == ({"application_1_1": 0} if path == folder else {})


def test_unreadable_file_gives_error_row(spark, folder):
    (folder / "application_4_4.zstd").write_bytes(b"no zstd at all")
    (folder / "application_5_5").write_text('{"Event":"SparkListenerApplicationStart","App ID":"application_5_5","App Name":"n","Timestamp":1000}\n')
    log = logs.read_logs(spark, str(folder))
    (folder / "application_6_6").write_text("")
    text = "".join(json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": i, "Task Metrics": {"Executor Run Time": i * 7919}}) + "\n" for i in range(20000))
    zstd(folder / "application_7_7.zstd", text)
    whole = (folder / "application_7_7.zstd").read_bytes()
    (folder / "application_7_7.zstd").write_bytes(whole[: len(whole) // 2])
    for name in ("one", "two"):
        (folder / name).mkdir()
        (folder / name / "application_8_8").write_text(json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": 1}) + "\n")
    log = logs.read_logs(spark, str(folder))
    got = {r["app_key"]: r for r in summary.app_summary(log).collect()}
    assert got["application_6_6"]["Total Tasks"] == 0 and got["application_6_6"]["Application ID"] == "Unknown"
    assert got["application_7_7"]["Start Date"] == "Error" and got["application_7_7"]["Total Tasks"] is None
    shared = [r for k, r in got.items() if k.endswith("/application_8_8")]
    assert len(shared) == 2 and all(r["Total Tasks"] == 1 for r in shared) and len(got) == 6
    names = {r.app_key: r.app_name for r in logs.app_names(log).collect()}
    assert names["application_4_4"] == names["application_7_7"] == "Read Error" and names["application_5_5"] == "n"
    assert got["application_4_4"]["Start Date"] == "Error" and got["application_4_4"]["Application Name"].startswith("Error: ")
    assert got["application_4_4"]["Total Tasks"] is None and got["application_5_5"]["Total Tasks"] == 0


def test_parts_bad_bytes_and_resolution(spark, folder):
    (folder / "application_6_6_1_part_002").write_bytes(b'{"c":"\xff3"}\n')
    (folder / "application_6_6_1_part_001").write_text('{"b":2}\n')
    (folder / "application_6_6_1").write_text('{"a":1}\n')
    assert values(logs.read_logs(spark, str(folder), group_parts=True)) == ['{"a":1}', '{"b":2}', '{"c":"3"}']
    asked = spark.createDataFrame([("application_6_6_1",), ("application_9",)], "filename string")
    found = {r.filename: r.path for r in logs.resolve(logs.inventory(spark, str(folder)), asked).collect()}
    assert found["application_6_6_1"].endswith("/application_6_6_1") and found["application_9"] is None


def test_sinks(spark, folder, make_log):
    results = summary.app_summary(make_log(['{"Event":"SparkListenerApplicationStart","App ID":"i","App Name":"n, \\"q\\"","Timestamp":1000}']))
    summary.write_csv(results, str(folder / "csv"))
    back = summary.read_csv(spark, str(folder / "csv"))
    assert back.columns == list(summary.SUMMARY_COLUMNS)
    first = back.first()
    assert (first["Application Name"], first["Max Shuffle Read Stage ID"], first["Total Tasks"]) == ('n, "q"', "", "0")
    summary.write_csv(report.summary_in_unit(results, "GB"), str(folder / "gb"), quote_all=True)
    text = "".join(p.read_text() for p in (folder / "gb").glob("part-*"))
    assert '"Total Input (GB)"' in text and text.count('"') >= 4 * 38


def test_stored_events_give_the_same_results(spark, folder, make_log):
    log = make_log([
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Info": {"Launch Time": 1, "Finish Time": 4}, "Task Metrics": {"Memory Bytes Spilled": 3}},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 1, "sparkPlanInfo": {"nodeName": "A"}},
        "broken",
    ])
    store_events(log.lines, str(folder / "store"))
    stored = stored_log(spark, str(folder / "store"))
    assert tasks.task_totals(stored).collect() == tasks.task_totals(log).collect()
    assert detail.sql_executions(stored).collect() == detail.sql_executions(log).collect()
    plan = stored.view("task_end")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event" in plan or "PartitionFilters: [" in plan and "TaskEnd" in plan
    assert "from_json" not in plan


def test_files_of_given_names(spark, folder):
    rows = [(f"application_{i % 7}", i, f"{i} ü") for i in range(500)] + [("appstatus_application_1", 0, None)]
    lines = spark.createDataFrame(rows, "file_name string, seq bigint, value string").repartition(5)
    counted = {r.file_name: r.lines for r in files.write_files(lines, str(folder / "new")).collect()}
    assert sorted(p.name for p in (folder / "new").iterdir()) == sorted(counted)
    assert counted["appstatus_application_1"] == 0 and sum(counted.values()) == 500
    assert (folder / "new" / "application_3").read_text() == "".join(f"{i} ü\n" for i in range(3, 500, 7))


def test_deletion_counts_what_it_writes(spark, folder, make_log):
    start = lambda i: json.dumps({"Event": "SparkListenerApplicationStart", "App ID": f"id{i}", "App Name": "n", "Timestamp": 1})
    results = summary.app_summary(make_log([start(i) for i in range(40)], [f"a{i}" for i in range(40)]))
    summary.write_csv(results, str(folder / "csv"))
    unwanted = spark.createDataFrame([(f"id{i}",) for i in (1, 5, 5, 99)], "`Application ID` string")
    counts = report.rewrite_without(spark, str(folder / "csv"), unwanted, str(folder / "less"))
    left = summary.read_csv(spark, str(folder / "less"))
    assert counts.collect() == report.deletion_counts(results, unwanted).collect() == [(2, 38)]
    assert left.columns == list(summary.SUMMARY_COLUMNS) and left.count() == 38
    assert left.filter("`Max Shuffle Read Stage ID` = ''").count() == 38


def test_large_report_is_written_by_many_tasks(spark, folder):
    rows = [("metrics_report_a.txt", "a", 1, f"{i:05d}", f"line {i}") for i in range(900)] + [("metrics_report_b.txt", "b", 1, "", "only")]
    document = spark.createDataFrame(rows, "file_name string, app_name string, section int, item string, line string").repartition(6)
    report.write_report(document, str(folder / "report"))
    parts = sorted((folder / "report" / "file_name=metrics_report_a.txt").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == "".join(f"line {i}\n" for i in range(900))


def test_results_after_clear(spark, folder):
    """Queries work on after the written steps were deleted, and see tables that were replaced."""
    from eventlens.operators import ordering
    from eventlens.queries.registry import QUERIES

    given = "/root/testdata/sf0.001"
    for name in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{given}/{name}.parquet").limit(300).write.parquet(str(folder / f"{name}.parquet"))
    first = QUERIES["app_lifecycle"](spark, str(folder)).count()
    ordering.clear(spark)
    assert QUERIES["app_lifecycle"](spark, str(folder)).count() == first > 0
    spark.read.parquet(f"{given}/orders.parquet").limit(3).write.mode("overwrite").parquet(str(folder / "orders.parquet"))
    assert QUERIES["app_lifecycle"](spark, str(folder)).count() <= 3


def test_real_log(spark, folder):
    """A log written by Spark itself, in another process."""
    import subprocess
    import sys

    script = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").appName("probe").config("spark.ui.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{folder}")
    .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.executor.memory", "2g").getOrCreate())
spark.range(0, 1000, 1, 4).selectExpr("id", "id % 7 as k").write.parquet("file://{folder}/in")
spark.read.parquet("file://{folder}/in").where("id >= 100").groupBy("k").count().write.parquet("file://{folder}/out")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=180)
    written = [p for p in folder.iterdir() if p.name.startswith("local-")]
    assert len(written) == 1
    (folder / "logs").mkdir()
    (folder / "logs" / "application_1_2").write_bytes(written[0].read_bytes())
    log = logs.read_logs(spark, str(folder / "logs"))
    got = summary.app_summary(log, modern_heap=True).first()
    assert (got["Application Name"], got["Executor Memory"], got["Max Active Executors"]) == ("probe", 2 * 1024**3, 0)
    assert got["Total Output Rows"] == 1000 + 7 and got["Total Tasks"] >= 6
    writes = {r.file_path.split("/")[-1]: r for r in flows.write_metrics(log).collect()}
    assert (writes["in"].rows, writes["in"].files_written, writes["in"].mode) == (1000, 4, "ErrorIfExists")
    read = flows.read_metrics(log).filter(F.col("file_path").endswith("/in")).first()
    assert (read.format, read.rows, read.files_read) == ("Parquet", 1000, 4)
    assert lifecycle.executor_timeline(log).filter("count < 0").count() == 0
    stages = detail.stage_detail(log).collect()
    assert {s.status for s in stages} == {"Completed"} and sum(s.tasks for s in stages) == got["Total Tasks"]
