"""Logs written from tables keep only what a result asks for."""

import datetime
import json

import pytest

from eventlens.operators import detail, lifecycle, ordering, tasks
from eventlens.plans import tree
from eventlens.sources.tables import application_log


@pytest.fixture()
def sf_dir(spark, tmp_path):
    day = datetime.date(2024, 1, 2)
    tables = {
        "customer": ([(1, "Customer#1", 3, "BUILDING")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(5, 1, "F", 10.5, day, "1-URGENT"), (6, 1, "O", 20.5, day, "2-HIGH")],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        "lineitem": ([(5, 1, 7, 3, 2.0, 100.0, "R", "O"), (5, 2, 8, 4, 3.0, 50.0, "N", "F"), (6, 1, 9, 5, 4.0, 75.0, "A", "F")],
                     "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double,"
                     " l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_only_asked_for_views_are_kept(spark, sf_dir):
    before = len(ordering.written())
    log = application_log(spark, sf_dir)
    times = lifecycle.app_times(log).collect()
    assert len(ordering.written()) - before == 2  # starts and ends of applications; no task, no plan
    assert [(r.app_name, r.end_ms - r.start_ms) for r in times] == [("Customer#1-2024-01-02", 86400000)]
    log.view("app_start").collect()
    assert len(ordering.written()) - before == 2  # kept once
    kept = [spark.read.parquet(folder) for folder in ordering.written()[before:]]
    assert [df.count() for df in kept] == [1, 1]


def test_reruns_add_to_the_kept_views(spark, sf_dir):
    log, again = application_log(spark, sf_dir), application_log(spark, sf_dir, reruns=True)
    assert (log.view("job_start").count(), again.view("job_start").count()) == (2, 3)
    assert sorted(tasks.task_totals(again).collect()) == sorted(tasks.task_totals(log).collect())
    assert again.view("task_end").count() == 3


def test_plan_texts_are_not_broadcast(spark, sf_dir):
    found = detail.sql_executions(application_log(spark, sf_dir))
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0]  # the last join brings the texts
    roots = {json.loads(r.plan)["nodeName"] for r in found.collect()}
    assert roots == {"Execute InsertIntoHadoopFsRelationCommand"}


def test_plans_are_not_moved_to_find_the_last_ones(spark, sf_dir):
    found = tree.plans(application_log(spark, sf_dir))
    steps = found._jdf.queryExecution().sparkPlan().toString()
    assert "LeftAnti" in steps and "Aggregate" not in steps and "SortMergeJoin" not in steps
    assert sorted((r.app_key, r.execution_id) for r in found.collect()) == [("application_1", 5), ("application_1", 6)]


def test_levels_of_a_plan_are_taken_in_one_step(spark, sf_dir):
    """Each step of its own would copy all nodes found by then and all that lies below."""
    nodes = tree.plan_nodes(application_log(spark, sf_dir))
    steps = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("Project [") < 6
    assert sorted(r.depth for r in nodes.filter("execution_id = 5").collect()) == list(range(9))


def test_start_events_come_with_the_plans(spark, sf_dir):
    alone = application_log(spark, sf_dir)
    expected = sorted(alone.view("sql_start").collect())
    ordering.clear(spark)
    log = application_log(spark, sf_dir)
    assert log.view("sql_plan").count() == 2
    before = len(ordering.written())
    assert sorted(log.view("sql_start").collect()) == expected
    assert len(ordering.written()) == before  # no line is parsed again


def test_driver_updates_are_not_sorted(spark, sf_dir):
    log = application_log(spark, sf_dir)
    for per_execution in (True, False):
        values = tree.driver_values(log, per_execution)
        assert "SortAggregate" not in values._jdf.queryExecution().sparkPlan().toString()
    assert {r.acc_id - 120: r.value for r in values.filter("acc_id between 120 and 139").collect()} == {
        0: 0, 1: 40, 2: 6, 3: 600, 4: 6144, 6: 2, 7: 20, 9: 6, 10: 6, 11: 1500000000, 12: 6, 13: 1}
