import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators import sizing


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.repartition(2).select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_memory(spark):
    texts = ["4g", "512m", "1.5k", "2T", "1gb", "1000", "", None, "xg"]
    assert values(spark, texts, S.memory_bytes) == [4294967296, 536870912, 1536, 2199023255552, 0, 1000, 0, 0, 0]


def test_overhead(spark):
    df = spark.createDataFrame([(None,), ("1g",)], "o string")
    got = [r[0] for r in df.select(S.default_overhead(F.col("o"), S.bigint(2 * S.GIB))).collect()]
    assert sorted(got) == [384 * S.MIB, S.GIB]


def test_format_bytes(spark):
    sizes = [0, 12, 1024, 1025, 1048577, 5 * S.GIB, 3 * S.TIB, 2048 * S.TIB]
    assert values(spark, sizes, S.format_bytes, "bigint") == [
        "0.00 ", "12.00 ", "1024.00 ", "1.00 KB", "1.00 MB", "5.00 GB", "3.00 TB", "2.00 B",
    ]


def test_round2_is_pythons(spark):
    rng = random.Random(1)
    xs = [1.005, 2.675, 0.125, -0.375, 0.0] + [rng.randrange(10**9) / 1000.0 for _ in range(2000)]
    assert values(spark, xs, S.round2, "double") == [round(x, 2) for x in xs]


def test_unit_rounds_half_up(spark):
    assert values(spark, [8, 1024, 0, 1536 * 1024], lambda c: S.in_unit(c, "KB"), "bigint") == [0.007813, 1.0, 0.0, 1536.0]


def test_operation_names(spark):
    names = ["SortMergeJoin", "TakeOrderedAndProject", "BroadcastExchange", "Scan parquet ", "CollectLimit",
             "BatchScan", "HashAggregate", "WriteFiles", "LocalTable", "BroadcastHashJoin", "Scan ORC"]
    assert values(spark, names, S.operation_name) == [
        "Sort", "Select", "Shuffle", "Read Parquet", "Limit", "Read", "Aggregate", "Write", "LocalTable", "Join", "Read Orc",
    ]


def test_write_target(spark):
    insert = "Execute InsertIntoHadoopFsRelationCommand file:/x/out, false, Parquet, [path=file:/x/out], Overwrite, [a, b]"
    save = "SaveIntoDataSourceCommand org.apache.CsvFileFormat@1, Append"
    df = spark.createDataFrame([
        ("Execute InsertIntoHadoopFsRelationCommand", insert), ("SaveIntoDataSourceCommand", save), ("Other", "x, y"),
        ("Execute InsertIntoHadoopFsRelationCommand", ""),
    ], "n string, s string")
    got = [tuple(r) for r in df.select(*S.write_target(F.col("n"), F.col("s"))).collect()]
    unknown = ("Unknown",) * 3
    assert got == [("file:/x/out", "Parquet", "Overwrite"), ("Unknown", "CSV", "Append"), unknown, unknown]


@pytest.mark.parametrize("text, partitioning, number", [
    ("Exchange hashpartitioning(a#1, 4), ENSURE_REQUIREMENTS, [plan_id=1]", "hashpartitioning(a#1, 4)", "4"),
    ("Exchange SinglePartition, ENSURE_REQUIREMENTS", "SinglePartition", "Unknown"),
    ("Exchange rangepartitioning(a#1 ASC NULLS FIRST, 200)", "rangepartitioning(a#1 ASC NULLS FIRST, 200)", "200"),
    ("Something", "Unknown", "Unknown"),
])
def test_exchange(spark, text, partitioning, number):
    df = spark.createDataFrame([(text,)], "s string").select(S.exchange_partitioning(F.col("s")).alias("p"))
    got = df.select("p", S.exchange_partitions(F.col("p"))).first()
    assert tuple(got) == (partitioning, number)


def test_texts(spark):
    assert values(spark, ["Filter (a > 1) ", "Scan"], S.filter_condition) == ["(a > 1)", "Unknown"]
    assert values(spark, ["Project [a, b[0]]", "Project"], S.project_fields) == ["a, b[0]", "Unknown"]
    assert values(spark, ["HashAggregate(keys=[a#1, b], functions=[sum(c)])", "x"], S.aggregate_keys) == ["a#1, b", "Unknown"]
    assert values(spark, ["Coalesce 12", "Coalesce x", "y"], S.coalesce_partitions) == ["12", "Unknown", "Unknown"]
    assert values(spark, ["job-2024-01-02-x", "job"], S.name_without_date) == ["job-x", "job"]
    assert values(spark, ["app_1"], lambda c: S.history_link("http://h/", c)) == ["http://h/history/app_1/"]


def test_sizing_of_one_terabyte(spark):
    shuffle = spark.createDataFrame([("a", S.TIB)], "app_key string, max_shuffle bigint")
    fixed = sizing.sizing_static(shuffle).first()
    assert (fixed.partitions, fixed.cores, fixed.executors) == (8192, 820, 205)
    assert round(fixed.executor_memory / S.MIB) == 5420
    varying = sizing.sizing_dynamic(shuffle).first()
    assert (varying.partitions, varying.cores, varying.executors) == (16384, 1639, 410)


def test_memory_breakdown(spark):
    heaps = spark.createDataFrame([(f"a{g}", g * S.GIB) for g in (2, 6, 10)], "app_key string, executor_memory bigint")
    none = spark.createDataFrame([], "app_key string, peak_heap bigint"), spark.createDataFrame([], "app_key string, spill_memory bigint")
    got = {r.app_key: (round(r.overhead / S.MIB), round(r.unified / S.MIB)) for r in sizing.memory_breakdown(heaps, *none).collect()}
    assert got == {"a2": (384, 1049), "a6": (614, 3506), "a10": (1024, 5964)}
