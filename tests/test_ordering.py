"""Ordered operators against plain Python, with one application holding most rows."""

import random
import statistics
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventlens.operators import lifecycle, ordering, report


def _events(seed):
    rng = random.Random(seed)
    events, apps = [], []
    for i in range(3000):
        apps.append("hot" if rng.random() < 0.7 else f"app{rng.randrange(5)}")
        kind = rng.choice(["Added", "Removed"])
        events.append({"Event": f"SparkListenerExecutor{kind}", "Timestamp": i, "Executor ID": rng.choice(["driver", "1", "2", "3", "4", "5"])})
    return events, apps


def test_executor_counts_match_a_replay(make_log):
    events, apps = _events(3)
    alive, largest, plain, plain_max, floor, series = {}, {}, {}, {}, {}, {}
    for e, app in zip(events, apps):
        add, who = e["Event"].endswith("Added"), e["Executor ID"]
        floor[app] = floor.get(app, 0) + 1 if add else max(0, floor.get(app, 0) - 1)
        series.setdefault(app, []).append(floor[app])
        if who == "driver":
            continue
        group = alive.setdefault(app, set())
        (group.add if add else group.discard)(who)
        largest[app] = max(largest.get(app, 0), len(group))
        plain[app] = plain.get(app, 0) + (1 if add else -1)
        plain_max[app] = max(plain_max.get(app, 0), plain[app])
    log = make_log(events, apps)
    assert {r[0]: r[1] for r in lifecycle.max_active_executors(log).collect()} == largest
    assert {r[0]: r[1] for r in lifecycle.max_counted_executors(log).collect()} == plain_max
    got = {}
    for r in lifecycle.executor_timeline(log).orderBy("app_key", "seq").collect():
        got.setdefault(r.app_key, []).append(r["count"])
    assert got == series


def test_last_before(spark):
    rng = random.Random(5)
    rows = [("k" if rng.random() < 0.8 else "m", i, rng.randrange(9) if rng.random() < 0.1 else None) for i in range(2000)]
    last, expected = {}, {}
    for key, i, value in rows:
        expected[i] = last.get(key)
        if value is not None:
            last[key] = value
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint").repartition(5)
    got = {r.seq: r.found for r in ordering.last_before(df, ["k"], "seq", "v", "found").collect()}
    assert got == expected


def test_global_rank(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, i int").repartition(6)
    got = {r.i: r.place for r in ordering.global_rank(df, [F.col("x").desc(), F.col("i").asc()], "place").collect()}
    assert got == {i: n for n, (x, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), start=1)}


def test_exact_medians(spark):
    rng = random.Random(9)
    rows = [(m, float(rng.choice([0, 0, 0, rng.randrange(1000)]))) for m, n in (("a", 501), ("b", 400), ("c", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows + [("d", None)], "metric string, value double").repartition(4)
    got = {r.metric: r.median for r in report.exact_medians(df).collect()}
    assert got == {m: statistics.median(v for n, v in rows if n == m) for m in "abc"}


@pytest.mark.parametrize("large", [100, 1 << 18])
def test_as_of_with_many_events_in_one_group(spark, large):
    """One stage is listed 100,000 times, others once or never; groups above `large` rows are spread over chunks."""
    rng = random.Random(6)
    events = [("hot", 2 * i, i) for i in range(100_000)] + [("once", 50, 7), ("late", 10**6, 8), (None, 1, 9), ("void", 1, None)]
    rows = [("hot", rng.randrange(-5, 200_010), i) for i in range(3000)] + [(g, s, -s) for g in ("once", "late", "void", "never", None) for s in (0, 50, 51, 99)]
    got = ordering.as_of(
        spark.createDataFrame(rows, "g string, seq bigint, row bigint"), spark.createDataFrame(events, "g string, seq bigint, value bigint"),
        ["g"], "seq", "value", large)
    expected = [(g, s, r, min((s - 1) // 2, 99_999)) for g, s, r in rows if g == "hot" and s > 0]
    expected += [("once", s, -s, 7) for s in (51, 99)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("buckets", [1, 3, 1 << 16])
def test_large_groups_are_found_whatever_else_is_in_their_bucket(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering, "BUCKETS", buckets)
    sizes = {"a": 11, "b": 10, "c": 1, "d": 40, None: 12}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    assert {r.g for r in ordering._large_groups(rows, ["g"], 10).collect()} == {"a", "d", None}
    assert ordering._large_groups(rows, ["g"], 40) is None


def test_shuffle_files_go_when_rows_are_stored(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in disk.getAllBlocks().mkString(" ").split() if name.startswith("shuffle_")}
    settings = {name: spark.conf.get(name) for name in ordering.STORING}
    before = shuffled()
    stored = ordering.checkpointed(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and stored.count() == 10
    assert {name: spark.conf.get(name) for name in ordering.STORING} == settings


def test_stored_variants_stay_whole(spark):
    plans = spark.range(20).select(F.parse_json(F.lit('{"a": 1, "b": [{"c": "x"}]}')).alias("v"))
    stored = ordering.checkpointed(plans)
    kind = pq.read_schema(stored.inputFiles()[0].removeprefix("file://").removeprefix("file:")).field("v").type
    assert {kind.field(i).name for i in range(kind.num_fields)} == {"value", "metadata"}
    assert {r[0] for r in stored.select(F.to_json("v")).collect()} == {'{"a":1,"b":[{"c":"x"}]}'}
