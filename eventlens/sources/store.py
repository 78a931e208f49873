"""Typed events of log files that were parsed before, kept across sessions and added to in batches.

    <folder>/events/batch=<b>/event=<name>/   typed columns of a batch's files
    <folder>/manifest/batch=<b>/              path, length and modification time of the files in it

A batch counts once its part of the manifest is there, which one renaming puts in place: a batch that broke off leaves
events that nothing reads. Of a file that is in several batches, the latest counts. Two sessions may add the same file at
once; it still counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.sources.events import event_schema, store_events

FILE = ["path", "length", "modified"]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed batches, in order. They are few: one for each time that files were added."""
    where, system = _file_system(spark, f"{folder}/manifest")
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName().removeprefix("batch=") for s in system.listStatus(where) if s.getPath().getName().startswith("batch="))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all committed batches: path, length, modified, batch."""
    known = batches(spark, folder)
    if not known:
        return spark.createDataFrame([], "path string, length bigint, modified timestamp, batch string")
    parts = [spark.read.parquet(f"{folder}/manifest/batch={b}").select(*FILE, F.lit(b).alias("batch")) for b in known]
    return reduce(DataFrame.unionByName, parts)


def live_files(listed: DataFrame, folder: str) -> DataFrame:
    """(path, batch) of the listed files that are stored as they are now."""
    latest = manifest(listed.sparkSession, folder).groupBy(*FILE).agg(F.max("batch").alias("batch"))
    return latest.join(listed.select(*FILE), FILE, "left_semi").select("path", "batch")


def ingest(listed: DataFrame, folder: str, parse: Callable[[DataFrame, bool], DataFrame]) -> int:
    """Store the events of the listed files that are not stored as they are now, as one batch; returns their number.

    `parse` gets these files, and whether nothing is stored yet so that they are all, and returns their lines (app_key,
    seq, value and more columns).
    """
    spark = listed.sparkSession
    known = batches(spark, folder)
    new = listed.join(manifest(spark, folder), FILE, "left_anti") if known else listed
    n = new.count()
    if not n and known:
        return 0
    number = int(known[-1].split("-")[0]) + 1 if known else 1
    batch = f"{number:08d}-{uuid.uuid4().hex}"
    store_events(parse(new, not known), f"{folder}/events/batch={batch}", rebalance=True)
    pending = f"{folder}/pending/{batch}"
    new.select(*FILE).write.parquet(pending)
    target, system = _file_system(spark, f"{folder}/manifest/batch={batch}")
    system.mkdirs(target.getParent())
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(pending), target):
        raise OSError(f"{pending} can't be renamed to {target}")
    return n


def live_events(listed: DataFrame, folder: str) -> DataFrame:
    """Events of the listed files as they are now; what batches hold of changed or deleted files is left out."""
    spark = listed.sparkSession
    known = batches(spark, folder)
    # given, as a batch without any line has no file that tells the columns
    schema = T.StructType.fromDDL("app_key string, seq decimal(38,0), folder string, file string, error string").add(
        "e", event_schema()).add("batch", "string").add("event", "string")
    events = spark.read.schema(schema).option("basePath", f"{folder}/events").parquet(*[f"{folder}/events/batch={b}" for b in known])
    stored = manifest(spark, folder).select("path", "batch").distinct()
    dead = stored.join(live_files(listed, folder), ["path", "batch"], "left_anti")
    if not dead.limit(1).count():
        return events
    # a row for each changed or deleted file
    return events.join(dead.select(F.col("path").alias("file"), "batch"), ["file", "batch"], "left_anti")
