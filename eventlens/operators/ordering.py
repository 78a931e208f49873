"""Ordered computations over groups of any size.

A running sum or a rank over one group needs the group in order, but one application can hold a large part of
all rows, so the group must not be collected into one task. Rows are range-partitioned by (keys, order): a large
group then spreads over many partitions ("chunks"), each chunk is worked on separately, and only one summary row
per (group, chunk) is carried from chunk to chunk. The number of chunks is the number of shuffle partitions.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "chunk"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary folder where none is set."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="eventlens-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


_WRITTEN: list[str] = []
_CLEARED = 0


def new_path(spark: SparkSession) -> str:
    """A new folder in the shared folder, for rows that are read more than once; `clear` deletes it."""
    path = f"{shared_folder(spark)}/eventlens-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written() -> list[str]:
    """The folders that this process has written to the shared folder and not deleted yet."""
    return list(_WRITTEN)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete such folders. DataFrames built on them can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)


def clear(spark: SparkSession) -> None:
    """Delete all that the session has written there. Logs and results built before can't be read any more."""
    global _CLEARED
    _CLEARED += 1
    delete(spark, written())


def times_cleared() -> int:
    """Tells those who remember written folders that these are gone."""
    return _CLEARED


#: While rows are written that are read again: their shuffle files go as soon as they are written, and variants stay whole, as
#: splitting them into columns and putting them together again takes longer than all that is done with them.
STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.variant.writeShredding.enabled": "false",
}


@contextmanager
def storing(spark: SparkSession):
    """These settings for as long as rows are written."""
    before = {name: spark.conf.get(name, None) for name in STORING}
    for name, value in STORING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared checkpoint folder and go on from there.

    The files survive the loss of executors. As parquet they are computed in one pass, later steps read only the
    columns they need, and Spark knows their size when it chooses joins. The shuffle files on the way don't wait for the
    driver to collect its garbage. `discard` deletes the rows.
    """
    path = new_path(df.sparkSession)
    with storing(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.checkpoint_folder = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete the files of checkpointed DataFrames that nothing will read any more."""
    for df in stored:
        delete(df.sparkSession, [df.checkpoint_folder])


def in_chunks(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Add `chunk`: ascending with the order inside every group, and no chunk larger than a range partition.

    The range bounds are sampled, so the chunk numbers are fixed by a checkpoint before they are used twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return checkpointed(ranged)


def before_chunk(keys: list[str]) -> Window:
    """All earlier chunks of a group; at most one row per chunk, so the window is small."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """row_number over the whole table without bringing it into one task. The order must be total."""
    chunked = in_chunks(df, [], order)
    sizes = chunked.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    starts = sizes.select(
        CHUNK,
        F.coalesce(
            F.sum("_n").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    in_chunk = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return (
        chunked.join(F.broadcast(starts), CHUNK)  # one row per shuffle partition
        .withColumn(name, (F.col("_start") + in_chunk).cast("bigint"))
        .drop(CHUNK, "_start")
    )


def last_before(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """For every row the last non-null `value` on an earlier row of its group (an as-of lookup)."""
    chunked = in_chunks(df, keys, [order])
    group = [*keys, CHUNK]
    carried = (
        chunked.groupBy(*group)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .select(*group, F.last("_last", ignorenulls=True).over(before_chunk(keys)).alias("_carried"))
    )
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(carried, group)
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(earlier), F.col("_carried")))
        .drop(CHUNK, "_carried")
    )


#: Groups of more rows than this are spread over chunks by an as-of lookup; smaller ones are sorted in one piece.
LARGE_GROUP = 1 << 18
#: Groups are counted in so many buckets before any is counted alone.
BUCKETS = 1 << 16


def _large_groups(rows: DataFrame, keys: list[str], large: int) -> DataFrame | None:
    """Keys of the groups of more than `large` rows, stored; None if there are none.

    Such a group fills a bucket of the hashes of the keys by itself. Counting the buckets moves BUCKETS rows of a task at
    most, where counting the groups would move a row for each; only groups in buckets that are full are counted alone.
    """
    hashed = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    more = F.col("count") > large
    full = checkpointed(hashed.groupBy("_bucket").count().where(more).select("_bucket"))
    hot = None
    if full.limit(1).count():
        of_full = hashed.join(F.broadcast(full), "_bucket", "left_semi")  # BUCKETS rows at most
        hot = checkpointed(of_full.groupBy(*keys).count().where(more).select(*keys))
    discard(full)
    if hot is not None and not hot.limit(1).count():
        discard(hot)
        hot = None
    return hot


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], order: str, value: str, large: int = LARGE_GROUP) -> DataFrame:
    """Add to each row the `value` of the latest event of its group that comes strictly before it; rows without one go.

    Rows and events (keys, order, value) are sorted together, so that the work grows with their number, whether a group
    has one event or as many as rows. Each group is dealt out by its keys; the few groups that are large, which are
    counted first, by ranges of the order as well.
    """
    events = events.where(F.col(value).isNotNull()).dropna(subset=keys)
    together = rows.withColumns({value: F.lit(None).cast(events.schema[value].dataType), "_event": F.lit(False)}).unionByName(
        events.select(*keys, order, value, F.lit(True).alias("_event")), allowMissingColumns=True)
    # an event at the place of a row does not come before it
    together = together.withColumn("_at", F.struct(order, "_event"))
    hot = _large_groups(together, keys, large)
    kept = [*rows.columns, value]

    def found(looked_up: DataFrame) -> DataFrame:
        return looked_up.where(~F.col("_event") & F.col("_found").isNotNull()).withColumn(value, F.col("_found")).select(*kept)

    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sorted_whole = lambda part: found(part.withColumn("_found", F.last(value, ignorenulls=True).over(earlier)))
    if hot is None:
        return sorted_whole(together)
    spread = last_before(together.join(hot, keys, "left_semi"), keys, "_at", value, "_found")
    return sorted_whole(together.join(hot, keys, "left_anti")).unionByName(found(spread))


SALTS = 16


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Equi join with a side of one row per key. A key may hold a large part of `rows`: these are dealt to SALTS groups
    by a hash of `spread_by`, and the lookup's row stands in each of them."""
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.hash(spread_by), F.lit(SALTS)))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")
