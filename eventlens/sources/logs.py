"""Event-log files: plain, part files, rolling files, zstd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.ordering import new_path
from eventlens.sources import store
from eventlens.sources.events import EventLog
from eventlens.sources.files import CHUNK, as_spark_path, list_files, zstd_rows

ROW_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id
# The place of rolling files without a number, and how names of log files begin.
NO_INDEX = 999999
LOG_PREFIXES = ["application_", "appstatus_application_", "events_", "eventlog_v2_"]


def is_log_name(name: Column) -> Column:
    accepted = F.lit(False)
    for prefix in LOG_PREFIXES:
        accepted = accepted | name.startswith(prefix)
    return accepted & ~name.startswith(".")


def log_name(file_name: Column) -> Column:
    """Application of a file: the name without compression suffix, `appstatus_` and `events_<n>_`."""
    return F.regexp_replace(file_name, r"^(appstatus_|events_\d+_)|(\.zstd|\.zst)$", "")


def group_name(file_name: Column) -> Column:
    """Application id of a plain or part file (`..._part_001` is dropped)."""
    # Fixed value: the form of an application id.
    return F.nullif(F.regexp_extract(file_name, r"^(application_\d+_\d+(_\d+)?)", 1), F.lit(""))


def file_index(file_name: Column) -> Column:
    """Position of a file among the files of its application, by number (10 after 2)."""
    rolling = F.regexp_extract(file_name, r"^events_(\d+)_", 1).try_cast("bigint")
    part = F.regexp_extract(file_name, r"_part_(\d+)", 1).try_cast("bigint") + 1
    missing = F.when(file_name.startswith("events_"), F.lit(NO_INDEX)).otherwise(F.lit(0))
    return F.coalesce(rolling, part, missing)


def _place(index: Column, offset: Column) -> Column:
    """Order of a line in its application: file by file, whatever their size."""
    return (index.cast("decimal(18,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + offset.cast("decimal(20,0)")).cast("decimal(38,0)")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _app_key(file_name: Column, group_parts: bool) -> Column:
    if group_parts:
        return F.coalesce(group_name(file_name), log_name(file_name))
    return log_name(file_name)


def _valid_text(value: Column) -> Column:
    """Undecodable bytes are dropped."""
    clean = F.replace(F.call_function("make_valid_utf8", value), F.lit("�"), F.lit(""))
    return F.when(F.call_function("is_valid_utf8", value), value).otherwise(clean)


def _text_lines(spark: SparkSession, path: str | list[str], group_parts: bool) -> DataFrame:
    name = F.col("file_name")
    file_name = F.col("_metadata.file_name")
    lines = (
        spark.read.option("recursiveFileLookup", True).text(path)
        # only whole files are dropped here (Spark does so while listing), so row numbers are not disturbed
        .filter(is_log_name(file_name) & ~file_name.startswith("appstatus_") & ~file_name.endswith(".zstd"))
        .select(
            file_name.alias("file_name"),
            as_spark_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            # A scan partition holds at most one split's worth of bytes and a line takes at least one byte, so
            # the row number stays below the distance to the file's next split: block_start + row ascends.
            F.monotonically_increasing_id().bitwiseAND(ROW_IN_PARTITION).alias("row"),
            "value",
        )
    )
    return lines.select(
        _app_key(name, group_parts).alias("app_key"),
        _folder(F.col("file")).alias("folder"),
        "file",
        _place(file_index(name), F.col("block_start") + F.col("row")).alias("seq"),
        _valid_text(F.col("value")).alias("value"),
        F.lit(None).cast("string").alias("error"),
    )


def zstd_lines(files: DataFrame, group_parts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Lines of the `.zstd` ones among files (path, file_name), with an `error` for files that cannot be read to the end.

    The text source would split a large `.zstd` file, which cannot be decoded from the middle.
    """
    name = F.element_at(F.split("file", "/"), -1)
    rows = zstd_rows(files.filter(F.col("file_name").endswith(".zstd")), chunk).withColumnRenamed("path", "file")
    return rows.select(
        _app_key(name, group_parts).alias("app_key"),
        _folder(F.col("file")).alias("folder"),
        "file",
        _place(file_index(name), F.col("line_no")).alias("seq"),
        "value",
        "error",
    )


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, folder, length and modification time of every log file below a folder, empty ones too."""
    return list_files(spark, path).filter(is_log_name(F.col("file_name")))


def _keyed(rows: DataFrame, same_name: DataFrame) -> DataFrame:
    """Logs of one name in several folders are told apart by their folder."""
    apart = rows.join(same_name.withColumn("_apart", F.lit(True)), "app_key", "left")
    key = F.when(F.col("_apart"), F.concat_ws("/", "folder", "app_key")).otherwise(F.col("app_key"))
    return apart.withColumn("app_key", key).drop("_apart", "folder")


def read_logs(
    spark: SparkSession, path: str, group_parts: bool = False, stored_in: str | None = None, chunk: int = CHUNK
) -> EventLog:
    """All event logs below a folder: plain, part and rolling files, plain or compressed (`.zst`, `.zstd`).

    `group_parts` joins the part files of one application; otherwise every plain file is its own log. Logs that share
    a name but not a folder have the folder before their key. The first use of a view parses all lines once and
    stores them as typed columns in the shared folder; files that cannot be read to the end are noted on the way.

    With `stored_in`, a folder for these columns that outlives the session, only files that are new there or have changed
    since are parsed, as one batch; what was stored of changed and deleted files no longer counts.
    """
    listed = log_files(spark, path)
    files = listed.select(_app_key(F.col("file_name"), group_parts).alias("app_key"), "folder").distinct()
    same_name = files.groupBy("app_key").agg(F.count("*").alias("_folders")).filter("_folders > 1").select("app_key")
    # the listing has a row for each file, and few names are shared, if any
    shared = same_name.limit(1).count() > 0

    def apart(rows: DataFrame) -> DataFrame:
        return _keyed(rows, same_name) if shared else rows.drop("folder")

    def parsed(new: DataFrame, paths: str | list[str]) -> DataFrame:
        lines = zstd_lines(new, group_parts, chunk)
        return _text_lines(spark, paths, group_parts).unionByName(lines) if paths else lines

    def stored(log: EventLog) -> DataFrame:
        where = stored_in or new_path(spark)
        # nothing but the names of new files is collected, which Spark's scan holds on the driver as well
        store.ingest(listed, where, lambda new, all_new: parsed(new, path if all_new else [
            r.path for r in new.filter(~F.col("file_name").endswith(".zstd") & (F.col("length") > 0)).select("path").collect()]))
        return apart(store.live_events(listed, where)).drop("file", "batch")

    def errors() -> DataFrame:
        return log.stored_events().filter("event = 'other' and error is not null").groupBy("app_key").agg(F.min("error").alias("error"))

    lines = lambda: apart(parsed(listed, path)).filter(F.col("error").isNull()).drop("error", "file")
    log = EventLog(lines, apart(files), stored=stored, errors=errors)
    return log


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Logs a user can pick: plain logs and rolling logs (path of the `appstatus_` anchor), newest first."""
    files = log_files(spark, path)
    name = F.col("file_name")
    plain = files.filter(name.startswith("application_")).select(name.alias("filename"), "modified", "path")
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    rolling = files.filter(name.rlike(r"^(events_\d+_|appstatus_)application_")).select(
        log_name(name).alias("filename"),
        "modified",
        F.concat(folder, F.lit("appstatus_"), log_name(name)).alias("path"),
    )
    return (
        plain.unionByName(rolling)
        .groupBy("filename", "path")
        .agg(F.max("modified").alias("modified"))
        .select(
            log_name(F.col("filename")).alias("app_key"),
            "filename",
            F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("date"),
            "path",
        )
        .orderBy(F.desc("date"), "filename")
    )


def resolve(inventory: DataFrame, names: DataFrame) -> DataFrame:
    """Paths of requested names (`filename`): the plain file first, else the rolling anchor, else null."""
    anchor = F.element_at(F.split("path", "/"), -1).startswith("appstatus_")
    known = inventory.groupBy("filename").agg(F.min_by("path", anchor).alias("path"))
    return names.select("filename").join(known, "filename", "left")


def event_type_counts(log: EventLog) -> DataFrame:
    """Number of lines per event type; lines that are no JSON objects have none."""
    return log.lines.groupBy(F.get_json_object("value", "$.Event").alias("event")).agg(F.count("*").alias("lines"))


def log_groups(log: EventLog) -> DataFrame:
    """Lines and time span of each application's files."""
    ts = F.get_json_object("value", "$.Timestamp").try_cast("bigint")
    return log.lines.groupBy("app_key").agg(
        F.count("*").alias("lines"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def app_names(log: EventLog, requested: DataFrame | None = None) -> DataFrame:
    """Application name of each log: that of its first start event, "Unknown" without one.

    A log that cannot be read to its end has "Read Error". With `requested` (app_key), logs that do not exist give
    "File Not Found". The whole log is searched.
    """
    first = log.view("app_start").groupBy("app_key").agg(
        F.min_by(F.coalesce("app_name", F.lit("Unknown")), "seq").alias("app_name")
    )
    names = log.apps().join(first, "app_key", "left").select(
        "app_key", F.coalesce("app_name", F.lit("Unknown")).alias("app_name")
    )
    if log.errors() is not None:
        broken = log.errors().select("app_key", F.lit(True).alias("_broken"))
        names = names.join(broken, "app_key", "left").select(
            "app_key", F.when(F.col("_broken"), F.lit("Read Error")).otherwise(F.col("app_name")).alias("app_name"))
    if requested is None:
        return names
    return requested.select("app_key").distinct().join(names, "app_key", "left").select(
        "app_key", F.coalesce("app_name", F.lit("File Not Found")).alias("app_name")
    )
