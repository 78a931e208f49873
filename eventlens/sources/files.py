"""Files of a folder as rows, listed and opened by the tasks that need them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.ordering import checkpointed, discard

#: Bytes of decoded text that a task holds at a time, beside the line it is in.
CHUNK = 4 << 20
FILE_DDL = "path string, file_name string, folder string, length bigint, modified timestamp"


def as_spark_path(path: Column) -> Column:
    """The form in which Spark's own scans give the path of a file."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of the cluster's file system where it names none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and modification time of files or of folders of files: changes with what they hold."""
    out = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((path, system.getContentSummary(where).getLength(), system.getFileStatus(where).getModificationTime()))
    return tuple(out)


def opened(uri: str):
    """File system of a URI, the path within it, and what to put before such paths to get URIs again.

    Local files, hdfs and viewfs (libhdfs), s3 and the like: what pyarrow reaches from a task.
    """
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    if scheme in ("s3a", "s3n"):
        system, path = fs.FileSystem.from_uri(f"s3:{rest}")
        return system, path, f"{scheme}://"
    system, path = fs.FileSystem.from_uri(uri)
    authority = rest.removeprefix("//").partition("/")[0]
    return system, path, f"{scheme}://{authority}" if path.startswith("/") else f"{scheme}://"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders hold; folders among it are marked."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, path, before = opened(uri)
            found = system.get_file_info(fs.FileSelector(path, recursive=False))
            yield pa.RecordBatch.from_arrays([
                pa.array([before + x.path for x in found], pa.string()),
                pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()),
                pa.array([x.size or 0 for x in found], pa.int64()),
                pa.array([(x.mtime_ns or 0) // 1000 for x in found], pa.int64()),
            ], names=["path", "is_folder", "length", "modified_us"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, empty ones too, which Spark's scans leave out: path, file_name, folder, length, modified.

    Level by level: each folder is listed by a task, and the folders found are the rows of the next level. Each level is
    kept in the checkpoint folder, so that all uses see one listing.
    """
    uri = qualified(spark, root)
    try:
        opened(uri)
    except (pa.ArrowInvalid, OSError, ImportError):
        return _listed_by_driver(spark, uri)
    folders, levels, wide = spark.createDataFrame([(uri,)], "path string"), [], 1
    while True:
        found = checkpointed(folders.repartition(wide).mapInArrow(
            _entries, "path string, is_folder boolean, length bigint, modified_us bigint"))
        levels.append(found.where(~F.col("is_folder")))
        folders = found.where("is_folder").select("path")
        n = folders.count()
        if not n:
            break
        wide = min(n, 16 * spark.sparkContext.defaultParallelism)
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    path = as_spark_path(F.col("path"))
    return _with_names(files.select(path.alias("path"), "length", F.timestamp_micros("modified_us").alias("modified")))


def _listed_by_driver(spark: SparkSession, uri: str) -> DataFrame:
    """The same from Hadoop's client, for stores that tasks can't reach but through Spark's scans."""
    root = spark._jvm.org.apache.hadoop.fs.Path(uri)
    listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, length bigint, ms bigint")
    return _with_names(rows.select(as_spark_path(F.col("path")).alias("path"), "length", F.timestamp_millis("ms").alias("modified")))


def _with_names(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"),
        "length", "modified")


def _write_files(folder: str):
    """Write the files whose lines a task gets, in its order; a file is put in place when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path, _ = opened(folder)
        name, stream, n, done = None, None, 0, []

        def finish() -> None:
            stream.close()
            system.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            done.append((name, n))

        attempt = uuid.uuid4().hex
        for batch in batches:
            for file_name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file_name != name:
                    if stream is not None:
                        finish()
                    name, n = file_name, 0
                    stream = system.open_output_stream(f"{path}/.{name}.{attempt}")
                if value is not None:
                    stream.write(value.encode("utf-8", "replace") + b"\n")
                    n += 1
        if stream is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file_name", "lines"])

    return write


def write_files(lines: DataFrame, folder: str) -> DataFrame:
    """Text files of given names from rows (file_name, seq, value), lines in the order of seq; returns their lines by name.

    A null value adds no line, so that a file can be empty. Each file is one task's work, as a file can have one writer.
    """
    spark = lines.sparkSession
    where = qualified(spark, folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(where)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.select("file_name", "seq", "value").repartition(n, "file_name").sortWithinPartitions("file_name", "seq")
    return checkpointed(ordered.select("file_name", "value").mapInArrow(_write_files(where), "file_name string, lines bigint"))


# --- zstd --------------------------------------------------------------------------------------------------------


def decoded_chunks(uri: str, chunk: int) -> Iterator[bytes]:
    """Text of a compressed file, at most `chunk` bytes at a time; frames that follow each other are one text."""
    system, path, _ = opened(uri)
    with system.open_input_stream(path, compression=None) as raw, pa.CompressedInputStream(raw, "zstd") as stream:
        while data := stream.read(chunk):
            yield data


def lines_of(chunks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lines of a text given in pieces. They end with a line feed, a carriage return, or both, as in Spark's text source."""
    rest = [b""]  # pieces of the line that is not complete yet
    held = b""  # a carriage return at the end of a piece may be half of a line's end
    for data in chunks:
        data = held + data
        held = b"\r" if data.endswith(b"\r") else b""
        data = data[: len(data) - len(held)]
        if b"\r" in data:
            data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        first, *more = data.split(b"\n")
        rest.append(first)
        if more:
            yield [b"".join(rest), *more[:-1]]
            rest = [more[-1]]
    if held:
        yield [b"".join(rest)]
    elif last := b"".join(rest):
        yield [last]


def _decode(chunk: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, first: int, values: list, error: str | None = None) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([
                pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
                pa.array(values, pa.string()), pa.array([error] * n, pa.string()),
            ], names=["path", "line_no", "value", "error"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                line_no = 0
                try:
                    for lines in lines_of(decoded_chunks(path, chunk)):
                        yield rows(path, line_no, [line.decode("utf-8", "ignore") for line in lines])
                        line_no += len(lines)
                except (OSError, ValueError) as problem:
                    yield rows(path, line_no, [None], str(problem) or type(problem).__name__)

    return decode


def zstd_rows(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Lines (path, line_no, value, error) of zstd files (path) of any size, each streamed by one task.

    A zstd stream can't be entered in its middle, so a file is one task's work, but the task holds no more than one chunk
    and the line it is in. A file that can't be opened or read to its end gives what it held before that and a row with the
    error.
    """
    paths = checkpointed(files.select("path"))
    n = paths.count()
    if not n:
        discard(paths)
        return files.sparkSession.createDataFrame([], "path string, line_no bigint, value string, error string")
    parts = min(n, 64 * files.sparkSession.sparkContext.defaultParallelism)
    return paths.repartition(parts).mapInArrow(_decode(chunk), "path string, line_no bigint, value string, error string")
