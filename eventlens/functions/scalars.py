"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
MIB = 1024**2
GIB = 1024**3
TIB = 1024**4

# Unit names and their size in bytes.
UNIT_BYTES = {"B": 1, "KB": KIB, "MB": MIB, "GB": GIB, "TB": TIB}

# File formats that are recognised by a part of their class name, in order of precedence.
SCAN_FORMATS = [
    ("Parquet", "Parquet"),
    ("Orc", "ORC"),
    ("BinaryFile", "Binary"),
    ("Json", "JSON"),
    ("Csv", "CSV"),
]
SAVE_FORMATS = [("Parquet", "Parquet"), ("Orc", "ORC"), ("Csv", "CSV"), ("Json", "JSON")]

# Part of a plan node's name -> operation, first match wins (so SortMergeJoin is a "Sort").
OPERATION_NAMES = [
    ("Filter", "Filter"),
    ("Project", "Select"),
    ("Aggregate", "Aggregate"),
    ("Exchange", "Shuffle"),
    ("InsertInto", "Write"),
    ("Write", "Write"),
    ("AdaptiveSparkPlan", "Adaptive Query Execution"),
    ("Union", "Union"),
    ("Sort", "Sort"),
    ("Join", "Join"),
    ("Window", "Window"),
    ("Limit", "Limit"),
    ("Collect", "Collect"),
    ("Command", "Command"),
]


def bigint(value: int) -> Column:
    return F.lit(value).cast("bigint")


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, bigint(0))


def memory_bytes(text: Column) -> Column:
    """Memory setting to bytes: fractional g/m/k/t suffix, else a plain byte count, else 0 (so '1gb' is 0)."""
    s = F.lower(text)
    amount = s.substr(F.lit(1), F.length(s) - 1).try_cast("double")

    def scaled(factor: int) -> Column:
        return F.floor(amount * float(factor)).cast("bigint")

    return zero_if_null(
        F.when(s.endswith("g"), scaled(GIB))
        .when(s.endswith("m"), scaled(MIB))
        .when(s.endswith("k"), scaled(KIB))
        .when(s.endswith("t"), scaled(TIB))
        .otherwise(s.try_cast("bigint"))
    )


def default_overhead(explicit: Column, executor_memory: Column) -> Column:
    """Explicit overhead if one is set, else 10 % of the heap and at least 384 MiB."""
    tenth = F.floor(executor_memory * 0.10).cast("bigint")
    return F.when(
        explicit.isNotNull() & (explicit != ""), memory_bytes(explicit)
    ).otherwise(F.greatest(tenth, bigint(384 * MIB)))


def int_setting(props: Column, key: str, default: int) -> Column:
    return F.coalesce(props[key].try_cast("bigint"), bigint(default))


def _let(value: Column, body) -> Column:
    """Name an intermediate value, so that a long expression does not repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round2(x: Column) -> Column:
    """Round a double to two decimals from its exact binary value, halves to even (what Python's round does).

    Spark's own round works on the printed digits, so it turns 1.005 (binary 1.00499...) into 1.01. The value is
    split into a high and a low half; both halves times 100 are exact, so the distance to the tie is exact too.
    """
    split = 134217729.0  # 2^27 + 1

    def rounded(x: Column, high: Column, whole: Column) -> Column:
        over_half = ((high * 100.0 - whole) - 0.5) + (x - high) * 100.0
        step = F.when(over_half > 0, 1.0).when(over_half < 0, 0.0).otherwise(F.pmod(whole, F.lit(2.0)))
        return (whole + step) / 100.0

    return _let(x, lambda x: _let(
        x * split - (x * split - x),
        lambda high: _let(
            F.floor(high * 100.0 + (x - high) * 100.0).cast("double"), lambda whole: rounded(x, high, whole)
        ),
    ))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 when there is no whole."""
    ratio = (part.cast("double") / F.nullif(whole, bigint(0)).cast("double")) * 100.0
    return F.when(whole > 0, round2(ratio)).otherwise(F.lit(0.0))


def format_bytes(n: Column) -> Column:
    """Bytes as text with two decimals. Exactly 1024 stays unscaled and the unit below 1 KB is blank."""
    size, label = F.lit(1.0), F.lit("")
    for power, name in enumerate(["KB", "MB", "GB", "TB", "B"], start=1):
        larger = n > F.lit(1024**power).cast("decimal(20,0)")
        size = F.when(larger, float(1024**power)).otherwise(size)
        label = F.when(larger, name).otherwise(label)
    return F.format_string("%.2f %s", round2(n.cast("double") / size), label)


def in_unit(n: Column, unit: str) -> Column:
    """Bytes in a unit, six decimals, halves up."""
    if unit == "B":
        return n.cast("double")
    size = UNIT_BYTES[unit]
    micro = F.call_function(
        "div",
        n.cast("decimal(20,0)") * F.expr("cast(2000000 as decimal(7,0))") + F.lit(size).cast("decimal(13,0)"),
        F.lit(2 * size).cast("decimal(14,0)"),
    )
    return micro.cast("double") / 1e6


def local_time(ms: Column) -> Column:
    """Epoch milliseconds as text in the session time zone, blank when 0 or missing."""
    return F.when(
        ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.lit(""))


def seconds_between(start_ms: Column, end_ms: Column) -> Column:
    return F.when(
        (start_ms > 0) & (end_ms > 0), round2((end_ms - start_ms).cast("double") / 1000.0)
    ).otherwise(F.lit(0.0))


def mentions_preemption(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("preempt"), F.lit(False))


def removal_reason(removed_reason: Column, reason: Column) -> Column:
    return F.coalesce(F.nullif(removed_reason, F.lit("")), reason)


def name_without_date(name: Column) -> Column:
    return F.regexp_replace(name, r"-\d{4}-\d{2}-\d{2}", "")


def history_link(base_url: str, app_id: Column) -> Column:
    base = base_url[:-1] if base_url.endswith("/") else base_url
    return F.concat(F.lit(f"{base}/history/"), app_id, F.lit("/"))


def _class_to_format(text: Column, formats: list[tuple[str, str]]) -> Column:
    out = text
    for part, name in reversed(formats):
        out = F.when(text.contains(part), F.lit(name)).otherwise(out)
    return out


def scan_path(metadata: Column) -> Column:
    location = metadata["Location"]
    inner = F.regexp_extract(location, r"\[(.*?)\]", 1)
    return F.coalesce(
        F.when(location.rlike(r"\[.*?\]"), inner).otherwise(location), F.lit("Unknown")
    )


def scan_format(metadata: Column) -> Column:
    return F.coalesce(_class_to_format(metadata["Format"], SCAN_FORMATS), F.lit("Unknown"))


def scan_partition_filters(metadata: Column) -> Column:
    filters = metadata["PartitionFilters"]
    return F.when(
        filters.isNotNull() & ~filters.isin("", "[]"), filters
    ).otherwise(F.lit("None"))


def write_target(node_name: Column, text: Column) -> tuple[Column, Column, Column]:
    """Path, format and mode of a write node, read by position from its text ("Unknown" where absent)."""
    unknown = F.lit("Unknown")
    # The names of the write commands and how their texts begin.
    prefix = "Execute InsertIntoHadoopFsRelationCommand "
    insert = node_name.contains("InsertIntoHadoopFsRelationCommand") & text.startswith(prefix)
    save_node = ~node_name.contains("InsertIntoHadoopFsRelationCommand") & node_name.contains(
        "SaveIntoDataSourceCommand"
    )
    args = F.split(F.substring(text, len(prefix) + 1, 2**31 - 1), ", ")
    parts = F.split(text, ", ")
    save = save_node & (F.size(parts) >= 2)
    save_format = F.element_at(F.split(F.get(parts, F.lit(0)), "SaveIntoDataSourceCommand "), -1)
    path = F.when(insert, F.get(args, F.lit(0)))
    fmt = F.when(insert, F.get(args, F.lit(2))).when(
        save, _class_to_format(save_format, SAVE_FORMATS)
    )
    mode = F.when(insert, F.get(args, F.lit(4))).when(save, F.get(parts, F.lit(1)))
    return tuple(F.coalesce(c, unknown) for c in (path, fmt, mode))


def operation_name(node_name: Column) -> Column:
    fmt = F.get(F.split(node_name, " "), F.lit(1))
    read = F.when(
        fmt.isNotNull() & (fmt != ""),
        F.concat(F.lit("Read "), F.upper(F.substring(fmt, 1, 1)), F.lower(F.substring(fmt, 2, 2**31 - 1))),
    ).otherwise(F.lit("Read"))
    out = node_name
    for part, name in reversed(OPERATION_NAMES):
        out = F.when(node_name.contains(part), F.lit(name)).otherwise(out)
    return F.when(node_name.contains("Scan"), read).otherwise(out)


def filter_condition(text: Column) -> Column:
    return F.when(
        text.startswith("Filter "), F.trim(F.substring(text, 8, 2**31 - 1))
    ).otherwise(F.lit("Unknown"))


def _captured(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(F.lit("Unknown"))


def project_fields(text: Column) -> Column:
    return _captured(text, r"(?s)^Project \[(.*)\]$")


def aggregate_keys(text: Column) -> Column:
    return _captured(text, r"keys=\[([^\]]*)\]")


def aggregate_functions(text: Column) -> Column:
    return _captured(text, r"functions=\[([^\]]*)\]")


def is_distinct(keys: Column, functions: Column) -> Column:
    return (keys != "") & functions.isin("", "[]", "Unknown")


def exchange_partitioning(text: Column) -> Column:
    # the text after the first "Exchange ", up to ", ENSURE"
    rest = F.when(
        text.contains("Exchange "),
        F.substring(text, F.locate("Exchange ", text) + 9, F.length(text)),
    )
    cut = F.locate(", ENSURE", rest)
    head = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    return F.coalesce(F.trim(head), F.lit("Unknown"))


def exchange_partitions(partitioning: Column) -> Column:
    """Last argument of the partitioning when it is a whole number, as text."""
    last = F.regexp_extract(partitioning, r"(?s),([^,)]*)\)[^)]*$", 1)
    return F.coalesce(F.trim(last).try_cast("bigint").cast("string"), F.lit("Unknown"))


def coalesce_partitions(text: Column) -> Column:
    target = F.trim(F.replace(text, F.lit("Coalesce"), F.lit("")))
    return F.coalesce(
        F.when(text.contains("Coalesce"), target.try_cast("bigint").cast("string")), F.lit("Unknown")
    )
