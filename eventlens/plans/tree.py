"""Plan trees of SQL executions as rows.

A plan is one JSON document of unknown depth inside one log line, kept as a VARIANT. Its levels are taken apart
from the root down, so that the nodes of a plan are rows without being grouped; everything after it is joins and aggregates on node rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions import scalars as S
from eventlens.operators.ordering import checkpointed
from eventlens.sources.events import EventLog, per_log

LEVELS = 12  # of a plan that are decoded at once
_LAST = (1 << 31) - 1  # follows every child's number


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once. Unlike a transform, a fold hands it on without copying it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def _metrics(listed: Column) -> Column:
    """Accumulator ids by metric name; a name that is listed again keeps its last id."""
    def by_name(entries: Column) -> Column:
        names = entries["name"]
        last = F.filter(entries, lambda m, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == m["name"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), entries).otherwise(last))

    none = F.create_map().cast("map<string,bigint>")
    return F.when(F.coalesce(F.size(listed), F.lit(0)) < 1, none).otherwise(
        let(F.filter(listed, lambda m: m["name"].isNotNull()), by_name))


def _node_type(levels: int = 1) -> str:
    """A node with so many levels of nodes, its own included; what lies below them is left as it is."""
    children = "variant" if levels == 1 else _node_type(levels - 1)
    return ("struct<nodeName:string,simpleString:string,metadata:map<string,string>,"
            f"metrics:array<struct<name:string,accumulatorId:bigint>>,children:array<{children}>>")


def _rows(level: Column) -> Column:
    """The nodes of one level with their fields as they are logged."""
    return F.transform(level, lambda x: F.struct(
        x["path"].alias("path"), *[x["node"][c].alias(c) for c in ("nodeName", "simpleString", "metadata", "metrics")]))


def _fields() -> list[Column]:
    """The fields of a node, with what stands for missing ones."""
    return [
        F.coalesce("nodeName", F.lit("Unknown")).alias("node_name"),
        F.coalesce("simpleString", F.lit("")).alias("simple_string"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        _metrics(F.col("metrics")).alias("metrics"),
    ]


def _below(level: Column) -> Column:
    """The children of all nodes of one level."""
    def children(x: Column) -> Column:
        return F.transform(x["node"]["children"],
                           lambda child, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), child.alias("node")))

    return F.flatten(F.transform(F.filter(level, lambda x: F.size(x["node"]["children"]) > 0), children))


def _children(places: Column, level: Column) -> tuple[Column, Column]:
    """The children of all nodes of one level, in the order of their parents: their places and the nodes."""
    given = lambda lists: F.flatten(F.filter(lists, lambda listed: listed.isNotNull()))
    below = F.zip_with(places, level["children"], lambda place, children: F.transform(
        children, lambda _, i: F.concat(place, F.array(i))))
    return given(below), given(level["children"])


def _taken_apart(plan: Column) -> Column:
    """All nodes of a plan, level by level, as structs with the place of each: the numbers of the children that lead to it.

    The upper LEVELS levels are decoded at once, and a level is reached by its fields, without copying what lies below it.
    A fold takes apart what lies below these levels.
    """
    fields = ("nodeName", "simpleString", "metadata", "metrics")

    def descend(state: Column, _: Column) -> Column:
        decoded = F.transform(state["level"], lambda x: F.struct(
            x["path"].alias("path"), F.try_variant_get(x["node"], "$", _node_type()).alias("node")))
        deeper = let(decoded, lambda level: F.struct(
            F.concat(state["nodes"], _rows(level)).alias("nodes"), _below(level).alias("level")))
        return F.when(F.size(state["level"]) == 0, state).otherwise(deeper)

    def whole(levels: list[tuple[Column, Column]], places: Column, below: Column) -> Column:
        every = F.concat(*[place for place, _ in levels]).alias("path")
        nodes = F.arrays_zip(every, *[F.concat(*[level[c] for _, level in levels]).alias(c) for c in fields])
        start = F.struct(nodes.alias("nodes"), F.arrays_zip(places.alias("path"), below.alias("node")).alias("level"))
        # there are no more levels than lists of children
        steps = F.sequence(F.lit(1), F.regexp_count(F.to_json(plan), F.lit('"children"')))
        return F.when(F.size(below) == 0, nodes).otherwise(F.aggregate(steps, start, descend)["nodes"])

    def down(levels: list[tuple[Column, Column]], places: Column, level: Column) -> Column:
        if len(levels) == LEVELS:
            return whole(levels, places, level)
        levels = [*levels, (places, level)]
        further, below = _children(places, level)
        return let(below, lambda nodes: let(further, lambda at: down(levels, at, nodes)))

    root = F.array(F.try_variant_get(plan, "$", _node_type(LEVELS)))
    return let(root, lambda level: down([], F.array(F.array().cast("array<int>")), level))


def _in_order(nodes: Column) -> Column:
    """The nodes with their positions in pre-order and post-order.

    Places sort in pre-order. A place that ends with a number above all children's sorts after what lies below it, which
    gives post-order.
    """
    pre = F.sort_array(F.transform(nodes["path"], lambda path, i: F.struct(path.alias("path"), i.alias("i"))))
    post = F.sort_array(F.transform(pre, lambda x, k: F.struct(
        F.concat(x["path"], F.array(F.lit(_LAST))).alias("path"), k.alias("pos"), x["i"].alias("i"))))

    def row(x: Column, k: Column) -> Column:
        return let(F.get(nodes, x["i"]), lambda n: F.struct(
            x["pos"].alias("pos"), k.alias("post_pos"), F.size(n["path"]).alias("depth"), *[
                n[c].alias(c) for c in ("path", "nodeName", "simpleString", "metadata", "metrics")]))

    return F.transform(post, row)


def is_plan(plan: Column) -> Column:
    """Is it a JSON object? Anything else is skipped like any malformed line."""
    # every object can be read as this type, and nothing of its children is copied for it
    return F.try_variant_get(plan, "$", "struct<nodeName:variant>").isNotNull()


@per_log
def executions(log: EventLog) -> DataFrame:
    """Last start event of each SQL execution."""
    return log.view("sql_start").filter("execution_id is not null").groupBy("app_key", "execution_id").agg(
        F.max("seq").alias("start_seq"),
        F.max_by(F.coalesce("description", F.lit("")), "seq").alias("description"),
        F.max_by("time", "seq").alias("start_ms"),
    )


@per_log
def _superseded(log: EventLog) -> DataFrame:
    """(app_key, execution_id, seq) of start events that a later one of the same execution replaces. Mostly there are few or
    none; as they are stored, Spark knows how many when it chooses the join with the plans."""
    starts = log.view("sql_start").filter("execution_id is not null").select("app_key", "execution_id", "seq")
    latest = executions(log).select("app_key", "execution_id", "start_seq")
    return checkpointed(starts.join(latest, ["app_key", "execution_id"]).filter("seq < start_seq").drop("start_seq").distinct())


@per_log
def plans(log: EventLog, adaptive: bool = False) -> DataFrame:
    """(app_key, execution_id, start_seq, plan): the plan of each SQL execution's last start event. `adaptive` takes the
    last re-planned tree where there is one."""
    first = log.view("sql_plan").filter(F.col("execution_id").isNotNull() & is_plan(F.col("plan")))
    # the other way round, with the latest events, all plans would be moved and sorted to meet one event each
    first = first.filter("app_key is not null and seq is not null").join(
        _superseded(log), ["app_key", "execution_id", "seq"], "left_anti").select("app_key", "execution_id", "seq", "plan")
    if adaptive:
        updates = log.view("adaptive_plan").filter(is_plan(F.col("plan")))
        last = updates.groupBy("app_key", "execution_id").agg(F.max("seq").alias("seq"))
        replanned = updates.join(last, ["app_key", "execution_id", "seq"], "left_semi")
        starts = first.select("app_key", "execution_id", F.col("seq").alias("start_seq"))
        first = first.join(replanned, ["app_key", "execution_id"], "left_anti").unionByName(
            # metric updates still count from the start of the execution
            replanned.join(starts, ["app_key", "execution_id"])
            .select("app_key", "execution_id", F.col("start_seq").alias("seq"), "plan")
        )
    return first.select("app_key", "execution_id", F.col("seq").cast("decimal(38,0)").alias("start_seq"), "plan")


@per_log
def plan_nodes(log: EventLog, adaptive: bool = False) -> DataFrame:
    """One row per plan node: position in pre-order (`pos`) and post-order (`post_pos`), depth, child path, texts
    and the map from metric name to accumulator id. `adaptive` takes the last re-planned tree where there is one."""
    # many plans fit into one file, and taking them apart costs far more than moving them
    whole = plans(log, adaptive)
    dealt = whole.repartition(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), "app_key", "execution_id")
    ordered = let(_taken_apart(F.col("plan")), _in_order)
    nodes = dealt.select("app_key", "execution_id", "start_seq", F.inline(ordered))
    return nodes.select("app_key", "execution_id", "start_seq", "pos", "post_pos", "depth", "path", *_fields())


@per_log
def shared_nodes(log: EventLog) -> DataFrame:
    """Plan nodes for operators that join them several times: walked once, kept in the checkpoint folder."""
    return checkpointed(plan_nodes(log))


def node_signature() -> Column:
    """Identity of a node: its accumulator ids, or its path when it has none. A subtree that is reused in the plan
    repeats the ids and counts once."""
    return F.when(
        F.size("metrics") > 0,
        F.concat(F.lit("acc:"), F.array_join(F.array_sort(F.map_values("metrics")).cast("array<string>"), ",")),
    ).otherwise(F.concat(F.lit("path:"), F.array_join(F.col("path").cast("array<string>"), ".")))


def node_kind() -> Column:
    """Class of a tracked node, null for nodes without details."""
    name = F.col("node_name")
    has = lambda metric: F.map_contains_key("metrics", F.lit(metric))
    return (
        F.when(name.contains("Scan"), "read")
        .when(has("number of written files"), "write")
        .when(has("shuffle records written") | has("shuffle bytes written") | name.contains("Exchange"), "shuffle")
        .when(has("time in aggregation build"), "agg")
        .when(has("number of output rows") & name.contains("Filter"), "filter")
        .when(name.contains("Project"), "project")
        .when(name.contains("Coalesce"), "coalesce")
    )


def tracked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with details: scans, writes, exchanges, aggregates, filters, projections and coalesces."""
    return (
        nodes
        .withColumn("kind", node_kind())
        .filter("kind is not null")
        .withColumn("signature", node_signature())
    )


def op_details(nodes: DataFrame) -> DataFrame:
    """Tracked nodes with the details that their texts give, by kind."""
    kind, name, text, metadata = F.col("kind"), F.col("node_name"), F.col("simple_string"), F.col("metadata")
    path, fmt, mode = S.write_target(name, text)

    def only(k: str, value: Column) -> Column:
        return F.when(kind == k, value)

    partitioning = S.exchange_partitioning(text)
    return nodes.select(
        "*",
        F.coalesce(only("read", S.scan_path(metadata)), only("write", path)).alias("file_path"),
        F.coalesce(only("read", S.scan_format(metadata)), only("write", fmt)).alias("format"),
        only("write", mode).alias("mode"),
        only("read", S.scan_partition_filters(metadata)).alias("partition_filters"),
        only("filter", S.filter_condition(text)).alias("condition"),
        only("project", S.project_fields(text)).alias("selected_fields"),
        only("agg", S.aggregate_keys(text)).alias("aggregate_keys"),
        only("agg", S.aggregate_functions(text)).alias("aggregate_functions"),
        only("shuffle", partitioning).alias("partitioning"),
        F.coalesce(
            only("shuffle", S.exchange_partitions(partitioning)), only("coalesce", S.coalesce_partitions(text))
        ).alias("num_partitions"),
    ).withColumn(
        "is_distinct",
        F.when(kind == "agg", F.coalesce(S.is_distinct(F.col("aggregate_keys"), F.col("aggregate_functions")), F.lit(False))),
    )


def driver_values(log: EventLog, per_execution: bool) -> DataFrame:
    """Last driver-side value of each accumulator and when it came.

    Only updates after the plan event count. The last update of all is after the plan exactly when any is, so the
    updates are reduced to one row per accumulator before they meet the plan nodes.
    """
    keys = ["app_key", "execution_id", "acc_id"] if per_execution else ["app_key", "acc_id"]
    updates = log.view("driver_updates").select(
        "app_key", "seq", "execution_id", F.inline(_last_of_each(F.filter("updates", lambda u: F.size(u) >= 2))))
    # no struct is aggregated, so that Spark need not sort the updates for it
    return updates.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("value_seq"))


def _last_of_each(updates: Column) -> Column:
    """(acc_id, value) of the updates of one line; of several of one accumulator the last counts."""
    entry = lambda u: (F.get(u, F.lit(0)).alias("acc_id"), F.get(u, F.lit(1)).alias("value"))

    def sifted(updates: Column) -> Column:
        ids = F.transform(updates, lambda u: F.get(u, F.lit(0)))
        by_id = F.sort_array(F.transform(updates, lambda u, i: F.struct(entry(u)[0], i.alias("i"), entry(u)[1])))
        last = let(by_id, lambda found: F.filter(found, lambda x, i: ~F.get(found, i + 1)["acc_id"].eqNullSafe(x["acc_id"])))
        several = F.size(F.array_distinct(ids)) < F.size(ids)
        return F.when(several, F.transform(last, lambda x: F.struct(x["acc_id"], x["value"]))).otherwise(
            F.transform(updates, lambda u: F.struct(*entry(u))))

    return let(updates, sifted)


def node_driver_metrics(nodes: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Driver-side metric values of nodes: `keys`, metric name and value. `nodes` holds `metrics` and `start_seq`."""
    per_execution = "execution_id" in values.columns
    on = ["app_key", "execution_id", "acc_id"] if per_execution else ["app_key", "acc_id"]
    wanted = list(dict.fromkeys([*keys, "app_key", "execution_id", "start_seq"]))
    metrics = nodes.select(*wanted, F.explode("metrics").alias("metric", "acc_id"))
    return (
        metrics.join(values, on)
        .filter("value_seq > start_seq")
        .select(*keys, "metric", "value")
    )


def accumulator_rollup(log: EventLog) -> DataFrame:
    """Value of each accumulator: the sum of the task updates, at least the largest driver update.

    Only quoted updates add up (SQL metrics are logged as text, internal ones as numbers, which count 0). The form
    is independent of the order of task and driver updates.
    """
    text = F.schema_of_variant("a.Update") == "STRING"
    number = F.when(text, F.try_variant_get("a.Update", "$", "string"))
    by_task = (
        log.view("task_accumulables").select("app_key", F.explode("accumulables").alias("a"))
        .select("app_key", F.col("a.ID").try_cast("bigint").alias("acc_id"), number.alias("u"))
        .filter("acc_id is not null")
        .groupBy("app_key", "acc_id")
        .agg(
            S.zero_if_null(F.sum(F.col("u").try_cast("bigint"))).alias("whole"),
            F.coalesce(F.sum(F.when(F.col("u").contains("."), F.col("u").try_cast("double"))), F.lit(0.0)).alias("part"),
        )
        .select("app_key", "acc_id", (F.col("whole").cast("double") + F.col("part")).alias("task_sum"))
    )
    updates = log.view("driver_updates").select("app_key", F.explode("updates").alias("u")).filter("size(u) >= 2")
    by_driver = updates.groupBy("app_key", F.get("u", F.lit(0)).alias("acc_id")).agg(
        F.greatest(F.max(F.get("u", F.lit(1))), S.bigint(0)).cast("double").alias("driver_max")
    )
    return by_task.join(by_driver, ["app_key", "acc_id"], "full").select(
        "app_key", "acc_id", F.greatest("task_sum", "driver_max").alias("value")
    )
