"""Jump consistent hashing: stable keys to shards without a ring table (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import utf8_bytes
from eventlens.operators.ordering import checkpointed

#: Fixed values of the published generator: state * MULTIPLIER + 1 modulo 2**64, of which the upper 31 bits are used.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator on a 64-bit state held as two 32-bit halves, so that no product overflows a long."""
    bottom = low.bitwiseAND(0xFFFF) * _LOW + 1
    middle = F.shiftright(low, 16) * _LOW + F.shiftright(bottom, 16)
    new_low = F.shiftleft(middle.bitwiseAND(0xFFFF), 16).bitwiseOR(bottom.bitwiseAND(0xFFFF))

    def low_product(x: Column, y: int) -> Column:  # the lower 32 bits of x * y
        upper = (F.shiftright(x, 16) * (y & 0xFFFF)).bitwiseAND(0xFFFF)
        return (x.bitwiseAND(0xFFFF) * y).bitwiseAND(_MASK) + F.shiftleft(upper, 16)

    new_high = low_product(high, _LOW) + low_product(low, _HIGH) + F.shiftright(middle, 16)
    return new_high.bitwiseAND(_MASK), new_low


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key. A null key counts as 0.

    Each step jumps to the next shard count at which the key would move; the last jump below `shards` is the answer.
    About ln(shards) steps are taken. The fold has 64 of them and, should a key not be done by then, goes on with as
    many as there are shards, which is always enough.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_MASK).alias("low"),
        F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next_state(s.high, s.low)
        jump = F.floor((s.next + 1) * (F.lit(2.0**31) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), s.next.alias("at"), jump.cast("bigint").alias("next"))
        return F.when(s.next < shards, moved).otherwise(s)

    def fold(s: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s, step)

    state = fold(start, min(64, shards))
    if shards > 64:
        state = F.when(state.next < shards, fold(state, shards)).otherwise(state)
    return state.at.cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard, its slot in the shard and its shard if one more is appended.

    Law `key`: the id and the number of shards alone decide. Null texts have size 1 and the checksum of the empty
    text; null ids are key 0; rows with equal ids share a shard and get a slot each. Columns other than doc_id and text
    are not read. An empty table gives no rows.

    Slots are numbered without bringing a shard together: rows count up inside (shard, part of the scan), and each such
    part starts where the ones before it end.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = utf8_bytes(F.col("text")) + 1
    key = F.col("doc_id")
    rows = checkpointed(docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"),
    ))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    return rows.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + inside - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )
