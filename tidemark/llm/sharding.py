"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, work_folder, written

#: Rows of a shard that one task numbers, about.
BLOCK_ROWS = 20_000
_MULTIPLIER = 2862933555777941757
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on two 32-bit halves, without an overflow."""
    a0, a1, a_high = _MULTIPLIER & _M16, _MULTIPLIER >> 16 & _M16, _MULTIPLIER >> 32
    mask = F.lit(_M32)

    def short(half: Column) -> Column:
        return half * F.lit(a0) + F.shiftleft((half * F.lit(a1)).bitwiseAND(F.lit(_M16)), 16)

    below = short(low) + F.lit(1)
    carry = F.shiftright(below, 32) + F.shiftright(low * F.lit(a1), 16)
    above = carry + (low * F.lit(a_high)).bitwiseAND(mask) + short(high).bitwiseAND(mask)
    return above.bitwiseAND(mask), below.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The shards of a bigint key among `shards` and among `shards` + 1.

    The walk of jumps j1 < j2 < ... depends on the key alone; the shard among n is the last jump below n. So one
    walk gives both, and a row that moves when a shard is added moves into the new one.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(-1).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_M32)).alias("low"),
        F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"),
    )

    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        after = F.floor((state["now"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double"))).cast("bigint")
        moved = F.struct(
            high.alias("high"), low.alias("low"), after.alias("now"),
            F.when(state["now"] < shards, state["now"]).otherwise(state["shard"]).alias("shard"), state["now"].alias("grown"),
        )
        return F.when(state["now"] <= shards, moved).otherwise(state)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump)
    return walked["shard"].cast("int"), walked["grown"].cast("int")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide. Slots count a shard's rows from 0. The rows of a shard are
    numbered in blocks of some BLOCK_ROWS, to which the blocks' first slots are added, so no task holds a whole shard. Rows with
    equal doc_id, size and checksum are numbered in the order of the written table; long texts are taken whole.

    A null or empty text has the size 8 and the checksum 0; a null doc_id goes where -1 goes. Repeated rows
    share a shard and have slots of their own. An empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    shard, grown = jump_hash(F.col("doc_id"), shards)
    sized = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(data) + F.lit(8)).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"),
        shard.alias("shard"), grown.alias("grown_shard"), F.monotonically_increasing_id().alias("row"),
    )
    sized = written(sized, folder, "sized")
    blocks = max(8, -(-sized.count() // (shards * BLOCK_ROWS)))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    turn = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "row")
    numbered = dealt.withColumn("place", F.row_number().over(turn) - 1)
    return numbered.join(first, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("first")).cast("bigint").alias("slot"), "grown_shard"
    )
