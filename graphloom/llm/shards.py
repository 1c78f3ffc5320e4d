"""Sharding by jump consistent hashing: a stable key and the number of shards decide; no ring, no table.

The key seeds a 64-bit linear congruential generator. Each draw says at which number of shards the row next
jumps to a new one; the last jump below the number asked for is its shard. From n to n + 1 shards a row stays
or jumps into the new shard, with probability 1 / (n + 1). All is column expressions; products modulo 2 ** 64
are taken in limbs that no 64-bit number overflows, as arithmetic may be checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.common import stage

SHARDS = 16
# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_MASK = (1 << 32) - 1
# Jumps of nearly every row; rows that have more take as many as they need.
_JUMPS = 64
_AT, _TIE, _PART = "__shard_at", "__shard_tie", "__shard_part"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _half(a: Column, by: int) -> Column:
    """a * by below 2 ** 32, of halves."""
    return a * _long(by & 0xFFFF) + F.shiftleft((a * _long(by >> 16)).bitwiseAND(_long(0xFFFF)), 16)


def _next(high: Column, low: Column) -> Column:
    """(high, low) of the next state: state * MULTIPLIER + 1 modulo 2 ** 64."""
    upper = low * _long(_LOW >> 16)
    under = low * _long(_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(upper, 16) + _half(high, _LOW) + _half(low, _HIGH)
    return _let(under, lambda u: F.struct(
        (F.shiftright(u, 32) + carry).bitwiseAND(_long(_MASK)).alias("high"), u.bitwiseAND(_long(_MASK)).alias("low")))


def _jump(state: Column, shards: int) -> Column:
    """One draw, for rows whose next jump lies below ``shards``."""
    drawn = lambda s: F.struct(
        s["high"].alias("high"), s["low"].alias("low"), state["next"].alias("shard"),
        ((state["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(s["high"], 1) + 1))).cast("long").alias("next"))
    return F.when(state["next"] < shards, _let(_next(state["high"], state["low"]), drawn)).otherwise(state)


def jump(key: Column, shards: int) -> Column:
    """(shard, next) of a long key: its shard among ``shards``, and the number of the shard that it jumps to next.

    With n + 1 shards it is in shard n if next is n, else where it was.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    first = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_long(_MASK)).alias("low"), _long(-1).alias("shard"), _long(0).alias("next"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, _JUMPS))), first, lambda s, _: _jump(s, shards))
    rest = lambda s: F.aggregate(F.sequence(s["shard"], _long(shards)), s, lambda t, _: _jump(t, shards))
    if shards > _JUMPS:
        done = _let(done, lambda s: F.when(s["next"] < shards, rest(s)).otherwise(s))
    return F.struct(done["shard"].cast("int").alias("shard"), done["next"].alias("next"))


def assign(rows: DataFrame, keys: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with shard and grown_shard (int), the shard among one more; columns of these names are replaced.

    The key is the 64-bit hash of the key columns. Rows that agree in them share a shard, those with nulls alone too.
    """
    rows = rows.drop("shard", "grown_shard").withColumn("__jump", jump(F.xxhash64(*[f"`{k}`" for k in keys]), shards))
    grown = F.when(F.col("__jump.next") == shards, F.lit(shards)).otherwise(F.col("__jump.shard"))
    return rows.withColumn("shard", F.col("__jump.shard")).withColumn("grown_shard", grown.cast("int")).drop("__jump")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id long, text string).

    The law is ``key``: doc_id alone and the number of shards decide. Slots number a shard's rows from 0 by doc_id,
    crc32 and size; repeated rows trade slots. A null text has no bytes: size 1, crc32 0. Rows without
    doc_id share a shard and come first in it. Other columns are not read; an empty table gives an empty one.

    Rows are numbered without their texts, in a range sort, so a shard or an id with many rows spans several tasks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    # Written, as the range sort reads its input twice, once to find the ranges.
    rows = stage(assign(rows, ["doc_id"], shards)).withColumn(_TIE, F.monotonically_increasing_id())
    order = ["shard", "doc_id", "text_crc32", "size", _TIE]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(_TIE)
    rows = stage(rows.withColumn(_AT, F.monotonically_increasing_id())).withColumn(_PART, F.shiftright(_AT, 33))
    # A row per partition and shard in it: sorted by shard, no more than partitions and shards together.
    runs = rows.groupBy("shard", _PART).agg(F.min(_AT).alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", _PART, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    rows = rows.join(F.broadcast(runs), ["shard", _PART])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col(_AT) + F.col("shift")).alias("slot"), "grown_shard")


def write(rows: DataFrame, path: str, keys: list[str], shards: int = SHARDS) -> None:
    """Store ``rows`` as Parquet, a folder per shard; a shard's rows may be many files, each file is of one shard."""
    salt = F.xxhash64(*[f"`{c}`" for c in rows.columns if c not in ("shard", "grown_shard")])
    rows = assign(rows, keys, shards).drop("grown_shard").withColumn(_TIE, salt)
    rows.repartitionByRange("shard", _TIE).drop(_TIE).write.partitionBy("shard").parquet(path)
