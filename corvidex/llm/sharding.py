"""Sharding by jump consistent hashing (operator 8), in DataFrame functions only.

A stable key and the number of shards decide the shard; there is no ring table. With one more shard, only the rows that
the new shard takes move. The generator of the jumps is the published one, a 64-bit linear congruence; as Spark checks
integer overflow it is computed in two halves of 32 bits, whose products stay below 2^63.

``slot`` numbers the rows of a shard from 0 without gaps, by (doc_id, text_crc32, size), nulls first. It is a global
sort in two steps, so that no shard and no hot key meets in one task: equal rows are counted first, distinct ones are
dealt out by range and written; then each range numbers its own rows from where the ranges before it end.

Null doc_id: a key like any other (all in one shard). Null text: 0 bytes, size 1, checksum 0. Equal rows get different
slots. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.common import materialize, table

SHARDS = 16
#: Multiplier of the published generator.
_MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF
#: Jumps looked at in the first round; nearly all keys end there, the rest go on to the exact bound.
_JUMPS = 40
#: Copies of one row that a task expands at once.
_COPIES = 65_536


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2^64, key = high * 2^32 + low."""
    c0, c1 = _MULTIPLIER & 0xFFFF, _MULTIPLIER >> 16 & 0xFFFF
    d0, d1 = _MULTIPLIER >> 32 & 0xFFFF, _MULTIPLIER >> 48
    p0, p1 = low * c0, low * c1
    t = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(t, 32) + F.shiftright(p1, 16)
    cross = low * d0 + F.shiftleft((low * d1).bitwiseAND(0xFFFF), 16)
    own = high * c0 + F.shiftleft((high * c1).bitwiseAND(0xFFFF), 16)
    return (carry + cross.bitwiseAND(_LOW) + own.bitwiseAND(_LOW)).bitwiseAND(_LOW), t.bitwiseAND(_LOW)


def _jump(state: Column, shards: int) -> Column:
    high, low = _next(state["high"], state["low"])
    b = state["j"]
    j = F.floor((b + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
    stepped = F.struct(b.alias("b"), j.alias("j"), high.alias("high"), low.alias("low"))
    return F.when(state["j"] < shards, stepped).otherwise(state)


def jumps(key: Column, shards: int) -> Column:
    """The last jump below ``shards`` (b) and the first one from there on (j), of a long key."""
    zero = F.lit(0).cast("long")
    start = F.struct((zero - 1).alias("b"), zero.alias("j"), F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_LOW).alias("low"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(_JUMPS, shards))), start, lambda s, _: _jump(s, shards))
    if shards <= _JUMPS:
        return first
    rest = F.aggregate(F.sequence(F.lit(_JUMPS + 1), F.lit(shards)), first, lambda s, _: _jump(s, shards))
    return F.when(first["j"] < shards, rest).otherwise(first)


def with_shard(df: DataFrame, key: Column, shards: int = SHARDS, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of ``key`` among ``shards``, and among one more. ``key``: a column of any type that xxhash64 takes."""
    if shards < 1:
        raise ValueError("at least one shard")
    at = F.col("__jump")
    return (
        df.withColumn("__jump", jumps(F.xxhash64(key), shards))
        .withColumn(shard, at["b"].cast("int"))
        .withColumn(grown, F.when(at["j"] == shards, shards).otherwise(at["b"]).cast("int"))
        .drop("__jump")
    )


def with_slot(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 by ``order``. ``df`` has narrow rows: it is shuffled and written once."""
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    ranged = materialize(counted.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (shard, *order)]).withColumn("__range", F.spark_partition_id()), "slots")
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(shard, "__range").agg(F.sum("__n").alias("__sum")).select(shard, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(shard, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__own", F.coalesce(F.sum("__n").over(own), F.lit(0))).join(starts, [shard, "__range"])
    placed = placed.select(*columns, "__n", (F.col("__start") + F.col("__own")).cast("long").alias(slot))
    single = placed.where(F.col("__n") == 1).select(*columns, slot)
    # Many equal rows: first in runs, dealt out anew, so that no task writes all copies.
    runs = placed.where(F.col("__n") > 1).withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / _COPIES).cast("int"))))
    runs = runs.repartition(*columns, "__run")
    last = F.least(F.lit(_COPIES).cast("long"), F.col("__n") - F.col("__run") * F.lit(_COPIES).cast("long")) - 1
    copies = runs.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copies = copies.select(*columns, (F.col(slot) + F.col("__run") * F.lit(_COPIES).cast("long") + F.col("__copy")).alias(slot))
    return single.unionByName(copies)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document; one row per row of ``docs``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = with_slot(with_shard(narrow, F.col("doc_id"), shards), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}  # DuckDB has no crc32 and no xxhash64
