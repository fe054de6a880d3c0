"""Bi-temporal facts and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.operators.filters import valid_at


def validity(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Facts with valid_at and invalid_at, each valid until the next of its key."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    return rows.withColumn("valid_at", F.col(ts)).withColumn("invalid_at", F.lead(ts).over(w))


def facts_at(facts: DataFrame, when: Column) -> DataFrame:
    return facts.where(valid_at(when))


def close_contradictions(facts: DataFrame, keys: list[str]) -> DataFrame:
    """A fact strictly older than another of its key ends when the next newer one begins, whatever order they came in.

    Facts of one time don't close each other; a fact that ends earlier already keeps its end.
    """
    times = facts.select(*keys, "valid_at").distinct()
    following = times.withColumn("__next", F.lead("valid_at").over(Window.partitionBy(*keys).orderBy("valid_at")))
    out = facts.join(following, [*keys, "valid_at"], "left")
    return out.withColumn("invalid_at", F.least("invalid_at", "__next")).drop("__next")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], tie: str) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    One sort of the union by (key, time), a running last value; no pair of rows is built.
    """
    r = right.select(key, ts, F.col(tie).alias("__tie"), F.lit(0).alias("__left"), F.struct(*values).alias("__v"))
    kind = r.schema["__v"].dataType
    rest = [c for c in left.columns if c not in (key, ts)]
    u = r.withColumn("__row", F.lit(None).cast(left.select(F.struct(*rest)).schema[0].dataType)).unionByName(left.select(key, ts, F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(1).alias("__left"), F.lit(None).cast(kind).alias("__v"), F.struct(*rest).alias("__row")))
    w = Window.partitionBy(key).orderBy(ts, "__left", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("__v", F.last("__v", True).over(w)).where("__left = 1")
    return out.select(key, ts, *[F.col("__row")[c].alias(c) for c in rest], *[F.col("__v")[c].alias(f"last_{c}") for c in values])


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Events with the number of their session: a gap begins a new one."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    new = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_seconds * 1_000_000, F.lit(True))
    return events.withColumn("__new", new.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def repeats_within(events: DataFrame, keys: list[str], ts: str, seconds: int, tie: str) -> DataFrame:
    """Rows that follow an equal one of their keys within ``seconds``."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    ago = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return events.withColumn("__ago", ago).where(F.col("__ago") <= seconds * 1_000_000).drop("__ago")
