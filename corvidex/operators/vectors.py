"""A vector store as a journal: additions, replacements, deletions and clearings are appended, the last one of each id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X


def add(journal: DataFrame, rows: DataFrame, seq: int) -> DataFrame:
    """``journal`` with rows (id, vector) added or replaced; vectors are kept at unit length, zero ones as they are."""
    return journal.unionByName(rows.select("id", X.unit(F.col("vector")).cast("array<double>").alias("vector"), F.lit("add").alias("op"), F.lit(seq).cast("long").alias("seq")))


def delete(journal: DataFrame, ids: DataFrame, seq: int) -> DataFrame:
    return journal.unionByName(ids.select("id", F.lit(None).cast("array<double>").alias("vector"), F.lit("delete").alias("op"), F.lit(seq).cast("long").alias("seq")))


def clear(journal: DataFrame, seq: int) -> DataFrame:
    """Everything before ``seq`` goes: one row without an id."""
    mark = journal.sparkSession.range(1).select(F.lit(None).cast(journal.schema["id"].dataType).alias("id"), F.lit(None).cast("array<double>").alias("vector"), F.lit("clear").alias("op"), F.lit(seq).cast("long").alias("seq"))
    return journal.unionByName(mark)


def state(journal: DataFrame) -> DataFrame:
    """id, vector of what is there: one aggregation by id, behind the last clearing."""
    cut = journal.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cut"))
    live = journal.where("op <> 'clear'").join(F.broadcast(cut)).where("seq > cut")  # one row
    last = live.groupBy("id").agg(F.max_by(F.struct("op", "vector"), F.struct("seq", "op")).alias("r"))
    return last.where("r.op = 'add'").select("id", "r.vector")
