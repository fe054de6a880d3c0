"""Parquet tables, merge-style writes, and pages of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a few numbers each that a task of ``dealt`` gets.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset: a temporary one on a local master,
    as in tests; on a cluster an error, as a machine's own folder wouldn't be seen by the others."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="corvidex-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a parquet table in the shared folder, in folders ``by`` columns: column form, with statistics, read again as
    often as needed. It lives as long as that folder does, like a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/corvidex-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files give fewer tasks than half of them (one small file that can't be split),
    before work that is heavy for each row. Larger inputs have enough tasks and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as about ``rows`` rows need, so that what a task sorts or adds up doesn't grow with
    them: adaptive execution would make parts larger before it makes more of them. As it is, if the cores are parts enough."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last writer wins: of each key the row with the greatest ``order``. Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def coalescing_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A value of ``new`` replaces that of ``old`` unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns])


def additive_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], add: Sequence[str], greatest: Sequence[str]) -> DataFrame:
    """Counters add up, marks keep their greatest."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add], *[F.max(c).alias(c) for c in greatest])


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key isn't there yet, one of each."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def newer_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Replace a row only by one with a greater ``mark``."""
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(tagged, keys, [F.col(mark), -F.col("__new")]).drop("__new")


def replace_partition(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``rows`` over the partitions that they name and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page and whether more follow, from one row beyond it."""
    got = rows.orderBy(*order).offset(offset).limit(limit + 1)
    at = F.row_number().over(Window.orderBy(*order))
    return got.withColumn("__at", at).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("__at") <= limit).drop("__at")
