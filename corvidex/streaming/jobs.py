"""Incremental intake: duplicates within a watermark, tumbling counts, state merged batch by batch.

Checkpoints and results lie in the folder of spark.checkpoint.dir, so a job that is started anew goes on where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.sources.tables import additive_upsert, shared_dir


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a parquet file or folder; times as TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rsplit("/", 1)
    held = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}*")
    return held.withColumn("ts", F.col("ts").cast("timestamp"))


def intake(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type, complete: the last, open window is in it too."""
    out = folder(spark, "tumbling")
    counts = source(spark, path).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = counts.select(F.col("w.start").alias("day"), "event_type", "n", "total")
    # Complete mode gives all windows each time; the last batch is the result.
    job = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    job = job.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/result")).start()
    job.awaitTermination()
    return spark.read.parquet(f"{out}/result")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Counters by user: each batch is aggregated and merged into the table that the batch before wrote.

    A batch reads version k - 1 and writes version k, so that a batch that runs twice gives the same table.
    """
    out = folder(spark, "merged")

    def merge(df: DataFrame, k: int) -> None:
        new = df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.sum("value").alias("total"))
        if k:
            new = additive_upsert(spark.read.parquet(f"{out}/{k - 1}"), new, ["user_id"], ["n", "total"], ["last_id"])
        new.write.mode("overwrite").parquet(f"{out}/{k}")
        spark.createDataFrame([(k,)], "k long").write.mode("overwrite").parquet(f"{out}/last")

    job = source(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{out}/{spark.read.parquet(f'{out}/last').first()['k']}")
