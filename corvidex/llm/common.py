"""What the operators of this subpackage share: tables, the shared folder, helpers for Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.sources.tables import shared_dir

#: The columns of the documents table; a pipeline stage returns them in this order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/corvidex-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    Like a checkpoint it stays in the shared folder until whoever owns that folder clears it: a later job of the same
    session may still read it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_large(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for rows of megabytes: each is a row group of its own, so that neither the writer nor the reader of a
    task holds more than one of them, however many a task has."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("parquet.block.row.count.limit", 1).option("parquet.page.size.row.check.min", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def one_row_a_batch(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python one by one: for steps over rows of megabytes, which would be gathered into
    batches by their number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plainly(docs: DataFrame, work: Callable[[DataFrame], DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    """``work(docs)``, which returns the columns of its input and ``more``, with every column but those of documents under a
    name of no meaning meanwhile: names with dots, or that differ from others only in case, don't matter to ``work``."""
    names = docs.columns
    return work(docs.toDF(*[c if c in DOCUMENT_COLUMNS else f"other{k}" for k, c in enumerate(names)])).toDF(*names, *more)


def without(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` without the columns that Spark can't tell from ``names``, whatever the case of their letters."""
    kept = [(k, c) for k, c in enumerate(docs.columns) if c.lower() not in {x.lower() for x in names}]
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).select(*[f"c{k}" for k, _ in kept]).toDF(*[c for _, c in kept])


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size in bytes; of files it is their size on disk."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def by_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of one record batch; batches are bounded by Spark's Arrow settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame) -> DataFrame:
    """Null texts as empty ones."""
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
