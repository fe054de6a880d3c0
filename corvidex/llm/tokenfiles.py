"""Flat token files and counting in them by a separator scan (operator 2).

A token file is nothing but ids as little-endian 16-bit integers, each document closed by the end-of-document id: no
header, no index. Documents lie in them in the order of the table's rows, the files of a partition one after the other.

Counting takes a file in blocks of ``BLOCK`` bytes that know nothing of documents. In each block one vectorised search
finds the separators; documents that lie within it are done. A block hands on only two numbers, the ids after its last
separator and whether it had any, and a prefix scan over the blocks of a file, which lie side by side, stitches the
documents that cross borders: the ids that a block's first document has before it are those since the last separator.
The scan runs over two numbers a block, partitioned by file.

Special strings in texts are encoded as ordinary text, so the separator occurs only as one. Null and empty texts are
documents without ids. Repeated rows are documents each, in the order of their rows. A very long text crosses blocks like
any other. Other columns are ignored. An empty table gives no document. A partition is written as files of ``FILE`` documents
at most, since a file is read as one cell of Spark's binaryFile source: below 2 GB for documents of 64,000 ids in the mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.bpe import VOCABULARY
from corvidex.llm.common import by_batch, shared_path, table
from corvidex.llm.lockstep import load_lockstep

#: The end-of-document id of the vocabulary.
END = 49407
BLOCK = 1 << 22
#: Documents in a file.
FILE = 16_384
#: Bytes of the texts that a worker encodes at once; nothing is kept from one such group to the next.
GROUP = 1 << 21


def encoded(vocabulary: str, end: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Ids of whole texts as little-endian 16-bit integers, a group of texts at a time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, whole, raw = load_lockstep(vocabulary, False), pc.fill_null(batch.column("text"), ""), []
        number = (pc.cumulative_sum(pc.cast(pc.binary_length(whole), pa.int64())).to_numpy() - 1) // GROUP
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(whole)]
        for a, b in zip(cuts, cuts[1:]):
            n, ids = bpe.texts(whole[a:b].to_pylist(), end)
            view, ends = memoryview(ids.astype("<u2").tobytes()), np.cumsum(n)
            # The writer puts the end itself.
            raw += [bytes(view[2 * i : 2 * j - 2]) for i, j in zip((ends - n).tolist(), ends.tolist())]
        return pa.RecordBatch.from_pydict({"raw": pa.array(raw, pa.binary())})

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, file: int = FILE) -> None:
    """Write the token files of whole texts, ``file`` documents each at most. The text writer gives bytes as they are, and the separator as its line end."""
    raw = by_batch(docs.select("text"), encoded(vocabulary, end), "raw binary").select(F.col("raw").cast("string").alias("value"))
    raw.write.option("lineSep", end.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", file).text(path)


def count(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, doc_no (within the file), start (ids and separators before it in the file) and n_tokens of each document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                view = memoryview(content.as_buffer())
                for k in range(0, max(1, -(-len(view) // block))):
                    ids = np.frombuffer(view[k * block : (k + 1) * block], "<u2")
                    at = np.flatnonzero(ids == end)
                    tail = len(ids) - (at[-1] + 1 if len(at) else 0)
                    yield pa.RecordBatch.from_pydict({"file": [name.rsplit("/", 1)[1]], "block": pa.array([k], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "tail": pa.array([tail], pa.int64()), "ends": pa.array([at.astype(np.int64)], pa.list_(pa.int64())), "begins": pa.array([np.concatenate(([0], at[:-1] + 1)).astype(np.int64)[: len(at)]], pa.list_(pa.int64()))})

    blocks = files.select("path", "content").mapInArrow(scan, "file string, block bigint, n_ids bigint, tail bigint, ends array<bigint>, begins array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = F.size("ends") > 0
    stitched = (
        blocks.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("doc_base", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)))
        # Where the open document began: after the last separator of the blocks before.
        .withColumn("opened", F.coalesce(F.max(F.when(found, F.col("base") + F.col("n_ids") - F.col("tail"))).over(before), F.lit(0)))
    )
    docs = stitched.select("file", "base", "doc_base", "opened", F.posexplode(F.arrays_zip("ends", "begins")).alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("base") + F.col("at.begins"))
    return docs.select("file", (F.col("doc_base") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("at.ends") - start).alias("n_tokens"))


def named(spark: SparkSession, docs: DataFrame, path: str, file: int = FILE) -> DataFrame:
    """The counts of the files of ``docs`` at ``path``, with doc_id.

    The files of part k have the rows of partition k of the table in their order, ``file`` each, and so has
    monotonically_increasing_id over the same scan: number k in its upper bits, the place in the lower 33.
    """
    counted = count(spark, path).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long")).withColumn("place", F.regexp_extract("file", r"-c(\d+)", 1).cast("long") * file + F.col("doc_no"))
    at = F.monotonically_increasing_id()
    ids = docs.select("doc_id", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"))
    return ids.join(counted, ["part", "place"]).select("doc_id", "file", "doc_no", "start", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as token files, counts in these alone, then names the documents by file and place."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "tokens")
    write(docs, path)
    return named(spark, docs, path)


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
