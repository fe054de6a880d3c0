"""Exact dedup (operator 11), in DataFrame functions only.

Skew-safe combining in three steps, each of which groups by the digest *and* the whole text, so that equal digests of
different texts never meet: every task first combines its own rows (the partial aggregate below the first shuffle), then
salted groups are merged, then the winners of the salts. The salt is that of the task, so that a text with a third of all
rows sends one row a task to ``SALTS`` groups and one row a salt to the last. A winner holds the largest doc_id, the
number of rows, and the text's place among those of its digest.

Then every row finds its group by the digest alone, without its text. Two things keep that right and even: texts whose
digest another text shares are joined by digest and text; and groups of at least 1 / ``HOT`` of all rows, of which there
are at most ``HOT``, are broadcast, so that their rows aren't shuffled by their key.

Null text counts as an empty one. Null doc_ids are least: they stay only in a group without another doc_id, keep_id null.
Of repeated rows (equal doc_id and text) all but one are dropped, all are counted. Texts are compared byte by byte,
nothing is normalised unless ``normalised`` says so. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.common import materialize, table

#: Groups that one text's winners of the tasks are merged in before the last.
SALTS = 32
#: At most so many groups are broadcast, as each has this share of all rows at least.
HOT = 1000
#: Copies of one row that a task expands at once.
_COPIES = 65_536


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id and group_size of each different text of ``docs`` (doc_id, digest, text)."""
    salted = docs.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def copies_of(df: DataFrame, count: str, position: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0; long runs of copies are dealt out anew before they are written out."""
    columns = [c for c in df.columns if c != count]
    single = df.where(F.col(count) == 1).select(*columns, F.lit(0).cast("long").alias(position))
    runs = df.where(F.col(count) > 1).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / _COPIES))))
    runs = runs.repartition("digest", "run")
    last = F.least(F.lit(_COPIES).cast("long"), F.col(count) - F.col("run") * _COPIES) - 1
    return single.unionByName(runs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*columns, (F.col("run") * _COPIES + F.col("copy")).alias(position)))


def groups(docs: DataFrame, normalised: Callable[[Column], Column] = lambda text: text, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    ``normalised``: what texts are compared by. ``digest``: what shortens it; a weak one changes the work, not the result.
    """
    text = normalised(F.coalesce(F.col("text"), F.lit("")))
    whole = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    found = winners(whole, salts).withColumn("sha", sha256(F.col("text")))
    # Texts of one digest: a second one is as good as impossible for a sound digest, and its rows take their text along.
    best = materialize(found.groupBy("digest").agg(F.count("*").alias("texts"), F.max(F.struct("keep_id", "group_size", "sha")).alias("best"), F.sum("group_size").alias("rows")), "exact-groups")
    alone = best.where("texts = 1").select("digest", "best.*")
    shared = best.where("texts > 1").select("digest")
    rows = whole.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    result = ["doc_id", "digest", "copies", "keep_id", "group_size", "sha"]
    total = best.agg(F.sum("rows")).first()[0] or 0
    large = F.broadcast(alone.where(F.col("group_size") * hot >= total).withColumn("large", F.lit(True)))
    near = rows.join(large, "digest", "left")
    joined = near.where("large").select(*result).unionByName(near.where("large IS NULL").select("doc_id", "digest", "copies").join(alone.where(F.col("group_size") * hot < total), "digest").select(*result))
    if best.where("texts > 1").limit(1).count():
        met = whole.join(shared, "digest", "left_semi").groupBy("doc_id", "digest", "text").agg(F.count("*").alias("copies"))
        joined = joined.unionByName(met.join(found, ["digest", "text"]).select(*result))
    placed = copies_of(joined, "copies", "copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return placed.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id
               AND row_number() OVER (PARTITION BY d.t, doc_id) = 1 AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t"""
}
