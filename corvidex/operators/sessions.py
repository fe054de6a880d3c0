"""Search in sessions: what happened around the row that answers a question best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.operators import retrieval
from corvidex.operators.relational import around
from corvidex.sources.tables import checkpointed


def best_match(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """One row, or none: the best by BM25 of those that have all words of a question, else of those that have any; equal
    scores by the least key. A question without words has no match."""
    terms = retrieval.terms_of(query)
    if not terms:
        return rows.where("false")
    words = X.words(F.coalesce(F.col(text), F.lit("")))
    scores = retrieval.bm25(rows, key, text, query)
    # The few rows with a word are read again to see which have all of them.
    every = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))) == len(set(terms))
    found = rows.join(scores, key).withColumn("__all", every)
    return checkpointed(found.orderBy(F.desc("__all"), F.desc("score"), key).limit(1).select(*rows.columns))


def timeline(rows: DataFrame, key: str, ts: str, text: str, query: str, before: int = 10, after: int = 10, group: str | None = None) -> DataFrame:
    """The rows around the best match by (ts, key), with their places from it as ``pos`` (0 is the match itself). With
    ``group`` only rows of the match's group, a null group being one too. Nothing matches: no rows."""
    anchor = best_match(rows, key, text, query)
    if group is not None:
        mark = F.broadcast(anchor.select(F.col(group).alias("__g")))  # one row
        rows = rows.join(mark, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    return around(rows, anchor, ts, key, before, after)
