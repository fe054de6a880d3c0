"""Search for facts: lexical and vector lists with validity filters, fused, and ranked around a node if one is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.operators import fts, retrieval
from corvidex.operators.graph import facts_near


def validity(names: Sequence[str] | None = None, valid_after=None, valid_before=None, invalid_after=None, invalid_before=None, current_only: bool = False, at=None) -> Column:
    """The filter of a fact search over name, valid_at and invalid_at: bounds hold with equality, a bound on a null time
    fails. ``current_only``: not invalid yet. ``at``: true at that time, from valid_at on and before invalid_at."""
    keep = F.lit(True)
    if names is not None:
        keep = keep & F.col("name").isin(*names)
    for column, bound, after in (("valid_at", valid_after, True), ("valid_at", valid_before, False), ("invalid_at", invalid_after, True), ("invalid_at", invalid_before, False)):
        if bound is not None:
            keep = keep & F.coalesce(F.col(column) >= F.lit(bound) if after else F.col(column) <= F.lit(bound), F.lit(False))
    if current_only:
        keep = keep & F.col("invalid_at").isNull()
    if at is not None:
        keep = keep & F.coalesce(F.col("valid_at") <= F.lit(at), F.lit(False)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.lit(at)))
    return keep


def search_facts(facts: DataFrame, lists: Sequence[DataFrame], where: Column, limit: int, centre=None, hops: int = 2) -> DataFrame:
    """id, src, score of the best ``limit`` facts.

    facts: id, src, dst, name, valid_at, invalid_at. lists: (id, score) of each kind of search over all facts. ``where`` is
    applied to each list before it is cut to twice the limit, so that filtered facts don't take the place of others; then
    they are fused. With ``centre`` the facts within ``hops`` of it are a list too, nearest names first, and results are
    ranked by the distance of their src: 10 for the centre, 1 for its neighbours; the fused score breaks ties, then the id.
    """
    kept = facts.where(where)
    ids = kept.select("id", "src")
    found = [retrieval.top(x.select("id", "score").join(ids.select("id"), "id", "left_semi"), "score", "id", 2 * limit) for x in lists]
    if centre is not None:
        seed = facts.sparkSession.createDataFrame([(centre,)], f"id {facts.schema['src'].dataType.simpleString()}")
        found.append(facts_near(kept.select("src", "dst", F.col("id").alias("fact")), seed, hops).select(F.col("fact").alias("id"), F.lit(0.0).alias("score")).orderBy("id").limit(2 * limit))
    fused = retrieval.rrf([retrieval.ranked(x, "score", "id") for x in found], "id", 1).join(ids, "id")
    if centre is None:
        return fused.orderBy(F.desc("score"), "id").limit(limit).select("id", "src", "score")
    near = retrieval.node_distance(fused.select("src"), kept.select("src", "dst"), "src", centre)
    both = fused.withColumnRenamed("score", "fused").join(near, "src")
    return both.orderBy(F.desc("score"), F.desc("fused"), "id").limit(limit).select("id", "src", "score")


def by_words(facts: DataFrame, index: fts.Index, words: Sequence[str], limit: int = 5) -> DataFrame:
    """id, score, valid_at, invalid_at of the facts that a full-text index finds for some words, best first, then by id; scores
    count to three places. No words: no facts. The index holds facts alone, under id."""
    found = fts.search(index, " ".join(words), "id").select("id", F.round("score", 3).alias("score"))
    return retrieval.top(found.join(facts.select("id"), "id", "left_semi"), "score", "id", limit).join(facts.select("id", "valid_at", "invalid_at"), "id")
