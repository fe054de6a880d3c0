"""Full text, vector and hybrid retrieval. Queries are small and named; the corpus is never collected."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvidex.functions import text as X
from corvidex.sources.tables import checkpointed, spread, written

K1, B = 1.2, 0.75
MAX_TERMS = 12
#: Queries of a batch search that are broadcast at once, and vectors that are held against them at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 1024, 1024


def terms_of(query: str) -> list[str]:
    """At most twelve different terms of two letters or more."""
    found = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(w) > 1]
    return list(dict.fromkeys(found))[:MAX_TERMS]


def term_counts(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """key, n (words) and tf (how often each of ``terms`` occurs). A text is split once, for its length; a term is counted
    only where the text holds its letters at all."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = F.split(low, "[^a-z0-9]+")
    n = F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    count = lambda t: F.when(low.contains(t), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0)
    return docs.select(key, n.alias("n"), F.array(*[count(t) for t in terms]).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """key, score of the documents that hold a term. Texts are read once: lengths and counts of the query's terms, a few
    numbers a document, are written and serve both the statistics and the scores; documents aren't shuffled. For many
    queries over the same texts keep ``fts.postings`` instead."""
    terms = terms_of(query)
    rows = written(term_counts(spread(docs.select(key, text)), key, text, terms), "terms")
    stats = rows.agg(F.count("*"), F.avg("n"), *[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).first()
    n, average, *found = stats
    score = F.lit(0.0)
    for i, df in enumerate(found):
        tf = F.get("tf", F.lit(i))
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (average or 1.0)))
    return rows.where(F.exists("tf", lambda x: x > 0)).select(key, score.alias("score"))


def sigmoid(score: Column, terms: int) -> Column:
    """BM25 to 0..1; longer queries have a later and flatter middle."""
    middle, steep = (5.0, 0.7) if terms <= 3 else (7.0, 0.6) if terms <= 6 else (9.0, 0.5) if terms <= 9 else (10.0, 0.5) if terms <= 15 else (12.0, 0.5)
    return 1 / (1 + F.exp(-steep * (score - middle)))


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def ranked(rows: DataFrame, score: str, key: str) -> DataFrame:
    """key and rank from 0 of a list that ``top`` has bounded."""
    return rows.select(key, (F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).alias("rank"))


def rrf(lists: Sequence[DataFrame], key: str, constant: int = 60, least: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy(key).agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score")).where(F.col("score") >= least)


def similar(vectors: DataFrame, key: str, vector: str, query: Sequence[float], least: float = -2.0) -> DataFrame:
    """key, score by cosine with one query vector, which is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, X.cosine(F.col(vector), q).alias("score")).where(F.col("score") > least)


def _nearest(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, id_type: str, key: str, vector: str, k: int) -> DataFrame:
    """query_id, key, score: the k best of each partition for one block of queries."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = f"query_id {id_type}, {key} {vectors.schema[key].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        at, keys, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                s = np.round(matrix @ rows.T, 9)
                if part.num_rows > k:
                    floor = np.maximum(floor, np.partition(s, part.num_rows - k, axis=1)[:, part.num_rows - k])
                q, r = np.nonzero(s >= floor[:, None])
                at, keys, scores = np.concatenate((at, q)), np.concatenate((keys, part.column(0).to_numpy()[r])), np.concatenate((scores, s[q, r]))
                order = np.lexsort((keys, -scores, at))
                at, keys, scores = at[order], keys[order], scores[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
                at, keys, scores = (x[rank < k] for x in (at, keys, scores))
        for start in range(0, len(at), ROWS_AT_ONCE):
            end = start + ROWS_AT_ONCE
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[at[start:end]]), key: pa.array(keys[start:end]).cast(kind), "score": pa.array(scores[start:end])})

    kind = to_arrow_type(vectors.schema[key].dataType)
    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def batch_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = QUERIES_AT_ONCE) -> DataFrame:
    """The k nearest of each query (query_id, query) by dot product, to nine decimals, ties by key; different integer ids.

    Queries go in blocks of at most ``block``, each collected, broadcast and held against all vectors in one pass, so nothing
    that is broadcast grows with their number. Each partition keeps its own k best of a query before anything is shuffled.
    """
    held, id_type = checkpointed(queries.where("query IS NOT NULL").select("query_id", "query")), queries.schema["query_id"].dataType.simpleString()
    last, local = None, None
    while True:
        page = (held if last is None else held.where(F.col("query_id") > last)).orderBy("query_id").limit(block).toArrow().combine_chunks()
        if not page.num_rows and local is not None:
            break
        ids = page.column("query_id").to_numpy()
        matrix = np.array(page.column("query").to_pylist(), np.float64) if len(ids) else np.zeros((0, 1))
        near = _nearest(vectors, ids, matrix, id_type, key, vector, k) if len(ids) else vectors.select(F.lit(None).cast(id_type).alias("query_id"), key, F.lit(0.0).alias("score")).where("false")
        local = near if local is None else local.union(near)
        if len(ids) < block:
            break
        last = ids[-1].item()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return local.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("query_id", key, "score", "k")


def mmr(candidates: DataFrame, key: str, vector: str, query: Sequence[float], balance: float = 0.5) -> DataFrame:
    """One-shot maximal marginal relevance of bounded candidates; the query isn't normalised, candidates are."""
    q = F.array(*[F.lit(float(x)) for x in query])
    c = candidates.select(key, X.unit(F.col(vector)).alias("__v"))
    other = c.select(F.col(key).alias("__o"), F.col("__v").alias("__u"))
    most = c.join(F.broadcast(other), F.col(key) != F.col("__o"), "left").groupBy(key).agg(F.coalesce(F.max(X.dot(F.col("__v"), F.col("__u"))), F.lit(0.0)).alias("__m"), F.first("__v").alias("__v"))
    return most.select(key, (balance * X.dot(F.col("__v"), q) + (balance - 1) * F.greatest("__m", F.lit(0.0))).alias("score"))


def hybrid(semantic: DataFrame, lexical: DataFrame, boosts: DataFrame, key: str, gate: float) -> DataFrame:
    """(semantic + lexical + boost) over the greatest sum that the signals present can reach; semantic gate first.

    Each has (key, score), scores 0..1, boosts up to 0.5. A signal counts as present if any candidate has it.
    """
    rows = semantic.where(F.col("score") >= gate).select(key, F.col("score").alias("s"))
    rows = rows.join(lexical.select(key, F.col("score").alias("l")), key, "left").join(boosts.select(key, F.col("score").alias("b")), key, "left")
    rows = written(rows, "hybrid")
    any_l, any_b = rows.agg(F.max(F.coalesce("l", F.lit(0.0)) > 0), F.max(F.coalesce("b", F.lit(0.0)) > 0)).first()
    full = 1.0 + (1.0 if any_l else 0.0) + (0.5 if any_b else 0.0)
    total = F.col("s") + F.coalesce("l", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return rows.select(key, F.least(total / full, F.lit(1.0)).alias("score"))


def node_distance(candidates: DataFrame, edges: DataFrame, key: str, centre) -> DataFrame:
    """key, score: 10 for the centre, 1 for its neighbours in either direction, 0 for the rest."""
    near = edges.where(F.col("src") == F.lit(centre)).select(F.col("dst").alias(key)).union(edges.where(F.col("dst") == F.lit(centre)).select(F.col("src").alias(key))).distinct().withColumn("near", F.lit(True))
    score = F.when(F.col(key) == F.lit(centre), 10.0).when(F.col("near"), 1.0).otherwise(0.0)
    return candidates.select(key).distinct().join(near, key, "left").select(key, score.alias("score"))


def mentions(candidates: DataFrame, mentioned: DataFrame, key: str) -> DataFrame:
    """key, score: how many rows of ``mentioned`` name a candidate, 0 for none. Counted before it is joined."""
    counted = mentioned.groupBy(key).agg(F.count("*").alias("score"))
    return candidates.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("score", F.lit(0)).alias("score"))


def entity_boost(matches: DataFrame, links: DataFrame, weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """memory, boost: of the entities that a query matches (entity, similarity) from ``least`` on, similarity times ``weight``,
    less for those that many memories share; the greatest of each memory. links: entity, memory."""
    shared = links.groupBy("entity").agg(F.count("*").alias("n"))
    boost = F.col("similarity") * weight / (1 + 0.001 * F.pow(F.col("n") - 1, F.lit(2)))
    good = matches.where(F.col("similarity") >= least).join(shared, "entity").select("entity", boost.alias("boost"))
    return good.join(links, "entity").groupBy("memory").agg(F.max("boost").alias("boost"))


RERANKERS = ("rrf", "mmr", "node_distance", "mentions")


def hybrid_search(lists: Sequence[DataFrame], key: str, limit: int, rerank: str = "rrf", constant: int = 1, **more) -> DataFrame:
    """The best ``limit`` of several ranked lists (key, rank from 0), each of which should hold twice as many.

    ``rerank``: rrf; mmr (vectors, vector, query); node_distance (edges, centre); mentions (mentioned). Lists are bounded by
    their own limits, so what is ranked here is small. Ties by fused score, then by key.
    """
    fused = rrf(lists, key, constant)
    if rerank == "rrf":
        return top(fused, "score", key, limit)
    if rerank == "mmr":
        vectors = more["vectors"].join(fused.select(key), key, "left_semi")
        scored = mmr(vectors, key, more["vector"], more["query"])
    elif rerank == "node_distance":
        scored = node_distance(fused, more["edges"], key, more["centre"])
    elif rerank == "mentions":
        scored = mentions(fused, more["mentioned"], key)
    else:
        raise ValueError(f"{rerank} is none of {', '.join(RERANKERS)}")
    both = scored.join(fused.select(key, F.col("score").alias("fused")), key)
    return both.orderBy(F.desc("score"), F.desc("fused"), key).limit(limit).select(key, "score")


def search_all(searches: dict[str, DataFrame], key: str) -> DataFrame:
    """The results of several kinds of search (facts, nodes, episodes, communities) as one table: kind, key, score. One plan,
    whose branches run side by side."""
    out = None
    for kind, rows in searches.items():
        named = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias(key), F.col("score").cast("double").alias("score"))
        out = named if out is None else out.unionByName(named)
    return out


def label_score(rows: DataFrame, key: str, label: str, query: str) -> DataFrame:
    """Terms against labels: equal 1000, prefix 100, inside 1, by idf, times the squared share of terms that match."""
    terms = terms_of(query)
    low = F.lower(F.col(label))
    holds = [low.contains(t) for t in terms]
    stats = rows.agg(F.count("*").alias("__n"), *[F.count_if(h).alias(f"__d{i}") for i, h in enumerate(holds)])
    both = rows.join(F.broadcast(stats))  # one row
    score, hits = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        tier = F.when(low == t, 1000.0).when(low.startswith(t), 100.0).when(holds[i], 1.0).otherwise(0.0)
        score, hits = score + tier * F.log(1 + F.col("__n") / (1 + F.col(f"__d{i}"))), hits + F.when(holds[i], 1).otherwise(0)
    return both.select(key, (score * F.pow(hits / len(terms), F.lit(2.0))).alias("score")).where("score > 0")


def trigram_candidates(rows: DataFrame, key: str, label: str, needle: str) -> DataFrame:
    """Rows whose label has all trigrams of the needle; a needle of fewer than three letters is looked for as it is. For
    many needles over the same labels keep ``trigram_postings``."""
    low, needle = F.lower(F.col(label)), needle.lower()
    if len(needle) < 3:
        return rows.where(low.contains(needle)).select(key)
    return rows.where(reduce(lambda a, g: a & low.contains(g), sorted(grams_of(needle)), F.lit(True))).select(key)


def grams_of(needle: str) -> set[str]:
    return {needle[i : i + 3] for i in range(len(needle) - 2)}


def trigram_postings(rows: DataFrame, key: str, label: str) -> DataFrame:
    """gram, key: each different trigram of a label once."""
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3)))
    return rows.select(key, F.explode(F.array_distinct(grams)).alias("gram")).where(F.length("gram") == 3)


def by_trigrams(postings: DataFrame, rows: DataFrame, key: str, label: str, needles: Sequence[str]) -> DataFrame:
    """key of the rows whose label holds one of ``needles``, whatever the case of its letters.

    Candidates of a needle are the keys in the postings of all its trigrams, counted from the rarest ones; they are compared
    with the needle itself, as trigrams may lie apart. Needles without a trigram are looked for in all rows."""
    low = F.lower(F.col(label))
    holds = lambda some: reduce(lambda a, n: a | low.contains(n), some, F.lit(False))
    lows = sorted({n.lower() for n in needles})
    short, long = [n for n in lows if len(n) < 3], [n for n in lows if len(n) >= 3]
    out = rows.where(holds(short)).select(key)
    for n in long:
        own = sorted(grams_of(n))
        hit = postings.where(F.col("gram").isin(own)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select(key)
        out = out.union(rows.join(hit, key, "left_semi").where(low.contains(n)).select(key))
    return out.distinct()


def grep(docs: DataFrame, key: str, text: str, query: str, per_doc: int = 3) -> DataFrame:
    """Lines that hold all terms, by case-insensitive comparison, at most ``per_doc`` of each document."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    for t in query.lower().split():
        lines = lines.where(F.lower("line").contains(t))
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_doc).select(key, (F.col("line_no") + 1).alias("line_no"), "line")
