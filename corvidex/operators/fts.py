"""Full text over a kept table of postings.

``build`` writes (term, key, tf) with weighted counts, dealt into folders by a hash of a term's first two letters (a large
folder by several tasks), and the lengths of the documents. A search reads the folders of its terms alone, never the texts. Terms are prefixes, joined by OR;
scores are BM25 with the weights of the columns, a prefix counting as one term. With ``stemmed`` both texts and questions
go by Porter's stems. ``places`` keeps where words stand, for phrases that read no text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions import porter
from corvidex.functions import text as X
from corvidex.functions.secrets import bound
from corvidex.operators.retrieval import B, K1, MAX_TERMS
from corvidex.sources.tables import spread, written

FOLDERS = 256


def searchable(text: Column) -> Column:
    """A text with its identifiers also taken apart: processPayment and process_payment give process and payment."""
    parts = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w.rlike("[a-z0-9][A-Z]|_"))
    return F.concat_ws(" ", text, F.array_join(F.transform(parts, X.split_identifiers), " "))


def prefixes(query: str) -> list[str]:
    """The different words of two letters or more of a query and of its identifiers' parts, twelve at most."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", query).replace("_", " ")
    found = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", f"{query} {split}") if len(w) > 1]
    return list(dict.fromkeys(found))[:MAX_TERMS]


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(2))), F.lit(FOLDERS)).cast("int")


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    documents: int
    average: float
    stemmed: bool = False


def _stems(spark: SparkSession, words: Sequence[str]) -> list[str]:
    """The different stems of a question's words."""
    row = spark.createDataFrame([(list(words),)], "w array<string>").select(porter.stems(F.col("w")).alias("w")).first()
    return row["w"]


def build(docs: DataFrame, key: str, weights: Mapping[str, float], expand: bool = True, stemmed: bool = False) -> Index:
    """Index the text columns that ``weights`` names. One row for each term of a document: the map side of the shuffle
    already adds up a document's repeats. With ``stemmed`` the documents are dealt by key first, so that words and then their
    stems are added up where they are, and each different word of a document is stemmed once."""
    if stemmed:
        docs = docs.select(key, *weights).repartition(key)
    tokens = lambda c: X.words(searchable(F.coalesce(F.col(c), F.lit(""))) if expand else F.coalesce(F.col(c), F.lit("")))
    listed = docs.select(F.col(key), *[tokens(c).alias(c) for c in weights])
    weighted = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    every = F.flatten(F.array(*[F.transform(c, weighted(w)) for c, w in weights.items()]))
    rows = listed.select(key, F.explode(every).alias("t")).groupBy(key, "t.term").agg(F.sum("t.w").alias("tf"))
    if stemmed:
        rows = rows.groupBy(key, porter.stem(F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))
    folded = rows.withColumn("folder", _folder(F.col("term"))).hint("rebalance", "folder")
    lengths = written(listed.select(key, sum(F.size(c) for c in weights).alias("n")), "lengths")
    n, average = lengths.agg(F.count("*"), F.avg("n")).first()
    return Index(written(folded, "postings", by=["folder"]), lengths, n, average or 1.0, stemmed)


def matches(index: Index, query: str) -> DataFrame:
    """prefix, term, key, tf of the postings that a query's prefixes meet."""
    found = prefixes(query)
    if not found:
        return index.postings.select(F.lit("").alias("prefix"), "*").where("false")
    spark = index.postings.sparkSession
    if index.stemmed:
        found = list(dict.fromkeys(_stems(spark, found)))
    folders = [r[0] for r in spark.createDataFrame([(p,) for p in found], "p string").select(_folder(F.col("p"))).distinct().collect()]  # twelve at most
    hits = F.filter(F.array(*[F.lit(p) for p in found]), lambda p: F.startswith(F.col("term"), p))
    return index.postings.where(F.col("folder").isin(folders)).select(F.explode(hits).alias("prefix"), "*")


def search(index: Index, query: str, key: str) -> DataFrame:
    """key, score of the documents that have a term. Only they are joined with their lengths."""
    tf = matches(index, query).groupBy("prefix", key).agg(F.sum("tf").alias("tf"))
    tf = written(tf, "hits")
    df = {r["prefix"]: r["df"] for r in tf.groupBy("prefix").agg(F.count("*").alias("df")).collect()}  # twelve at most
    n = index.documents
    idf = F.lit(0.0)
    for p, d in df.items():
        idf = F.when(F.col("prefix") == p, max(1e-6, math.log((n - d + 0.5) / (d + 0.5)) if n > d else 1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / index.average))
    return tf.join(index.lengths, key).groupBy(key).agg(F.sum(part).alias("score"))


def phrase(index: Index, docs: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """The keys whose text has the words of a query in a row. Postings of all its words leave few texts to look at."""
    wanted = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()]
    rows = index.postings.where(F.col("term").isin(wanted))
    keys = rows.groupBy(key).agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(set(wanted))).select(key)
    line = F.concat(F.lit(" "), F.array_join(X.words(F.col(column)), " "), F.lit(" "))
    return docs.join(keys, key, "left_semi").where(line.contains(" " + " ".join(wanted) + " ")).select(key)


def _gathered(pairs: Column) -> Column:
    """An array of (term, at) to one of (term, at: all of them), by sorting it: what has one term then lies in a row."""

    def cut(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(x) + 1), lambda i: (i == 1) | (i > F.size(x)) | (F.get(x, i - 1)["term"] != F.get(x, i - 2)["term"]))
        run = lambda all_, i, k: F.struct(F.get(x, i - 1)["term"].alias("term"), F.transform(F.slice(x, i, F.get(all_, k + 1) - i), lambda y: y["at"]).alias("at"))
        return bound(begins, lambda all_: F.transform(F.slice(all_, 1, F.size(all_) - 1), lambda i, k: run(all_, i, k)))

    return bound(F.sort_array(pairs), cut)


def _placed(words: Column, stemmed: bool) -> Column:
    """The words of a text as an array of (term, at: sorted places); each different word is stemmed once."""
    found = _gathered(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at"))))
    if not stemmed:
        return found
    by_stem = lambda x: F.zip_with(porter.stems(F.transform(x, lambda y: y["term"])), x, lambda s, y: F.struct(s.alias("term"), y["at"].alias("at")))
    return F.transform(_gathered(bound(found, by_stem)), lambda y: F.struct(y["term"].alias("term"), F.sort_array(F.flatten(y["at"])).alias("at")))


def places(docs: DataFrame, key: str, columns: Sequence[str], stemmed: bool = False) -> DataFrame:
    """term, key, field, at (sorted array): where words stand in each column. A null column has none. A text's words are
    gathered within its row; only what is written is shuffled, once."""
    listed = [F.struct(F.lit(c).alias("field"), _placed(X.words(F.coalesce(F.col(c), F.lit(""))), stemmed).alias("terms")) for c in columns]
    rows = spread(docs.select(key, *columns)).select(key, F.explode(F.array(*listed)).alias("f")).select(key, "f.field", F.explode("f.terms").alias("t"))
    return written(rows.select("t.term", key, "field", "t.at", _folder(F.col("t.term")).alias("folder")).hint("rebalance", "folder"), "places", by=["folder"])


def in_a_row(places: DataFrame, key: str, query: str, stemmed: bool = False) -> DataFrame:
    """The keys of which a column has the words of a query in a row; none for a query without words.

    Every place says where a phrase would begin if it were that word of it; where all of them agree there is one.
    """
    wanted = [w for w in re.split("[^a-z0-9]+", query.lower()) if w]
    spark = places.sparkSession
    if not wanted:
        return places.select(key).where("false")
    wanted = _stems(spark, wanted) if stemmed else wanted
    folders = [r[0] for r in spark.createDataFrame([(w,) for w in set(wanted)], "w string").select(_folder(F.col("w"))).distinct().collect()]  # no more than the query's words
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(wanted)])
    held = places.where(F.col("folder").isin(folders) & F.col("term").isin(wanted)).select(key, "field", "at", F.explode(F.filter(order, lambda o: o["w"] == F.col("term"))).alias("o"))
    begins = held.select(key, "field", "o.i", F.explode(F.transform("at", lambda p: p - F.col("o.i"))).alias("begin"))
    return begins.groupBy(key, "field", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key).distinct()


def loose(index: Index, query: str, key: str) -> DataFrame:
    """The keys that have any of a query's words as a prefix."""
    return matches(index, query).select(key).distinct()
