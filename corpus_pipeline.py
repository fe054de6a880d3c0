"""The training-data pipeline: documents in, encoded documents out, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever
others there are and whatever their names.

What the stages do with odd rows: a null or empty text fails the base rule and goes in the first stage, as does a text of
fewer than 20 words; were such rows given to the language stage they would go there too (no language), near_duplicates
keeps all null texts and one of the empty ones, decontamination keeps both (no words, so nothing is hit) and encoding gives
no ids. Null doc_ids are ids like any other; among copies they are kept last. Ties: of near copies the least doc_id stays.
Repeated rows: all stay or go in the first two and the fourth stage, one stays in the third. Very long texts are whole in
each. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvidex.llm import bpe, decontaminate, langid, minhash, quality
from corvidex.llm.common import materialize, table

#: Least score of a language; a text whose languages share its n-grams evenly says nothing.
LEAST_SCORE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the base rule or whose posterior quality is below a half go."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: learns from the labelled documents of this stage; documents without a language, of a low score, or whose
    n-grams the language mostly doesn't know, go."""
    model, floor = langid.learn_with_floor(docs)
    return langid.identify(docs, model, keep=True, least=LEAST_SCORE, least_known=floor)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document of least doc_id stays of each class of near-duplicates."""
    return minhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that benchmark windows contaminate go."""
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), only_clean=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids and decoded texts as digests."""
    return bpe.encode_decode(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("bpe", encoded)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
