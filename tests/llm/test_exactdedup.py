"""Exact dedup against a plain dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvidex.llm import exactdedup


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out[i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(tuple(r) for r in df.collect())


ROWS = [(1, "a"), (7, "a"), (3, "a"), (4, None), (5, ""), (6, "a "), (8, "A"), (9, "é"), (10, "é"), (None, "a"), (None, "only"), (None, "only"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "x" * 299_999 + "y"), (7, "a"), (7, "b")]


def test_nulls_ties_repeated_rows_and_long_texts(spark, docs_of):
    assert got(exactdedup.groups(docs_of(ROWS))) == plain(ROWS)


def test_texts_of_equal_digests_stay_apart(spark, docs_of):
    draw = random.Random(1)
    rows = ROWS + [(100 + i, draw.choice("abcdefgh") * draw.randint(1, 4)) for i in range(300)]
    docs = docs_of(rows).repartition(7)
    for weak in (lambda t: F.length(t).cast("string"), lambda t: F.lit("same")):
        assert got(exactdedup.groups(docs, digest=weak)) == plain(rows)


@pytest.mark.parametrize("hot", [1, 4, 100_000])
def test_one_text_with_a_third_of_all_rows(spark, docs_of, hot):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    assert got(exactdedup.groups(docs_of(rows).repartition(9), hot=hot, salts=3)) == plain(rows)


def test_many_repeats_of_one_row(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exactdedup, "_COPIES", 10)
    rows = [(1, "a")] * 35 + [(2, "a")] * 20 + [(3, "b")]
    assert got(exactdedup.groups(docs_of(rows))) == plain(rows)


def test_empty_table_extra_columns_and_normalised_texts(spark, docs_of):
    assert got(exactdedup.groups(docs_of([]))) == Counter()
    named = docs_of([(1, "A"), (2, "a")]).withColumns({"a.b": F.lit(1), "Digest": F.lit(2), "KEEP_ID": F.lit(3), "salt": F.lit(4)})
    assert got(exactdedup.groups(named)) == plain([(1, "A"), (2, "a")])
    assert {r["keep_id"] for r in exactdedup.groups(named, normalised=F.lower).collect()} == {2}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(exactdedup.op11_exact_dedup(spark, sf)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
