"""Ranked search against scoring everything in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvidex.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, k=50):
    said = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, total = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in said:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def made(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    return [(i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(200)], k=draw.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("size", [10, 2000, 10_000_000])
def test_any_size_of_segment(spark, docs_of, size):
    docs, queries = made(1500), [(f"q{i}", text) for i, text in made(25, 2)]
    index = ranked.build(docs_of(docs).repartition(3), size)
    for k in (1, 7, 50):
        assert got(ranked.search(index, items(spark, queries), k)) == plain(docs, queries, k)


def test_nulls_ties_repeated_rows_and_odd_texts(spark, docs_of):
    docs = [(1, "a b"), (2, "A  B!"), (2, "a b"), (None, "a b"), (None, "a b"), (3, None), (4, ""), (5, "?!"), (6, "é É a\x7fb"), (7, "x" * 200_000 + " a"), (8, "a " * 50_000), (9, "日本 b"), *((100 + i, "tie c") for i in range(80))]
    queries = [("1", "a"), ("1", "a"), ("2", "B b B é"), ("3", None), ("4", ""), ("5", "none such"), (None, "tie"), ("6", "日本"), ("7", "É")]
    assert got(ranked.search(ranked.build(docs_of(docs)), items(spark, queries))) == plain(docs, queries)


def test_empty_tables_and_clashing_names(spark, docs_of):
    queries = [("1", "a")]
    assert got(ranked.search(ranked.build(docs_of([])), items(spark, queries))) == Counter()
    assert got(ranked.search(ranked.build(docs_of([(1, None)])), items(spark, queries))) == Counter()
    docs = docs_of([(1, "a"), (2, "b")]).withColumns({"a.b": F.lit(1), "Segment": F.lit(2), "df": F.lit(3), "RANK": F.lit(4)})
    asked = items(spark, queries).withColumns({"a.b": F.lit(1), "doc_id": F.lit(2), "score": F.lit(3)})
    assert got(ranked.search(ranked.build(docs), asked)) == plain([(1, "a"), (2, "b")], queries)
    assert got(ranked.search(ranked.build(docs), items(spark, []))) == Counter()


def test_one_word_in_a_third_and_many_copies(spark, docs_of):
    docs = [(i, "copy of one text" if i % 3 == 0 else f"text {i % 50} hot " + "hot " * (i % 5)) for i in range(3000)]
    queries = [("1", "copy"), ("2", "hot text 7"), ("3", "one hot text")]
    assert got(ranked.search(ranked.build(docs_of(docs).repartition(5), 3000), items(spark, queries))) == plain(docs, queries)


def test_queries_in_several_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ranked, "QUERIES_AT_ONCE", 4)
    docs, queries = made(200), [(f"q{i}", text) for i, text in made(10, 2)]
    assert got(ranked.search(ranked.build(docs_of(docs)), items(spark, queries))) == plain(docs, queries)


def best_cost(scores, run, most, price):
    """Least cost by a plain recursion over all cuts."""
    runs = [scores[i : i + run] for i in range(0, len(scores), run)]
    cost = [0.0] + [math.inf] * len(runs)
    for j in range(1, len(runs) + 1):
        for i in range(max(0, j - most), j):
            held = [x for r in runs[i:j] for x in r]
            cost[j] = min(cost[j], cost[i] + max(held) * len(held) + price * sum(scores) / len(scores))
    return cost[-1]


def test_cuts_have_the_least_cost():
    draw = np.random.default_rng(3)
    df = np.array([1, 4, 5, 37, 2, 90, 8, 300, 1])
    scores = (draw.pareto(1.5, df.sum()) * 100).astype(np.int64) + 1
    for run, most, price in ((4, 32, 6.0), (1, 5, 2.0), (3, 4, 0.5)):
        cuts = ranked.cuts(scores, df, run, most, price)
        starts = np.cumsum(df) - df
        assert set(starts) <= set(cuts.tolist())
        for begin, n in zip(starts, df):
            mine = [c for c in cuts.tolist() if begin <= c < begin + n]
            ends = [*mine[1:], begin + n]
            cost = sum(max(scores[a:b]) * (b - a) for a, b in zip(mine, ends)) + len(mine) * price * scores[begin : begin + n].mean()
            assert cost == pytest.approx(best_cost(scores[begin : begin + n].tolist(), run, most, price))
    assert len(ranked.cuts(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_blocks_are_skipped(spark, docs_of):
    index = ranked.build(docs_of([(i, x + (" rare" * 9 if i < 60 else "")) for i, x in made(5000)]).coalesce(1))
    batch = index.rows.toArrow().to_batches()[0]
    segment, best = ranked._Segment(batch, 0), ranked._Best(10)
    terms, df = segment.terms.to_pylist(), dict(zip(segment.terms.to_pylist(), np.diff(segment.list_start).tolist()))
    for asked in ([b"rare"], [b"rare", b"w0", b"w1"]):
        rows = np.array([terms.index(t) for t in asked])
        segment.met = segment.read = 0
        segment.search(rows, np.array([ranked.weight(df[t], index.documents) for t in asked]), best)
    assert 0 < segment.read < segment.met / 4


def test_a_task_holds_one_segment(spark, docs_of):
    index = ranked.build(docs_of(made(400)).coalesce(1), 2000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.rows.inputFiles()]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with ranked.one_row_a_batch(spark):
        sizes = index.rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert {r["n"] for r in sizes} == {1}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_documents(spark, sf):
    docs, queries = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    assert got(ranked.op12_ranked_search(spark, sf)) == plain(docs, queries)
