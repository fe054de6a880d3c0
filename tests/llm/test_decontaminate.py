import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from corvidex.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    """(n_words, n_hit, n_items, digest, contaminated) of each text, by trying every window at every word."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        m = min(13, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                own = windows.get(tuple(words[i : i + m]))
                if own:
                    hit.update(range(i, i + m))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def result(rows):
    return [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]


def test_query_matches_brute_force(spark, sf):
    rows = sorted(d.op6_decontamination(spark, sf).collect(), key=lambda r: r["doc_id"])
    texts = duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    assert result(rows) == brute([t for t, in texts], items)
    assert any(r["contaminated"] for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=6), st.lists(st.sampled_from("abc"), max_size=60))
def test_search_matches_brute_force(items, words):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    spans, found = d.hits(d.build([(str(i), d.words_of(x)) for i, x in items]), d.words_of(" ".join(words)))
    n_words, n_hit, n_items, _, _ = brute([" ".join(words)], items)[0]
    assert (sum(e - s for s, e in spans), len(found)) == (n_hit, n_items)


def test_parts_nulls_and_clashing_columns(spark, docs_of, monkeypatch):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "One short É item"), (2, "other"), (None, "x y"), (4, None), (5, "..")]
    texts = [None, "", "a one SHORT É item b", long.upper(), "other " * 3, "x, y", "clean words " * 90_000, "clean words " * 70_000 + long + " more" * 10_000, "w3 w4 w5", None, "x, y"]
    docs = docs_of(texts).selectExpr("*", "'old' AS n_hit", "1 AS __spans", "2 AS spans", "3 AS items", "4 AS __items")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(texts, [(i if i is not None else "", t) for i, t in items])
    for words in (200_000, 15):
        monkeypatch.setattr(d, "PART_WORDS", words)
        rows = sorted(d.mark(docs, bench).collect(), key=lambda r: r["doc_id"])
        assert result(rows) == want
        kept = d.mark(docs, bench, only_clean=True)
        assert kept.columns == docs.columns
        assert {(r["__spans"], r["spans"], r["items"], r["__items"]) for r in [*rows, *kept.collect()]} == {(1, 2, 3, 4)}
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if not w[4]]
    assert d.mark(docs, bench.where("false")).where("contaminated OR n_hit > 0").count() == 0
    assert d.mark(docs.where("false"), bench).count() == 0
