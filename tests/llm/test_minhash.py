from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from corvidex.llm import minhash


def multiset(text):
    words = minhash_words(text)
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def minhash_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text)


def similarity(x, y):
    least = sum((x & y).values())
    return Fraction(least, sum(x.values()) + sum(y.values()) - least) if x and y else Fraction(0)


def brute_classes(rows):
    """{doc_id: least doc_id of its class}, from all pairs."""
    sets = [multiset(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or similarity(sets[i], sets[j]) >= Fraction(4, 5):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    agree, exact = [], []
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 150, 200)]
        other = words[:100] + [f"x{i}" for i in rng.integers(0, 9, 30)] + words[100:] + words[: rng.integers(0, 150)]
        a, b = " ".join(words), " ".join(other)
        owner, hash_, weight = minhash.shingles([a.encode(), b.encode()])
        sig = minhash.signatures(owner, hash_, weight, 2)
        agree.append((sig[0] == sig[1]).mean())
        exact.append(float(similarity(multiset(a), multiset(b))))
    assert abs(np.mean(agree) - np.mean(exact)) < 0.012


def test_heavy_weights_keep_weighted_jaccard():
    a, b = " ".join(["a b c d e"] * 60), " ".join(["a b c d e"] * 25 + ["q r s t u"] * 5)
    owner, hash_, weight = minhash.shingles([a.encode(), b.encode()])
    sig = minhash.signatures(owner, hash_, weight, 2)
    assert abs((sig[0] == sig[1]).mean() - float(similarity(multiset(a), multiset(b)))) < 0.12


def test_query_matches_all_pairs(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    got = minhash.op3_near_duplicates(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({r["class_id"] for r in got})


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_copies(spark, docs_of, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):  # a chain of edits, so that some copies link only through others
        words = base[:]
        for _ in range(k % 6):
            words[rng.integers(0, 120)] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{k}_{i}" for i in range(50)) for k in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def near_copies(members, seed, words=100, most=14, pool=40):
    """Copies of one text with up to ``most`` words replaced out of a small pool, so that edits are shared too."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(members):
        own = base[:]
        for _ in range(rng.integers(0, most)):
            own[rng.integers(0, words)] = f"e{rng.integers(0, pool)}"
        texts.append(" ".join(own))
    return texts


def fast_classes(texts):
    """As ``brute_classes``: all pairs by one matrix of overlaps. Only for texts whose shingles are all different."""
    names: dict = {}
    held = [{names.setdefault(s, len(names)) for s in multiset(t)} for t in texts]
    matrix = np.zeros((len(texts), len(names)), np.float32)
    for i, own in enumerate(held):
        matrix[i, list(own)] = 1
    n = matrix.sum(1)
    assert all(sum(multiset(t).values()) == k for t, k in zip(texts, n))
    root = np.arange(len(texts))
    both = matrix @ matrix.T
    near = 9 * both >= 4 * (n[:, None] + n[None, :])
    while True:
        least = np.where(near, root[None, :], len(texts)).min(1)
        if (least == root).all():
            return dict(enumerate(root.tolist()))
        root = least


@pytest.mark.parametrize("most", [14])
def test_large_groups_against_all_pairs(spark, docs_of, most):
    texts = near_copies(500, most, most=most)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert got == fast_classes(texts)


def test_pairs_of_a_large_group_are_linear(spark, docs_of, monkeypatch):
    counts = []
    verify = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, texts: counts.append(pairs.count()) or verify(pairs, texts))
    made = []
    for members in (150, 600):
        counts.clear()
        minhash.near_duplicates(docs_of(near_copies(members, 3, most=30))).count()
        made.append(sum(counts) / members)
    assert made[1] < 2 * made[0] + 2


def test_nulls_short_texts_repeats_and_clashing_columns(spark, docs_of):
    long = "w " * 70_000 + "end"
    docs = docs_of([(1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "a  b"), (7, "a c"), (8, long), (9, long), (9, long), (None, "a b"), (10, " "), (11, "b a")])
    docs = docs.selectExpr("*", "'x' AS node", "1 AS class_id", "2 AS size", "3 AS __node", "4 AS keeper", "5 AS count")
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True), (9, 8, False), (9, 8, False), (None, 5, False), (10, 10, True), (11, 11, True)], key=str)
    kept = minhash.keep_one(docs.union(docs.where("doc_id = 8")))
    assert kept.columns == docs.columns
    assert {(r["node"], r["__node"], r["keeper"], r["count"]) for r in kept.collect()} == {("x", 3, 4, 5)}
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 7, 8, 10, 11]
    empty = docs.where("false")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
