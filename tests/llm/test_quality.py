import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corvidex.llm import quality
from corvidex.llm.common import materialize


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated), len(words) < 20 or 100 * len(repeated) > 30 * len(words)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_matches_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        assert tuple(rows[doc_id][c] for c in COLUMNS) == brute(text)
        assert not (rows[doc_id]["base_failed"] and rows[doc_id]["kept"])


def test_it_finds_labelled_junk_and_leaves_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    bad, good = [r for r in rows if not r["quality"]], [r for r in rows if r["quality"]]
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad)
    assert sum(r["kept"] for r in good) > 0.99 * len(good)


ODD = [None, "", " \n\t\x0b", "a b c d e f g h " * 5, "x\n\nx\nx \n x", "é|日本 #*\r\n" * 3, "w" * 200_000, " ".join(f"w{i % 50}" for i in range(30_000)), "a b c d e f g h i a b c d e f g h", "\x1c a\x85b \xa0"]


def test_odd_texts_nulls_and_clashing_columns(spark, docs_of):
    docs = docs_of([*ODD, ODD[3]]).selectExpr("*", "1 AS n_words", "'q' AS quality", "2 AS __at", "3 AS __words", "4 AS __quality", "5 AS __q_words", "6 AS votes")
    held = materialize(quality.with_signals(docs, "__signals"), "test")
    got = quality.judged(held, quality.fit(held, "__signals"), "__signals").orderBy("doc_id").select("__signals.*").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [brute(x) for x in [*ODD, ODD[3]]]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {tuple(r[c] for c in docs.columns[5:]) for r in kept.collect()} <= {(1, "q", 2, 3, 4, 5, 6)}
    empty = docs.where("false")
    assert quality.fit(materialize(quality.with_signals(empty, "__signals"), "test"), "__signals").weights == {}
    assert quality.keep_good(empty).count() == 0


KINDS = {"x": ("a", "b", "c"), "y": ("d", "e")}


def brute_em(rows, rules, kinds):
    """EM over single rows in plain loops; the posterior of good of each row."""
    names = ["good", *kinds]
    fault = {k: {r: 0.02 if k == "good" else 0.8 if r in kinds[k] else 0.05 for r in rules} for k in names}
    first, share = {k: dict(v) for k, v in fault.items()}, {k: 1 - 0.02 * len(kinds) if k == "good" else 0.02 for k in names}
    opening, seen = dict(share), None
    for turn in range(quality.ROUNDS + 1):
        post = []
        for row in rows:
            p = {k: share[k] for k in names}
            for k in names:
                for r, v in zip(rules, row):
                    p[k] *= {-1: fault[k][r], 0: 1, 1: 1 - fault[k][r]}[v]
            post.append({k: x / sum(p.values()) for k, x in p.items()})
        if turn == quality.ROUNDS or seen and max(abs(a[k] - b[k]) for a, b in zip(seen, post) for k in names) < 1e-9:
            break
        seen = post
        for k in names:
            share[k] = (sum(p[k] for p in post) + opening[k]) / (len(rows) + 1)
            for i, r in enumerate(rules):
                bad = sum(p[k] for p, row in zip(post, rows) if row[i] == -1)
                good = sum(p[k] for p, row in zip(post, rows) if row[i] == 1)
                at = (bad + first[k][r]) / (bad + good + 1)
                at = min(at, 0.5) if k == "good" else max(at, 0.5) if r in kinds[k] else at
                fault[k][r] = min(max(at, 1e-12), 1 - 1e-12)
    return [p["good"] for p in post]


def planted(n=400, seed=3):
    """Votes: 5 % junk that a, b, c mostly find, 5 % that d, e find; rule c finds fault with a tenth of the good ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "x" if i % 20 == 0 else "y" if i % 20 == 1 else None
        rows.append(tuple(-1 if rng.random() < (0.9 if r in KINDS.get(kind, ()) else 0.1 if r == "c" else 0.01) else rng.choice([0, 1, 1, 1]) for r in "abcde"))
    return rows


def test_em_against_brute_force_over_rows_and_its_column(spark):
    rows = planted()
    model = quality.em(sorted(Counter(rows).items()), list("abcde"), KINDS)
    want = brute_em(rows, "abcde", KINDS)
    df = spark.createDataFrame([(i, dict(zip("abcde", r))) for i, r in enumerate(rows)], "i int, v struct<a:int,b:int,c:int,d:int,e:int>")
    got = df.select("i", model.score(F.struct(F.col("v").alias("votes"))).alias("p")).orderBy("i").collect()
    assert max(abs(r["p"] - w) for r, w in zip(got, want)) < 1e-6


def test_a_noisy_rule_is_outvoted():
    rows = planted()
    want = dict(zip(rows, brute_em(rows, "abcde", KINDS)))
    assert want[1, 1, -1, 1, 1] > 0.9  # all-must-pass drops these
    assert want[-1, -1, -1, 1, 1] < 0.1 and want[1, 1, 1, -1, -1] < 0.1


def test_verdicts_differ_from_all_must_pass(spark):
    held = materialize(quality.with_signals(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")), "test")
    model = quality.fit(held)
    faults = sum((F.col("quality.votes")[r] == -1).cast("int") for r in quality.RULES)
    rows = quality.judged(held, model).where("NOT quality.base_failed").select(faults.alias("faults"), "quality.kept").collect()
    assert sum(r["faults"] > 0 and r["kept"] for r in rows) >= 5
    assert all(r["kept"] for r in rows if not r["faults"])
