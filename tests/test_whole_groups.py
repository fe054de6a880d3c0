"""Co-occurrence over groups of any size, and claims without a key, against brute force and the SQL."""

import random
from collections import Counter
from itertools import combinations

import duckdb
import pytest

from corvidex.operators import relational
from corvidex.plans import ORACLES, QUERIES


def same_as_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = duck.execute(ORACLES[name]).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    return want


def test_cochange_of_large_groups_equals_its_sql(spark, tmp_path):
    draw = random.Random(5)
    lines = [(g, x) for g in range(3) for x in draw.sample(range(400), 300)] + [(3, x) for x in range(45)] + [(4, 1), (4, 2), (4, 2), (5, 7), (None, 1), (3, None)]
    want = same_as_sql(spark, tmp_path, "event_cochange", "lineitem", lines, "l_orderkey long, l_partkey long")
    assert len(want) > 40_000


@pytest.mark.parametrize("most", [None, 40])
def test_blocks_of_large_groups_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(relational, "ITEMS_AT_ONCE", 8)
    draw = random.Random(6)
    sets = [draw.sample(range(120), n) for n in (1, 2, 8, 9, 40, 41, 100)]
    names = spark.createDataFrame([(g, f"f{x}") for g, xs in enumerate(sets) for x in xs] * 2, "g long, x string")
    in_groups = Counter(f"f{x}" for xs in sets for x in xs)
    counts = Counter(p for xs in sets if most is None or len(xs) <= most for p in combinations(sorted(f"f{x}" for x in xs), 2))
    want = {(a, b): (n, round(n / min(in_groups[a], in_groups[b]), 6)) for (a, b), n in counts.items()}
    got = relational.cooccurrence(names, "g", "x", most).collect()
    assert {(r["a"], r["b"]): (r["count"], r["ratio"]) for r in got} == want and len(got) == len(want)


def test_claims_without_a_customer_equal_the_sql(spark, tmp_path):
    orders = [(1, None, "F", 10.0), (2, None, "O", 20.0), (3, 7, "F", 5.0), (4, 7, "O", 6.0), (5, 8, "P", 1.0), (6, 9, "F", 2.0), (7, 10, "O", 2.0), (8, 11, "P", None)]
    same_as_sql(spark, tmp_path, "staleness_recheck", "orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
