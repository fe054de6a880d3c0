"""Entity resolution with all neighbours compared, against all pairs in plain Python."""

from itertools import combinations

from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.operators import dedup
from corvidex.plans import QUERIES


def roots(ids, pairs):
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def by_hand(nodes):
    """Equal keys, then all pairs of labels that share a band, without any bucket's star or block."""
    grams = dedup.shingles(F.col("label"))
    rows = nodes.select("id", "label", X.key(F.col("label")).alias("key"), X.entropy(F.col("label")).alias("e"), dedup.bands(dedup.minhash(grams)).alias("bands")).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault(r["key"], r)
    pairs = [(r["id"], first[r["key"]]["id"]) for r in rows]
    lively = [r for r in first.values() if r["e"] >= dedup.MIN_ENTROPY]
    for a, b in combinations(lively, 2):
        if set(a["bands"]) & set(b["bands"]) and not dedup.guarded(a["label"], b["label"]) and dedup.jaro_winkler(a["label"].lower(), b["label"].lower()) >= dedup.MIN_SIMILARITY:
            pairs.append((a["id"], b["id"]))
    return roots([r["id"] for r in rows], pairs)


def mapping(df):
    return {r["id"]: r["canonical"] for r in df.collect()}


def test_two_groups_in_one_bucket_whose_least_label_fits_neither(spark, monkeypatch):
    monkeypatch.setattr(dedup, "bands", lambda signature: F.array(F.lit(0).cast("long")))
    labels = ["ledger export", "payment gateway service", "payment gatewey service", "invoice archive worker", "invoice archiv worker"]
    nodes = spark.createDataFrame(list(enumerate(labels, 1)), "id int, label string")
    assert mapping(dedup.entities(nodes)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4} == by_hand(nodes)


def test_groups_of_one_template_match_all_pairs(spark):
    kinds, places = ("gateway", "gatewey", "archive", "archiv", "ledger", "leger"), ("north", "nort h", "south", "sooth", "old", "v2", "7", "17")
    labels = [f"{place} regional payment {kind} service" for kind in kinds for place in places] + [f"regional payment {kind}" for kind in kinds]
    nodes = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    got = mapping(dedup.entities(nodes))
    assert got == by_hand(nodes) and 1 < len(set(got.values())) < len(labels)


def test_query_takes_all_whole_names(spark, sf):
    read = lambda name, kind, key, label: spark.read.parquet(f"{sf}/{name}.parquet").select(F.concat(F.lit(kind), F.col(key)).alias("id"), F.col(label).alias("label"))
    names = read("supplier", "s", "s_suppkey", "s_name").union(read("customer", "c", "c_custkey", "c_name")).union(read("part", "p", "p_partkey", "p_name"))
    got = mapping(QUERIES["entity_dedup"](spark, sf))
    assert len(got) == names.count() and got == by_hand(names)


def test_lsh_parameters():
    for threshold, permutations in ((0.5, 128), (0.8, 128), (0.3, 20), (0.9, 32)):
        bands, rows = dedup.lsh_parameters(threshold, permutations)
        assert bands * rows <= permutations

        def wrong(b, r, n=400):
            meet = [1 - (1 - ((i + 0.5) / n) ** r) ** b for i in range(n)]
            return sum(p if (i + 0.5) / n < threshold else 1 - p for i, p in enumerate(meet)) / n

        least = min(wrong(b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1))
        assert wrong(bands, rows) <= least + 1e-3
    assert dedup.lsh_parameters(1.0, 4) == (1, 4) and dedup.lsh_parameters(0.0, 4) == (4, 1) and dedup.lsh_parameters(0.5, 1) == (1, 1)


def test_labels_are_not_sent_through_the_driver(spark):
    rows = spark.createDataFrame([(1, "large ring"), (2, "Large  Ring"), (3, "widget assembly line"), (4, "widget asembly line")], "id long, label string")
    out = dedup.entities(rows)
    assert {r["id"]: r["canonical"] for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joined) >= 2
