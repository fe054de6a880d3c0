"""Graphs from extractions: each rule on a small case, and random ones against plain Python."""

import random
import re
from collections import defaultdict

from corvidex.operators import extraction as E

NODES = "id string, label string, name string, path string, file_type string, origin string, seq int"
EDGES = "`from` string, target string, relation string, confidence string, confidence_score double, weight string, source_location string"
HYPER = "id string, nodes array<string>, node_ids array<string>"


def report(built):
    return {r["kind"]: r["n"] for r in built.report.collect()}


def test_names_kinds_and_repeated_ids(spark):
    rows = [("1", "", "old", "a.py", "tool", None, 1), ("1", None, "new", None, "sonnet", None, 2), ("2", "B", "x", None, None, None, 1), (" ", "C", None, None, None, None, 1), (None, "D", None, None, None, None, 1)]
    got = {r["id"]: r.asDict() for r in E.read_nodes(spark.createDataFrame(rows, NODES)).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"] == {"id": "1", "label": "new", "source_file": "a.py", "file_type": "concept", "origin": None}
    assert got["2"]["label"] == "B" and got["2"]["file_type"] == "concept"
    numbers = E.read_nodes(spark.createDataFrame([(7, "x", "code")], "ID int, Label string, file_type string")).first()
    assert numbers["id"] == "7" and numbers["label"] == "x" and numbers["file_type"] == "code"


def test_ghosts_merge_only_into_one(spark):
    rows = [("a", "f", None, "x.py", None, "ast", 1), ("g1", "f", None, "x.py", None, None, 1), ("g2", "f ", None, "x.py", None, None, 1), ("b", "h", None, "x.py", None, "ast", 1), ("c", "h", None, "x.py", None, "ast", 1), ("g3", "h", None, "x.py", None, None, 1), ("p", "k", None, "y.py", None, None, 1), ("o", "k", None, "y.py", None, None, 1), ("g4", "f", None, "z.py", None, None, 1)]
    got = {tuple(r) for r in E.ghosts(E.read_nodes(spark.createDataFrame(rows, NODES))).collect()}
    assert got == {("g1", "a"), ("g2", "a"), ("p", "o")}


def test_numbers_of_edges(spark):
    rows = [("a", "b", "r", "0.9", None, "x", None), ("a", "b", "r", None, 0.5, "NaN", None), ("a", "b", "r", "EXTRACTED", float("inf"), "-1", None), ("a", "b", "r", None, None, "2.5", " ")]
    got = sorted([tuple(r)[3:] for r in E.read_edges(spark.createDataFrame(rows, EDGES)).collect()], key=str)
    assert got == sorted([("INFERRED", 0.9, 1.0, None), ("INFERRED", 0.5, 1.0, None), ("EXTRACTED", 1.0, 1.0, None), (None, None, 2.5, None)], key=str)


def test_fates(spark):
    nodes = spark.createDataFrame([(i, i, None, p, None, "ast", 1) for i, p in (("Mod_A", "a.py"), ("mod_b", "b.ts"), ("mod_c", "c.py"), ("doc", "d.md"))], NODES)
    rows = [("mod a", "MOD-C", "calls"), ("Mod_A", "os.path", "imports"), ("Mod_A", "gone", "calls"), ("gone", "Mod_A", "imports"), ("Mod_A", "mod_b", "references"), ("Mod_A", "doc", "references"), ("mod.a", "Mod_A", "imports"), ("mod_c", "mod_c", "calls"), (None, "mod_c", "calls"), ("mod_c", "mod_b", "calls")]
    edges = spark.createDataFrame([(a, b, r, "EXTRACTED", None, None, None) for a, b, r in rows] + [("mod_b", "mod_c", "calls", "INFERRED", None, None, None)], EDGES)
    hyper = spark.createDataFrame([("h1", ["mod a", "Mod_A", "gone", "mod a"], ["doc"]), ("h2", None, ["DOC", None, " "]), ("h3", ["gone"], None), ("h4", [], None), ("h5", None, None)], HYPER)
    built = E.build(nodes, edges, hyper)
    assert {(r["src"], r["dst"], r["relation"]) for r in built.edges.collect()} == {("Mod_A", "mod_c", "calls"), ("Mod_A", "os.path", "imports"), ("Mod_A", "doc", "references"), ("mod_c", "mod_c", "calls"), ("mod_c", "mod_b", "calls")}
    assert {r["id"] for r in built.nodes.where("external").collect()} == {"os.path"} and built.nodes.count() == 5
    assert sorted((r["hyperedge"], r["position"], r["id"]) for r in built.members.collect()) == [("h1", 0, "Mod_A"), ("h1", 1, "Mod_A"), ("h2", 0, "doc")]
    assert report(built) == {"edges found": 4, "edges external": 1, "edges dangling": 2, "edges crossed": 2, "edges loop": 1, "edges incomplete": 1, "nodes merged": 0, "nodes external": 1, "nodes kept": 4, "members kept": 3, "members lost": 2, "hyperedges kept": 2, "hyperedges lost": 1}


def test_one_edge_a_pair(spark):
    nodes = spark.createDataFrame([("a", "a", None, None, None, None, 1), ("b", "b", None, None, None, None, 1)], NODES)

    def best(*rows):
        return E.build(nodes, spark.createDataFrame([("a", "b", *r) for r in rows], EDGES)).edges.first()

    assert best(("uses", "EXTRACTED", 1.0, None, "L1"), ("calls", "AMBIGUOUS", None, None, None))["relation"] == "calls"
    assert best(("calls", "INFERRED", 0.9, None, "L1"), ("calls", "EXTRACTED", None, None, None))["confidence"] == "EXTRACTED"
    assert best(("calls", "INFERRED", 0.9, None, None), ("calls", "INFERRED", 0.1, None, "L7"))["location"] == "L7"
    assert best(("calls", "INFERRED", 0.9, None, None), ("calls", "INFERRED", 0.95, None, None))["score"] == 0.95


def test_empty_tables(spark):
    built = E.build(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([], HYPER))
    assert built.nodes.count() == built.edges.count() == built.members.count() == 0
    assert report(built) == {"nodes merged": 0, "nodes external": 0, "nodes kept": 0}
    assert E.build(spark.createDataFrame([], "id int"), spark.createDataFrame([], "src int, dst int")).members.count() == 0


def test_random_extraction_against_plain_python(spark):
    draw = random.Random(5)
    key = lambda s: re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", s.lower()))
    nodes = [(f"N-{i}" if i % 3 else f"n_{i}", f"l{draw.randrange(40)}", None, f"f{draw.randrange(4)}.py", None, draw.choice(["ast", None]), 1) for i in range(120)]
    ends = [n[0] for n in nodes] + [n[0].lower().replace("-", "_") for n in nodes] + ["out.a", "out.b"]
    edges = [(draw.choice(ends), draw.choice(ends), draw.choice(["imports", "calls", "uses"]), "EXTRACTED", None, None, None) for _ in range(800)]
    groups = defaultdict(list)
    for n in nodes:
        groups[n[1], n[3]].append(n)
    merged = {}
    for g in groups.values():
        parsed = [n[0] for n in g if n[5]]
        if len(parsed) < 2:
            first = parsed[0] if parsed else min(n[0] for n in g)
            merged.update({n[0]: first for n in g if not n[5] and n[0] != first})
    kept = {n[0] for n in nodes} - set(merged)
    keyed = {}
    for tier, ident, to in sorted([(0, a, b) for a, b in merged.items()] + [(1, n, n) for n in kept], key=lambda x: (x[0], x[2])):
        keyed.setdefault(key(ident), to)
    want = {}
    for a, b, r, *_ in edges:
        s, d = (x if x in kept else keyed.get(key(x)) for x in (a, b))
        if s is None or (d is None and r != "imports") or (r == "imports" and s == d):
            continue
        pair = (s, d or b)
        want[pair] = max(want.get(pair, (False, "")), (r != "uses", r))
    built = E.build(spark.createDataFrame(nodes, NODES).repartition(5), spark.createDataFrame(edges, EDGES).repartition(5))
    assert {(r["src"], r["dst"]): r["relation"] for r in built.edges.collect()} == {p: r for p, (_, r) in want.items()}
    assert {tuple(r) for r in built.merged.collect()} == set(merged.items())


def test_steps_are_read_back_from_tables(spark):
    nodes = spark.createDataFrame([("a", "A", "x.py"), ("b", "B", "y.py")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, relation string")
    assert E.build(nodes, edges).edges.inputFiles()  # written once, not computed twice for a checkpoint
