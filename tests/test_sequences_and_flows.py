"""Failures made good and flows from entry points, against plain Python."""

import random
from collections import defaultdict

import pytest

from corvidex.operators.flows import flows
from corvidex.operators.sequences import error_fixes

CALLS = "turn string, seq long, signature string, target string, failed boolean, worked boolean, edit boolean"


def plain_fixes(rows):
    turns, out = defaultdict(list), set()
    for r in rows:
        turns[r[0]].append(r)
    for turn, calls in turns.items():
        calls.sort(key=lambda r: r[1])
        for i, (_, seq, sig, target, failed, *_) in enumerate(calls):
            j = next((j for j in range(i + 1, len(calls)) if calls[j][2] == sig and calls[j][5]), None) if failed else None
            if j is None:
                continue
            edits = sum(bool(c[6] and c[5] and c[3]) for c in calls[i + 1 : j])
            changed = target is None or calls[j][3] != target
            if edits or changed:
                out.add((turn, seq, sig, calls[j][1], edits, changed))
    return out


@pytest.mark.parametrize("stretch", [3, 50, 10_000])
def test_error_fixes(spark, stretch):
    draw = random.Random(stretch)
    rows = [(t, i, draw.choice("abc"), draw.choice(["x", "y", None]), *draw.choice([(True, False), (False, True), (False, False)]), draw.random() < 0.3) for t, n in (("long", 400), ("short", 12), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, CALLS).repartition(4)
    got = error_fixes(df, ["turn"], stretch)
    assert got.columns == ["turn", "seq", "signature", "fixed_by", "edits", "changed"]
    assert {tuple(r) for r in got.collect()} == plain_fixes(rows)


def test_a_plain_retry_fixes_nothing_and_nulls_are_false(spark):
    rows = [("t", 1, "test", "x", True, False, False), ("t", 2, "test", "x", False, True, False), ("u", 1, "test", "x", True, None, None), ("u", 2, "edit", "f", None, True, True), ("u", 3, "test", "x", None, True, None), ("u", None, "test", "x", True, None, None)]
    assert {tuple(r) for r in error_fixes(spark.createDataFrame(rows, CALLS), ["turn"]).collect()} == {("u", 1, "test", 3, 1, False)}
    assert error_fixes(spark.createDataFrame([], CALLS), ["turn"]).count() == 0


def plain_flows(entries, edges, through, hops):
    near, out = defaultdict(dict), []
    for src, dst, rule, rank in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        near[src].setdefault(dst, rule)
    for entry, node in sorted(set(entries)):
        frontier, visited, position = [node], {node}, 0
        for level in range(hops):
            following = []
            for at in frontier:
                for dst, rule in near[at].items():
                    position += 1
                    out.append((entry, position, level, at, dst, rule))
                    if dst in through and dst not in visited:
                        visited.add(dst)
                        following.append(dst)
            frontier = following
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 2, 4])
def test_flows_in_the_order_of_a_plain_walk(spark, hops):
    draw = random.Random(hops)
    edges = [(f"n{draw.randrange(15)}", f"n{draw.randrange(15)}", draw.choice(["http", "queue"]), draw.randrange(3)) for _ in range(60)]
    through, entries = {f"n{i}" for i in range(0, 15, 2)}, [("e1", "n0"), ("e2", "n3"), ("e1", "n0"), ("none", "n99")]
    df = spark.createDataFrame([*edges, (None, "n1", "http", 0)], "src string, dst string, rule string, rank int")
    got = flows(spark.createDataFrame(entries, "entry string, node string"), df, spark.createDataFrame([(x,) for x in through], "id string"), hops)
    assert got.columns == ["entry", "position", "level", "src", "dst", "rule"]
    assert sorted(tuple(r) for r in got.collect()) == plain_flows(entries, edges, through, hops)
