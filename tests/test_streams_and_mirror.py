"""Streams with timers, mirroring by cursors, and edge betweenness, against plain Python."""

import datetime
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from corvidex.operators.betweenness import edge_betweenness
from corvidex.sources.mirror import Mirror, Source
from corvidex.streaming import jobs, timers

START = datetime.datetime(2024, 5, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def arriving(spark):
    """Files of (group, name, seconds) that a stream reads one after the other, one a batch."""

    class Arriving:
        def __init__(self):
            self.path, self.n = jobs.folder(spark, "arriving"), 0

        def put(self, rows):
            df = spark.createDataFrame([(g, name, at(s)) for g, name, s in rows], "g string, name string, ts timestamp")
            df.coalesce(1).write.mode("append").parquet(f"{self.path}/b{self.n:03}.parquet")
            self.n += 1

        def stream(self):
            return spark.readStream.schema("g string, name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*.parquet")

    return Arriving()


def test_a_burst_gives_one_row_whatever_the_batches_and_a_restart_goes_on(spark, arriving):
    out = jobs.folder(spark, "out")
    run = lambda: sorted((r["group"], r["n"], ",".join(r["paths"])) for r in timers.finished(spark, timers.bursts(arriving.stream(), "g", "name", "ts", 30, "20 seconds"), "bursts", out).collect())
    arriving.put([("a", "x", 0), ("a", "y", 10), ("b", "x", 5), (None, "q", 1)])
    arriving.put([("a", "x", 35), ("a", "z", 20)])  # in time, though out of order
    assert run() == []
    arriving.put([("b", "w", 100)])  # a's pause is over, and b's first
    assert run() == [("a", 4, "x,y,z"), ("b", 1, "x")]
    arriving.put([("a", "late", 2), ("a", "new", 101)])  # the late one is behind the watermark
    arriving.put([("b", "v", 300)])
    assert run() == [("a", 1, "new"), ("a", 4, "x,y,z"), ("b", 1, "w"), ("b", 1, "x")]


def test_rows_of_a_group_go_in_turn_and_errors_do_not_stop_it(spark, arriving):
    def step(memory, payload):
        if payload == "bad":
            raise ValueError("no")
        return {"seen": [*memory.get("seen", []), payload]}, "+".join(memory.get("seen", []))

    out = jobs.folder(spark, "out")
    run = lambda: sorted(tuple(r) for r in timers.finished(spark, timers.in_turn(arriving.stream(), "g", "ts", "name", "name", step, "10 seconds", held=2), "turns", out).collect())
    arriving.put([("a", "two", 4), ("a", "one", 2), ("b", "one", 3)])
    arriving.put([("a", "bad", 3), ("a", "three", 6)])
    arriving.put([("b", "end", 60)])
    assert run() == [("a", "bad", 2, "error", "ValueError: no"), ("a", "one", 1, "ok", ""), ("a", "three", 4, "ok", "one+two"), ("a", "two", 3, "ok", "one"), ("b", "one", 1, "ok", "")]
    arriving.put([("a", "four", 70), ("a", "five", 71)])
    arriving.put([("b", "end", 200)])
    assert [r for r in run() if r[2] > 4] == [("a", "five", 6, "ok", "three+four"), ("a", "four", 5, "ok", "two+three")]


def mirrored(mirror):
    return {name: sorted(tuple(r) for r in mirror.table(name).select(*columns).collect()) for name, columns in (("entities", ("id", "title", "source")), ("links", ("src", "dst", "source")))}


def source(spark, rows, name):
    df = spark.createDataFrame(rows, "id int, updated int, title string, parent int")
    text = lambda c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    return Source(df, "updated", "id", lambda x: {"entities": x.select(text("id").alias("id"), "title"), "links": x.where("parent IS NOT NULL").select(text("id").alias("src"), text("parent").alias("dst"))})


def test_incremental_runs_equal_a_full_one(spark):
    rows = [(1, 10, "a", None), (2, 10, "b", 1), (3, 11, "c", 1)]
    later = [*rows, (4, 11, "late of one mark", 2), (2, 15, "b again", 1), (5, None, "no mark", None)]
    keys = {"entities": ["id"], "links": ["src", "dst"]}
    step = Mirror(spark, jobs.folder(spark, "mirror"), keys)
    assert step.table("entities") is None and step.state().number == 0
    step.sync({"x": source(spark, rows, "x"), "y": source(spark, [(1, 1, "other", None)], "y")})
    before = mirrored(step)
    again = step.sync({"x": source(spark, rows, "x"), "y": source(spark, [(1, 1, "other", None)], "y")})
    assert again.number == 1 and mirrored(step) == before  # nothing new, nothing committed
    step.sync({"x": source(spark, [r for r in later if r[0] != 2 or r[1] != 10], "x")})
    whole = Mirror(spark, jobs.folder(spark, "mirror"), keys)
    whole.sync({"x": source(spark, [r for r in later if r[0] != 2 or r[1] != 10], "x"), "y": source(spark, [(1, 1, "other", None)], "y")})
    assert mirrored(step) == mirrored(whole)
    assert ("x:4", "late of one mark", "x") in mirrored(step)["entities"] and ("x:2", "b again", "x") in mirrored(step)["entities"]
    # A source whose history was written anew: its rows are dropped and read again, the other's stay.
    step.sync({"x": source(spark, [(9, 3, "new history", None)], "x")}, full=True)
    assert mirrored(step) == {"entities": [("x:9", "new history", "x"), ("y:1", "other", "y")], "links": []}
    step.sync({"x": source(spark, [], "x")}, full=True)
    assert mirrored(step)["entities"] == [("y:1", "other", "y")]


def test_a_run_that_dies_leaves_the_old_state(spark, monkeypatch):
    mirror = Mirror(spark, jobs.folder(spark, "mirror"), {"entities": ["id"], "links": ["src", "dst"]})
    mirror.sync({"x": source(spark, [(1, 10, "a", None)], "x")})
    before, state = mirrored(mirror), mirror.state()
    with monkeypatch.context() as m:
        m.setattr(Mirror, "_commit", lambda self, s: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            mirror.sync({"x": source(spark, [(1, 10, "a", None), (2, 12, "b", 1)], "x")})
    assert mirrored(mirror) == before and mirror.state() == state
    mirror.sync({"x": source(spark, [(1, 10, "a", None), (2, 12, "b", 1)], "x")})
    assert mirrored(mirror) == {"entities": [("x:1", "a", "x"), ("x:2", "b", "x")], "links": [("x:2", "x:1", "x")]}


def brandes(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = defaultdict(float)
    for s in near:
        order, up, paths, depth = [], defaultdict(list), defaultdict(float), {s: 0}
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    up[w].append(v)
        depends = defaultdict(float)
        for w in reversed(order):
            for v in up[w]:
                share = paths[v] / paths[w] * (1 + depends[w])
                out[min(v, w), max(v, w)] += share
                depends[v] += share
    n = len(near)
    return {e: x / (n * (n - 1)) for e, x in out.items()}


@pytest.mark.parametrize("pairs", [10**9, 200])
def test_edge_betweenness(spark, pairs):
    draw = random.Random(3)
    edges = [(draw.randrange(30), draw.randrange(30)) for _ in range(45)] + [(100, 101), (101, 102), (7, 7), (0, 1), (0, 1), (1, 0)]
    df = spark.createDataFrame([*edges, (None, 3)], "src int, dst int")
    got = {(r["a"], r["b"]): r["betweenness"] for r in edge_betweenness(df, pairs).collect()}
    assert got == pytest.approx(brandes(edges))


def test_betweenness_of_no_edges(spark):
    assert edge_betweenness(spark.createDataFrame([(1, 1)], "src int, dst int")).count() == 0
