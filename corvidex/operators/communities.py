"""Communities of a weighted graph by modularity: parallel local moves, a refinement, and a quotient graph a level.

In a round every node looks at the communities of its neighbours and goes where modularity grows most, ties to the least
community. Only half of the nodes have their turn in a round, the other half in the next, by a hash of their id, and a node alone joins
another one alone only if that one's community is the lesser, so that neighbours don't swap for ever; a state that is worse
than the best one so far isn't kept. Then each community is cut into parts by the same moves, from single nodes on and along
its own edges only; the parts are the nodes of the next level, which starts from the communities. Where a level gains nothing
to speak of, or nothing can be merged into parts, its communities are the nodes of the next level, so that there are few
levels. It ends when every node of a level is a community. At last, communities that aren't connected are cut into their components.

A graph is taken apart into its connected components first, as no community spans two of them. Components of a bounded number
of pairs go to tasks, many small ones together, where the same rounds run over arrays. Larger ones are run by Spark until a level is small enough: each
level's edges are written once, a round reads them and writes one row a node; nothing is collected but sums.
Weights are whole numbers, whose sums don't depend on their order, so that results are the same in each run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvidex.operators import graph
from corvidex.sources.tables import written

#: Communities above this share of all nodes, and of this size at least, are cut again; so are those of this
#: size whose cohesion is below this bound.
SHARE, LEAST_CUT, LEAST_COHESION, LEAST_SPARSE = 0.25, 10, 0.05, 50
#: Growth of modularity that counts as such: at least this, and this share of what a level has gained; rounds without it
#: that end a level's moves, so that each node had a turn; the share of what all levels have gained that makes one worth refining.
GROWTH, OF_GAINED, STALE, OF_ALL = 1e-4, 0.05, 2, 0.01
#: The second of these over arrays, where a round costs less.
OF_ARRAYS = 0.01
#: Rounds of a refinement: each node has one turn.
REFINING = 2
#: Pairs of nodes that a task runs over: about 220 bytes each. Graphs of more than a part of that have a task of their own.
PAIRS_A_TASK, OF_TASK = 1_000_000, 8


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """src, dst, w of an undirected graph in both directions; edges of a pair add up, loops count twice."""
    ends = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return ends.union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pairs_of(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """src <= dst, w: each pair of an undirected graph once, loops among them; edges of a pair add up."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return ends.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _turned(pairs: DataFrame) -> DataFrame:
    """``pairs_of`` edges in both directions, as ``both_ways`` has them."""
    back = pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w")).alias("w")).union(back)


def _nodes(both: DataFrame, group: DataFrame | None = None, m2: int | None = None) -> DataFrame:
    """id, k (weight of its edges), m2 (that of its whole graph) and community (itself). ``group``: id, g; each group is a
    graph of its own. ``m2``: that of a graph of which ``both`` is a part."""
    k = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    if group is None:
        return k.withColumn("m2", F.lit(m2).cast("long")).withColumn("community", F.col("id"))
    k = k.join(group, "id")
    return k.join(k.groupBy("g").agg(F.sum("k").alias("m2")), "g").select("id", "k", "m2", F.col("id").alias("community"))


def _moved(both: DataFrame, nodes: DataFrame, resolution: float, rounds: int | None = None) -> tuple[DataFrame, float]:
    """``nodes`` with the communities of the best state that local moves reach and what it gains, or of that after ``rounds``."""
    edges = both.where("src <> dst")
    now, best, best_q, first_q, stale, turn = nodes, nodes, None, None, 0, 0
    while True:
        total = now.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
        near = edges.join(now.select(F.col("id").alias("dst"), "community"), "dst").select(F.col("src").alias("id"), "community", "w")
        votes = near.union(now.select("id", "community", F.lit(0).cast("long"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        seen = votes.join(total, "community").join(now.withColumnRenamed("community", "own"), "id")
        own = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0)) / F.col("m2")
        seen = seen.withColumn("gain", gain)
        held = lambda c: F.max(F.when(own, F.col(c))).alias(f"own_{c}")
        choice = seen.groupBy("id", "k", "m2", "own").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community", "size")).alias("to"), held("gain"), held("w"), held("size"), held("total"))
        better = (-F.col("to.loss") > F.col("own_gain") + 1e-9) & ~((F.col("own_size") == 1) & (F.col("to.size") == 1) & (F.col("to.community") > F.col("own")))
        mine = F.pmod(F.xxhash64("id", F.lit(turn // 2)) + turn % 2, F.lit(2)) == 0
        # Each node has its share of what the state before its move is worth.
        share = (F.col("own_w") - resolution * F.col("k") * F.col("own_total") / F.col("m2")) / F.col("m2")
        sums = Observation()
        chosen = choice.select("id", "k", "m2", "own", F.when(better & mine, F.col("to.community")).otherwise(F.col("own")).alias("community"), better.alias("better"), F.round(share, 15).cast("decimal(38,15)").alias("share"))
        step = written(chosen.observe(sums, F.sum("share").alias("q"), F.count_if("better").alias("left")), "moves")
        if turn + 1 == rounds:
            return step.select("id", "k", "m2", "community"), 0.0
        now, turn = step.select("id", "k", "m2", "community"), turn + 1
        if rounds is not None:
            continue
        q, left = float(sums.get["q"]), sums.get["left"]
        first_q = q if first_q is None else first_q
        stale = 0 if best_q is None or q > best_q + max(GROWTH, OF_GAINED * (best_q - first_q)) else stale + 1
        if best_q is None or q > best_q:
            best_q, best = q, step.select("id", "k", "m2", F.col("own").alias("community"))
        if not left or stale == STALE:
            return best, best_q - first_q


def _array_moves(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, m2: np.ndarray, own: np.ndarray, resolution: float, rounds: int | None = None) -> tuple[np.ndarray, float]:
    """What ``_moved`` does, over arrays: the communities of nodes 0, 1, ... and what they gain. Edges go both ways, without loops."""
    n = len(k)
    halves, least = _mixed(np.arange(n, dtype=np.uint64)), _least(k, m2)
    best, best_q, first_q, stale, turn, still = own, None, None, 0, 0, 0
    while True:
        _, own = np.unique(own, return_inverse=True)
        total, size = np.bincount(own, k), np.bincount(own)
        there, here = own[dst], own[src]
        inside = there == here
        own_w = np.bincount(src[inside], w[inside], n)
        if rounds is None:
            q = float(np.sum((own_w - resolution * k * total[own] / m2) / m2))
            first_q = q if first_q is None else first_q
            stale = 0 if best_q is None or q > best_q + max(least, OF_ARRAYS * (best_q - first_q)) else stale + 1
            if best_q is None or q > best_q:
                best_q, best = q, own
            if still == 2 or stale == STALE:
                return best, best_q - first_q
        elif turn == rounds:
            return own, 0.0
        mine = (halves >> np.uint64(turn // 2 % 64)) & np.uint64(1) == turn % 2
        asked = ~inside & mine[src]
        node, to, votes = _summed(src[asked], there[asked], w[asked], n, len(total))
        moved = own
        if len(node):
            gain = votes - resolution * k[node] * total[to] / m2[node]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            most = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.r_[starts, len(node)]))
            held = np.flatnonzero(gain == most)
            held = held[np.r_[True, node[held][1:] != node[held][:-1]]]  # ties to the least community
            x, to, gain = node[held], to[held], gain[held]
            stays = own_w[x] - resolution * k[x] * (total[own[x]] - k[x]) / m2[x]
            better = (gain > stays + 1e-9) & ~((size[own[x]] == 1) & (size[to] == 1) & (to > own[x]))
            moved = own.copy()
            moved[x[better]] = to[better]
        still = still + 1 if np.array_equal(moved, own) else 0
        own, turn = moved, turn + 1


def _least(k: np.ndarray, m2: np.ndarray) -> float:
    """``GROWTH`` of what these nodes are of their graphs."""
    return GROWTH * float(np.sum(k / m2))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 even bits of each number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a < n and b < m in order, with the sums of their weights."""
    key = a * m + b
    if n * m <= 4 * len(key):
        sums = np.bincount(key, w, n * m)
        at = np.flatnonzero(sums)
        return at // m, at % m, sums[at]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts] // m, key[starts] % m, np.add.reduceat(w[order], starts) if len(key) else w[:0]


def _array_leiden(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, m2: np.ndarray, resolution: float) -> np.ndarray:
    """What ``_leiden`` does, over arrays, as often as it gains something from the communities of the time before; then cut into
    connected parts. A community is one of its nodes' places."""
    found = np.arange(len(k))
    while True:
        found, gained = _array_levels(src, dst, w, k, m2, found, resolution)
        if gained <= _least(k, m2):
            inside = found[src] == found[dst]
            return _array_components(len(k), src[inside], dst[inside])


def _array_levels(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, m2: np.ndarray, own: np.ndarray, resolution: float) -> tuple[np.ndarray, float]:
    """The communities of all levels from ``own`` on, and what they gain."""
    place, every = np.arange(len(k)), 0.0
    while True:
        own, gained = _array_moves(src, dst, w, k, m2, own, resolution)
        every += gained
        groups, part = np.unique(own, return_inverse=True)
        if len(groups) == len(k):
            return own[place], every
        if gained > max(_least(k, m2), OF_ALL * every):
            inside = own[src] == own[dst]
            names, refined = np.unique(_array_moves(src[inside], dst[inside], w[inside], k, m2, np.arange(len(k)), resolution, REFINING)[0], return_inverse=True)
            part = refined if len(names) < len(k) else part
        _, first = np.unique(part, return_index=True)
        place, own, m2, n = part[place], own[first], m2[first], len(first)
        k = np.bincount(part, k)
        a, b = part[src], part[dst]
        src, dst, w = _summed(a[a != b], b[a != b], w[a != b], n, n)


def _array_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes: roots are hung on lesser ones until no pair crosses."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def _whole(m2: int | None, resolution: float, count: int | None) -> Callable[[pa.Table], pa.Table]:
    """From the pairs of one graph or several (src, dst, w, g) to id, community; see ``_split``."""

    def run(table: pa.Table) -> pa.Table:
        ids, at = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
        a, b = np.split(at, 2)
        w, n = table["w"].to_numpy().astype(float), len(ids)
        k = np.bincount(a, w, n) + np.bincount(b, w, n)
        loop = a == b
        loops = np.bincount(a[loop], 2 * w[loop], n)
        src, dst, w = np.r_[a[~loop], b[~loop]], np.r_[b[~loop], a[~loop]], np.r_[w[~loop], w[~loop]]
        if m2 is None:
            g = np.unique(table["g"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
            of = np.empty(n, np.int64)
            of[a], of[b] = g, g
            found = _array_leiden(src, dst, w, k, np.bincount(of, k)[of], resolution)
        else:
            found = _array_leiden(src, dst, w, k, np.full(n, float(m2)), resolution)

        def cut(found: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            """The communities that are true in ``chosen``, each cut by a run of its own."""
            if not chosen.any():
                return found
            inner = (found[src] == found[dst]) & chosen[found[src]]
            k = np.bincount(src[inner], w[inner], n) + np.where(chosen[found], loops, 0)
            used = np.flatnonzero(k)
            to = np.zeros(n, np.int64)
            to[used] = np.arange(len(used))
            again = _array_leiden(to[src[inner]], to[dst[inner]], w[inner], k[used], np.bincount(found, k, n)[found[used]], 1.0)
            out = np.where(chosen[found], np.arange(n), found)
            out[used] = used[again]
            return out

        if count is not None:
            found = cut(found, np.bincount(found, minlength=n) > max(LEAST_CUT, int(count * SHARE)))
            size, inner = np.bincount(found, minlength=n), found[src] == found[dst]
            edges = np.bincount(found[src[inner]], minlength=n) / 2
            found = cut(found, (size >= LEAST_SPARSE) & (np.round(edges / np.maximum(size * (size - 1) / 2, 1), 6) < LEAST_COHESION))
        names = table.schema.field("src").type
        return pa.table({"id": pa.array(ids, names), "community": pa.array(ids[found], names)})

    return run


def _within(both: DataFrame, groups: DataFrame) -> DataFrame:
    """The edges whose ends have the same community."""
    at = lambda end, name: groups.select(F.col("id").alias(end), F.col("community").alias(name))
    return both.join(at("src", "__a"), "src").join(at("dst", "__b"), "dst").where("__a = __b").select("src", "dst", "w")


def _leiden(both: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """id, community of all ``nodes``."""
    place, every = nodes.select("id", F.col("id").alias("at")), 0.0
    while True:
        found, gained = _moved(both, nodes, resolution)
        every += gained
        n, groups = found.agg(F.count("*"), F.count_distinct("community")).first()
        if groups == n:
            return place.join(found.select(F.col("id").alias("at"), "community"), "at").select("id", "community")
        parts = found.select("id", F.col("community").alias("part"))
        if gained > max(GROWTH, OF_ALL * every):
            refined = _moved(_within(both, found), found.withColumn("community", F.col("id")), resolution, REFINING)[0].select("id", F.col("community").alias("part"))
            parts = refined if refined.select("part").distinct().count() < n else parts
        known = found.join(parts, "id")
        # A part's community is that of its members.
        nodes = written(known.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.max("m2").alias("m2"), F.min("community").alias("community")), "level")
        place = written(place.join(parts.select(F.col("id").alias("at"), "part"), "at").select("id", F.col("part").alias("at")), "places")
        end = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"p_{c}"))
        both = written(both.join(end("src"), "src").join(end("dst"), "dst").groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.sum("w").alias("w")), "level-edges")
        # Ids of the next level are parts, so its communities are named by one of theirs.
        named = nodes.groupBy("community").agg(F.min("id").alias("first"))
        nodes = written(nodes.join(named, "community").select("id", "k", "m2", F.col("first").alias("community")), "level")
        if both.count() <= 2 * PAIRS_A_TASK and nodes.count() <= 2 * PAIRS_A_TASK:  # the levels left fit a task
            schema = nodes.select("id", "community").schema
            one = lambda rows: rows.withColumn("task", F.lit(0)).groupBy("task")
            last = one(nodes).cogroup(one(both.where("src <> dst"))).applyInArrow(_levels_left(resolution), schema)
            return place.join(written(last, "levels-left").withColumnRenamed("id", "at"), "at").select("id", "community")


def _levels_left(resolution: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From the nodes and edges of a level to id, community after all levels, named by one of its nodes."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("id")
        ids = nodes["id"].to_numpy()
        at = lambda c, t: np.searchsorted(ids, t[c].to_numpy())
        k, m2, w = (t[c].to_numpy().astype(float) for t, c in ((nodes, "k"), (nodes, "m2"), (edges, "w")))
        found, _ = _array_levels(at("src", edges), at("dst", edges), w, k, m2, at("community", nodes), resolution)
        first = np.unique(found, return_index=True, return_inverse=True)
        return pa.table({"id": nodes["id"], "community": nodes["id"].take(pa.array(first[1][first[2]]))})

    return run


def connected(both: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` with each community that isn't connected cut into its components; a community is named by its least id."""
    parts = components(written(_within(both.where("src <= dst"), groups), "within"))
    named = groups.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("community"))
    return written(named, "connected")


def components(pairs: DataFrame) -> DataFrame:
    """id, component (one of its ids) of all ends of ``pairs``. Stars are made of two neighbours of each node, which leaves few
    components; the pairs that still cross these are joined after that."""
    ends = pairs.select("src", "dst").union(pairs.select("dst", "src"))
    near = ends.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    found = written(graph.components(written(near.select("src", F.explode(F.array("a", "b")).alias("dst")).distinct(), "near")), "components")
    crossing = written(_tagged(pairs, found).where("g <> h").select(F.col("g").alias("src"), F.col("h").alias("dst")).distinct(), "crossing")
    if crossing.isEmpty():
        return found
    joined = graph.components(crossing).select(F.col("id").alias("component"), F.col("component").alias("of"))
    return written(found.join(joined, "component", "left").select("id", F.coalesce("of", "component").alias("component")), "components")


def _tagged(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` with g and h, the components of their ends."""
    at = lambda end, name: found.select(F.col("id").alias(end), F.col("component").alias(name))
    return pairs.join(at("src", "g"), "src").join(at("dst", "h"), "dst")


def _split(tagged: DataFrame, m2: int | None, resolution: float, count: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(id, community of the graphs g of few pairs, which tasks have run; the pairs of the others, if any).

    ``tagged``: pairs and their g. ``m2`` is that of the whole graph; without it each g is a graph of its own. ``count``: the number of nodes
    of the whole graph, where large and sparse communities are to be cut as well.
    """
    sizes = written(tagged.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    few, n, own = sizes.where(F.col("n") <= PAIRS_A_TASK).agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") * OF_TASK > PAIRS_A_TASK)).first()
    shared = -(-2 * (n or 0) // PAIRS_A_TASK)  # half full, so that few hold more than their bound
    at = F.xxhash64("g")
    task = F.when(F.col("n") * OF_TASK > PAIRS_A_TASK, at).otherwise(F.pmod(at, F.lit(max(shared, 1))))
    small = tagged.join(sizes.where(F.col("n") <= PAIRS_A_TASK).select("g", task.alias("task")), "g").select("task", "g", "src", "dst", "w")
    schema = tagged.select(F.col("src").alias("id"), F.col("src").alias("community")).schema
    done = small.repartition(max(1, min(4 * (own + shared), 4 * few)), "task").groupBy("task").applyInArrow(_whole(m2, resolution, count), schema)
    large = tagged.join(sizes.where(F.col("n") > PAIRS_A_TASK).select("g"), "g", "left_semi") if sizes.count() > few else None
    return written(done, "done"), large


def _one_graph(pairs: DataFrame) -> DataFrame:
    """``pairs`` with g, the component; of a graph that a task can hold, all are one."""
    n, least = pairs.agg(F.count("*"), F.min("src")).first()
    if n <= PAIRS_A_TASK:
        return pairs.select("src", "dst", "w", F.lit(least).alias("g"))
    return written(pairs.join(components(pairs).select(F.col("id").alias("src"), F.col("component").alias("g")), "src").select("src", "dst", "w", "g"), "tagged")


def partition(both: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community of the nodes of ``both_ways`` edges: the partition of greatest modularity that is found, connected."""
    loop = F.col("src") == F.col("dst")
    return _partition(both.where("src <= dst").select("src", "dst", F.when(loop, F.expr("w div 2")).otherwise(F.col("w")).alias("w")), resolution)


def _partition(pairs: DataFrame, resolution: float) -> DataFrame:
    done, large = _parted(pairs, resolution, None)
    return done if large is None else done.union(large[1])


def _parted(pairs: DataFrame, resolution: float, count: int | None) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(id, community of the nodes of components of few pairs, cut if there is a ``count``; pairs and id, community of the
    others, if any, not cut)."""
    m2 = 2 * (pairs.agg(F.sum("w")).first()[0] or 0)
    done, large = _split(_one_graph(pairs), m2, resolution, count)
    if large is None:
        return done, None
    both = written(_turned(large.select("src", "dst", "w")), "edges")
    found = connected(both, _leiden(both, written(_nodes(both, m2=m2), "start"), resolution))
    return done, (large.select("src", "dst", "w"), found)


def _cut(pairs: DataFrame, groups: DataFrame, large: DataFrame, resolution: float) -> DataFrame:
    """``groups`` with the communities of ``large`` cut by a run of their own each, all at once."""
    chosen = written(groups.join(large.select("community"), "community", "left_semi").select("id", "community"), "to-cut")
    if chosen.isEmpty():
        return groups
    inner = written(_tagged(pairs, chosen.withColumnRenamed("community", "component")).where("g = h").select("src", "dst", "w", "g"), "inner")
    found, rest = _split(inner, None, resolution)
    if rest is not None:
        both = written(_turned(rest.select("src", "dst", "w")), "inner-edges")
        found = found.union(connected(both, _leiden(both, written(_nodes(both, chosen.withColumnRenamed("community", "g")), "inner-nodes"), resolution)))
    alone = chosen.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("community"))
    return written(groups.join(chosen.select("id"), "id", "left_anti").select("id", "community").union(found).union(alone), "cut")


def _cuts(pairs: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """``groups`` with large communities of ``count`` nodes cut, and after them large sparse ones."""
    sizes = groups.groupBy("community").agg(F.count("*").alias("n"))
    groups = _cut(pairs, groups, sizes.where(F.col("n") > max(LEAST_CUT, int(count * SHARE))), 1.0)
    sparse = graph.cohesion(pairs, groups).where((F.col("n") >= LEAST_SPARSE) & (F.col("cohesion") < LEAST_COHESION))
    return _cut(pairs, groups, sparse, 1.0)


def communities(edges: DataFrame, weight: str | None = None, nodes: DataFrame | None = None, resolution: float = 1.0, hubs_above: float | None = None) -> DataFrame:
    """id, community (its least id) of every node of ``edges`` (src, dst) and of ``nodes`` (id).

    ``resolution``: above 1 for smaller communities. ``hubs_above``: a percentile; nodes of a higher degree (number of
    different neighbours) are left out and join the commonest community of their neighbours afterwards, hubs that only know
    hubs after those. Large communities, and large sparse ones, are cut once more. Nodes without edges stay alone. Null ends
    are no edges; an empty graph has no rows.
    """
    pairs = written(pairs_of(edges.where("src IS NOT NULL AND dst IS NOT NULL"), weight), "pairs")
    every = pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))
    every = written((every if nodes is None else every.union(nodes.select("id").where("id IS NOT NULL"))).distinct(), "nodes")
    count = every.count()
    if not count:
        return every.select("id", F.col("id").alias("community"))
    stay = lambda groups: groups.select("id", "community").union(every.join(groups.select("id"), "id", "left_anti").select("id", F.col("id").alias("community")))
    if hubs_above is None:
        groups, large = _parted(pairs, resolution, count)
        groups = groups if large is None else groups.union(_cuts(*large, count))
        groups = written(stay(groups), "communities")
    else:
        both = written(_turned(pairs), "edges")
        degrees = both.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        counted = sorted(tuple(r) for r in degrees.groupBy("degree").agg(F.count("*")).collect())  # one row a different degree
        bound = _percentile(counted, hubs_above)
        left_out = written(degrees.where(F.col("degree") > bound).select("id"), "hubs")
        gone = lambda c: left_out.select(F.col("id").alias(c))
        used = written(pairs.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst", "w"), "used")
        groups = _cuts(pairs, written(stay(_rejoined(both, _partition(used, resolution), left_out)), "communities"), count)
    named = groups.groupBy("community").agg(F.min("id").alias("first"))
    return groups.join(named, "community").select("id", F.col("first").alias("community"))


def _percentile(counted: list[tuple[int, int]], share: float) -> int:
    """The degree at a percentile of all nodes in order of degree."""
    total = sum(n for _, n in counted)
    place = max(0, int(total * share / 100) - 1)
    for degree, n in counted:
        if place < n:
            return degree
        place -= n
    return 0


def _rejoined(both: DataFrame, groups: DataFrame, hubs: DataFrame) -> DataFrame:
    """Hubs join the commonest community of their placed neighbours, ties to the least, as long as one can."""
    left = hubs
    while not left.isEmpty():
        near = both.where("src <> dst").join(left.select(F.col("id").alias("src")), "src", "left_semi").join(groups.select(F.col("id").alias("dst"), "community"), "dst")
        votes = near.groupBy("src", "community").agg(F.count("*").alias("n")).groupBy(F.col("src").alias("id")).agg(F.min(F.struct(-F.col("n"), "community"))["community"].alias("community"))
        won = written(votes, "rejoined")
        if won.isEmpty():
            break
        groups, left = groups.select("id", "community").union(won), written(left.join(won.select("id"), "id", "left_anti"), "hubs")
    return groups


def modularity(both: DataFrame, groups: DataFrame, resolution: float = 1.0) -> Column | float:
    """Newman's modularity of a partition, from ``both_ways`` edges."""
    m2 = both.agg(F.sum("w")).first()[0]
    inner = _within(both, groups).agg(F.sum("w")).first()[0] or 0
    totals = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).join(groups, "id").groupBy("community").agg(F.sum("k").alias("k"))
    squares = totals.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
    return inner / m2 - resolution * squares / m2 / m2
