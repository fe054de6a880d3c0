"""Communities: modularity against a plain Louvain, connectedness, hubs, cuts and odd graphs."""

import random
from collections import Counter, defaultdict

import pytest

from corvidex.operators import communities as C


def louvain(edges):
    """A plain single-machine Louvain: local moves in order of ids until nothing changes, then the quotient, again."""
    weight, place = defaultdict(float), {}
    for a, b, w in edges:
        weight[a, b] += w
        weight[b, a] += w
    place = {a: a for a, _ in weight}
    m2 = sum(weight.values())
    while True:
        near, k = defaultdict(dict), defaultdict(float)
        for (a, b), w in weight.items():
            near[a][b] = w
            k[a] += w
        group, total, moved, any_moved = {a: a for a in near}, dict(k), True, False
        while moved:
            moved = False
            for a in sorted(near):
                votes = defaultdict(float)
                for b, w in near[a].items():
                    if b != a:
                        votes[group[b]] += w
                total[group[a]] -= k[a]
                best = max([*votes, group[a]], key=lambda c: (votes[c] - k[a] * total[c] / m2, c == group[a], -c))
                total[best] += k[a]
                if best != group[a]:
                    group[a], moved, any_moved = best, True, True
        if not any_moved:
            return place
        place = {x: group[at] for x, at in place.items()}
        grown = defaultdict(float)
        for (a, b), w in weight.items():
            grown[group[a], group[b]] += w
        weight = grown


def modularity(edges, place):
    m2, inner, total = 2 * sum(w for *_, w in edges), 0.0, defaultdict(float)
    for a, b, w in edges:
        inner += 2 * w * (place[a] == place[b])
        total[place[a]] += w
        total[place[b]] += w
    return inner / m2 - sum(t * t for t in total.values()) / m2 / m2


def connected(edges, place):
    near = defaultdict(set)
    for a, b, _ in edges:
        if place[a] == place[b]:
            near[a].add(b)
            near[b].add(a)
    for community in set(place.values()):
        members = {x for x, c in place.items() if c == community}
        todo, seen = [min(members)], {min(members)}
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        if seen != members:
            return False
    return True


def planted(groups, size, inside, outside, seed):
    draw = random.Random(seed)
    edges = [(g * 100 + i, g * 100 + j, draw.randint(1, 4)) for g in range(groups) for i in range(size) for j in range(i) if draw.random() < inside]
    return edges + [(draw.randrange(groups) * 100 + draw.randrange(size), draw.randrange(groups) * 100 + draw.randrange(size), 1) for _ in range(outside)]


def graph(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, w long")


def found(df):
    assert df.columns == ["id", "community"]
    rows = df.collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["community"] for r in rows}


@pytest.mark.parametrize("edges", [planted(8, 15, 0.4, 60, 1), planted(5, 30, 0.15, 120, 2)])
def test_modularity_is_that_of_a_plain_louvain(spark, edges):
    both = C.written(C.both_ways(graph(spark, edges), "w"), "test")
    place = found(C.partition(both))
    assert connected(edges, place)
    assert modularity(edges, place) >= modularity(edges, louvain(edges)) - 0.005
    assert C.modularity(both, spark.createDataFrame(list(place.items()), "id long, community long")) == pytest.approx(modularity(edges, place))


def test_two_cliques_loops_alone_nodes_and_null_ends(spark):
    cliques = [(a, b, 1) for k in (0, 10) for a in range(k, k + 6) for b in range(k, a)]
    edges = graph(spark, [*cliques, (0, 10, 1), (3, 3, 2), (None, 4, 1), (50, 50, 1)])
    nodes = spark.createDataFrame([(7,), (99,), (None,)], "id long")
    place = found(C.communities(edges, "w", nodes))
    assert place == {**{i: 0 for i in range(6)}, **{i: 10 for i in range(10, 16)}, 50: 50, 7: 7, 99: 99}
    assert found(C.communities(edges.where("false"), "w", nodes)) == {7: 7, 99: 99}
    assert found(C.communities(edges.where("false"))) == {}


def test_hubs_join_their_neighbours_afterwards(spark):
    rings = [(k * 10 + i, k * 10 + (i + 1) % 6, 1) for k in range(5) for i in range(6)]
    rings += [(k * 10 + i, k * 10 + (i + 2) % 6, 1) for k in range(5) for i in range(6)]
    hub = [(1000, k * 10 + i, 1) for k in range(5) for i in range(3 + (k == 2) * 3)]
    place = found(C.communities(graph(spark, rings + hub), "w", hubs_above=97))
    assert place[1000] == place[20] and len(Counter(place.values())) == 5
    assert all(place[k * 10 + i] == k * 10 for k in range(5) for i in range(6))


def test_large_communities_are_cut_again(spark):
    # A chain of cliques that one pass at a low resolution leaves together.
    cliques = [(k * 10 + a, k * 10 + b, 1) for k in range(4) for a in range(7) for b in range(a)]
    edges = graph(spark, cliques + [(k * 10, k * 10 + 10, 1) for k in range(3)])
    both = C.written(C.both_ways(edges, "w"), "test")
    assert max(Counter(found(C.partition(both, 0.05)).values()).values()) > 7
    place = found(C.communities(edges, "w", resolution=0.05))
    assert sorted(Counter(place.values()).values()) == [7, 7, 7, 7]
    assert found(C.communities(edges.repartition(3), "w", resolution=0.05)) == place  # the same in each run


def test_few_levels_on_a_graph_without_communities(spark, monkeypatch):
    draw, calls = random.Random(3), []
    edges = [(draw.randrange(40), 100 + draw.randrange(400), 1) for _ in range(3000)]
    moved = C._moved
    monkeypatch.setattr(C, "_moved", lambda *a: calls.append(1) or moved(*a))
    place = found(C.partition(C.written(C.both_ways(graph(spark, edges), "w"), "test")))
    assert connected(edges, place)
    assert modularity(edges, place) >= modularity(edges, louvain(edges)) - 0.005
    assert len(calls) <= 8  # moves and refinements; a level that hardly gains anything is not refined


def test_components_of_few_pairs_are_run_by_tasks(spark, monkeypatch):
    """Sixty copies of a graph that has no communities: no round of Spark, and each copy as good as a plain run."""
    monkeypatch.setattr(C, "PAIRS_A_TASK", 400)
    monkeypatch.setattr(C, "_moved", lambda *a: pytest.fail("a round over all edges"))
    draw = random.Random(4)
    one = [(draw.randrange(20), 20 + draw.randrange(60), 1) for _ in range(300)]
    edges = [(a + 1000 * c, b + 1000 * c, w) for c in range(60) for a, b, w in one]
    edges += [(100_000 + 10 * i, 100_001 + 10 * i, 1) for i in range(3000)]
    place = found(C.communities(graph(spark, edges), "w"))
    assert connected(edges, place) and set(place) == {x for a, b, _ in edges for x in (a, b)}
    assert all(place[100_000 + 10 * i] == place[100_001 + 10 * i] == 100_000 + 10 * i for i in range(3000))
    ends = {c: {x: p for x, p in place.items() if x // 1000 == c} for c in range(60)}
    assert all(p // 1000 == c for c, inside in ends.items() for p in inside.values())
    # Each copy is cohesive enough to stay whole at the modularity of the whole graph.
    assert modularity(edges, place) >= modularity(edges, louvain(edges)) - 0.005


@pytest.mark.parametrize("pairs", [300, 1_000_000])
def test_large_components_beside_small_ones(spark, monkeypatch, pairs):
    monkeypatch.setattr(C, "PAIRS_A_TASK", pairs)
    large = planted(6, 20, 0.3, 40, 5)
    edges = large + [(a + 10_000, b + 10_000, w) for a, b, w in planted(2, 12, 0.5, 6, 6)] + [(90_000, 90_000, 3)]
    both = C.written(C.both_ways(graph(spark, edges), "w"), "test")
    place = found(C.partition(both))
    assert connected(edges, place) and set(place) == {x for a, b, _ in edges for x in (a, b)}
    assert modularity(edges, place) >= modularity(edges, louvain(edges)) - 0.005
    whole = found(C.communities(graph(spark, edges), "w"))
    assert connected(edges, whole) and set(whole) == set(place)
    assert all(c == min(x for x, o in whole.items() if o == c) for c in set(whole.values()))


def test_names_as_ids(spark):
    edges = planted(4, 10, 0.6, 10, 7)
    named = [(f"n{a}", f"n{b}", w) for a, b, w in edges]
    place = found(C.communities(spark.createDataFrame(named, "src string, dst string, w long"), "w"))
    assert connected(named, place) and modularity(named, place) >= modularity(edges, louvain(edges)) - 0.005


@pytest.mark.parametrize("seed", range(3))
def test_components_of_stars_and_crossing_pairs(spark, seed):
    draw = random.Random(seed)
    pairs = [(a, b) for a, b in ((draw.randrange(300), draw.randrange(300)) for _ in range(200)) if a <= b] + [(i, i + 1) for i in range(400, 450)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert set(got) == set(root) and len({(got[x], top(x)) for x in root}) == len(set(got.values())) == len({top(x) for x in root})


def test_levels_that_fit_a_task_take_no_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIRS_A_TASK", 300)
    edges, calls, moved = planted(6, 20, 0.3, 40, 5), [], C._moved
    monkeypatch.setattr(C, "_moved", lambda *a: calls.append(1) or moved(*a))
    place = found(C.partition(C.written(C.both_ways(graph(spark, edges), "w"), "test")))
    assert connected(edges, place) and modularity(edges, place) >= modularity(edges, louvain(edges)) - 0.005
    assert len(calls) == 2  # moves and refinement of the first level
