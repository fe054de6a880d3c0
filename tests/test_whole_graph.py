"""Graph queries over all part-supplier edges, against plain loops."""

from collections import Counter, defaultdict

from corvidex.operators import graph
from corvidex.plans import QUERIES


def spread(weighted):
    """The reference's loop; a state that comes back ends it."""
    near = defaultdict(Counter)
    for a, b, n in weighted:
        near[a][b] += n
        if a != b:
            near[b][a] += n
    labels, seen = {x: x for x in near}, set()
    while True:
        new = {}
        for x, others in near.items():
            votes = Counter()
            for y, n in others.items():
                votes[labels[y]] += n
            n, label = max((n, label) for label, n in votes.items())
            new[x] = label if n > 1 else max(label, labels[x])
        labels = new
        state = tuple(sorted(labels.items()))
        if state in seen:
            return labels
        seen.add(state)


def rows(df):
    return {r["id"]: r["label"] for r in df.collect()}


def test_votes_count_edges(spark):
    weighted = [(1, 9, 1), (1, 8, 1), (1, 2, 5), (2, 3, 4), (3, 4, 2), (8, 9, 3)]
    e = spark.createDataFrame(weighted, "src long, dst long, n long")
    assert rows(graph.label_propagation(e, 1, "n"))[1] == 2 and rows(graph.label_propagation(e, 1))[1] == 9


def test_rounds_go_on_until_nothing_changes(spark):
    # Along a path of single edges the greatest label needs as many rounds as there are steps.
    weighted = [(i, i + 1, 1) for i in range(1, 7)]
    e = spark.createDataFrame(weighted, "src long, dst long, n long")
    got = rows(graph.label_propagation(e, weight="n"))
    assert got == spread(weighted) and got != rows(graph.label_propagation(e, 2, "n"))


def test_swinging_labels_end(spark):
    weighted = [(1, 2, 2)]
    e = spark.createDataFrame(weighted, "src long, dst long, n long")
    assert rows(graph.label_propagation(e, weight="n")) == spread(weighted)


def lines(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey", "1000000 + l_partkey").collect()]


def test_whole_propagation_matches_a_plain_loop(spark, sf):
    counts = Counter(lines(spark, sf))
    assert rows(QUERIES["label_propagation_whole"](spark, sf)) == spread([(a, b, n) for (a, b), n in counts.items()])


def test_components_have_every_supplier_and_part_of_lineitem(spark, sf):
    got = {r["id"] for r in QUERIES["connected_components"](spark, sf).collect()}
    assert got == {x for pair in lines(spark, sf) for x in pair}
