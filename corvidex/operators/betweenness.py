"""Edge betweenness by Brandes' two phases, as joins for a block of sources at a time.

Forward, a step a level: a node's number of shortest paths from a source is the sum of those of its neighbours one level
above. Backward, from the deepest level on: a node hands each of those neighbours its share of (1 + what depends on it), and
that share is what the edge between them carries. All sources of a block go together; each level is one written table, so
that a step reads its own level, the one before and the edges, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.operators.graph import undirected
from corvidex.sources.tables import written

#: (source, node) pairs that one block may hold.
PAIRS = 200_000_000


def edge_betweenness(edges: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """a < b, betweenness: the sum over all pairs of nodes of the share of their shortest paths that go through an edge, over
    the number of pairs. Edges count once in either direction, loops don't; a graph without edges has no rows."""
    both = written(undirected(edges.where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL")), "edges")
    nodes = written(both.select(F.col("src").alias("id")).distinct(), "nodes")
    n = nodes.count()
    if n < 2:
        return both.limit(0).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("betweenness"))
    blocks = -(-n * n // pairs)
    found = None
    for k in range(blocks):
        part = _block(both, nodes.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k))
        found = part if found is None else written(found.union(part).groupBy("a", "b").agg(F.sum("carried").alias("carried")), "carried")
    return found.select("a", "b", (F.col("carried") / (n * (n - 1))).alias("betweenness"))


def _block(both: DataFrame, sources: DataFrame) -> DataFrame:
    """a < b, carried: the sum of what an edge carries from each of ``sources``."""
    levels = [written(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("source", "id")
    while not levels[-1].isEmpty():
        new = levels[-1].join(both.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        levels.append(written(new.join(seen, ["source", "id"], "left_anti"), "level"))
        # What lies one level up or on the same level is all that a step can meet again.
        seen = levels[-1].select("source", "id").union(levels[-2].select("source", "id"))
    below, carried = None, None
    for d in range(len(levels) - 2, 0, -1):
        here = levels[d] if below is None else levels[d].join(below, ["source", "id"], "left")
        here = here.select("source", F.col("id").alias("src"), ((1 + (F.lit(0.0) if below is None else F.coalesce("depends", F.lit(0.0)))) / F.col("paths")).alias("each"))
        up = here.join(both, "src").join(levels[d - 1].withColumnRenamed("id", "dst"), ["source", "dst"])
        step = written(up.select("source", F.col("dst").alias("id"), "src", (F.col("each") * F.col("paths")).alias("share")), "shares")
        below = written(step.groupBy("source", "id").agg(F.sum("share").alias("depends")), "depends")
        part = step.groupBy(F.least("id", "src").alias("a"), F.greatest("id", "src").alias("b")).agg(F.sum("share").alias("carried"))
        carried = part if carried is None else carried.union(part)
    return written(carried.groupBy("a", "b").agg(F.sum("carried").alias("carried")), "carried")
