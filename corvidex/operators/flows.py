"""What an entry point reaches, step by step, for all entries at once.

Each frontier row carries the path key of its node: the numbers of the edges that led to it. Keys of a level sort like the
walk that visits nodes in the order in which they were met, so that steps get their order without walking one entry after
the other. A node is walked through once for each entry, from its least key; what was visited cuts cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.sources.tables import written

#: Fixed value: levels that are walked; beyond them a flow would be a guess.
HOPS = 2


def flows(entries: DataFrame, edges: DataFrame, through: DataFrame, hops: int = HOPS) -> DataFrame:
    """entry, position (from 1), level, src, dst, rule of the steps of each entry, in order.

    entries: entry, node. edges: src, dst, rule, rank (order among the edges of a src; ties by dst and rule). through: id of
    the nodes that a walk goes on from. Of several edges between two nodes the first one is a step. Null ends are no edges;
    a repeated entry row is one entry; an entry without edges has no rows. The steps of one entry are numbered in one task:
    they are bounded by what lies within ``hops`` of its node.
    """
    order = Window.partitionBy("src").orderBy("rank", "dst", "rule")
    first = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min(F.struct("rank", "rule")).alias("e")).select("src", "dst", "e.rank", "e.rule")
    steps = written(first.withColumn("number", F.row_number().over(order)), "flow-edges")
    walked = through.select(F.col("id").alias("node")).where("node IS NOT NULL").distinct()
    now = written(entries.select("entry", "node").where("node IS NOT NULL").distinct().withColumn("key", F.array().cast("array<int>")), "flow")
    visited, out = now.select("entry", "node"), None
    for level in range(hops):
        reached = written(now.join(steps, F.col("node") == F.col("src")).select("entry", F.concat("key", F.array("number")).alias("key"), "src", "dst", "rule"), "flow")
        part = reached.select("entry", F.lit(level).alias("level"), "key", "src", "dst", "rule")
        out = part if out is None else out.union(part)
        if level == hops - 1:
            break
        met = reached.groupBy("entry", F.col("dst").alias("node")).agg(F.min("key").alias("key"))
        now = written(met.join(walked, "node", "left_semi").join(visited, ["entry", "node"], "left_anti").select("entry", "node", "key"), "flow")
        if now.isEmpty():
            break
        visited = visited.union(now.select("entry", "node"))
    place = F.row_number().over(Window.partitionBy("entry").orderBy("level", "key"))
    return out.select("entry", place.alias("position"), "level", "src", "dst", "rule")
