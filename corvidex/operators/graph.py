"""Graph operators over edges(src, dst, ...): bounded frontier loops, components, propagation, quotients.

Loops cut their lineage with checkpoints in spark.checkpoint.dir; the driver only sees counts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.sources.tables import checkpointed, dealt, written

#: Of label propagation: no graph has needed so many rounds; only labels that swing with a longer period get there.
MOST_ROUNDS = 200


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, top: int) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "id").limit(top)


def frontier(edges: DataFrame, seeds: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """id, depth of first visit, within ``depth`` steps, or of all that can be reached. ``seeds``: id. ``reverse``: against
    the edges. The edges are written once, so that a step reads two narrow columns and not what they come from."""
    step = edges.select(F.col("dst" if reverse else "src").alias("id"), F.col("src" if reverse else "dst").alias("to"))
    step = step if depth == 1 else written(step, "steps")
    now = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = now
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        new = now.join(step, "id").select(F.col("to").alias("id")).join(seen.select("id"), "id", "left_anti").distinct().withColumn("depth", F.lit(d))
        now = written(new, "frontier")  # the new nodes alone; what was seen is the union of what was written before
        if now.isEmpty():
            break
        seen = seen.union(now)
    return seen


def shortest_path(edges: DataFrame, a, b, most: int | None = None) -> DataFrame:
    """step, id of one shortest path between two ids, edges in either direction; empty if there is none (within ``most``
    steps, if given).

    Each visited node keeps its least predecessor; the path is then walked back, a join a step.
    """
    both = undirected(edges)
    spark = edges.sparkSession
    seen = spark.createDataFrame([(a, 0)], f"id {edges.schema['src'].dataType.simpleString()}, depth int").withColumn("prev", F.col("id"))
    now = seen
    for d in itertools.count(1) if most is None else range(1, most + 1):
        new = now.join(both, now["id"] == both["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("prev")).join(seen.select("id"), "id", "left_anti")
        now = checkpointed(new.select("id", F.lit(d).alias("depth"), "prev"))
        if now.isEmpty():
            break
        seen = checkpointed(seen.select("id", "depth", "prev").union(now))
        if not now.where(F.col("id") == F.lit(b)).isEmpty():
            break
    at = seen.where(F.col("id") == F.lit(b))
    path = at
    while True:
        at = checkpointed(at.where("depth > 0").select(F.col("prev").alias("id")).join(seen, "id").select("id", "depth", "prev"))
        if at.isEmpty():
            break
        path = path.union(at)
    return path.select(F.col("depth").alias("step"), "id")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least id), by large-star and small-star steps."""
    stars, held = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = checkpointed(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == held:
            break
        held = now
    named = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    alone = edges.where("src = dst").select(F.col("src").alias("id"))
    roots = stars.select(F.col("b").alias("id")).union(alone).distinct().join(named.select("id"), "id", "left_anti")
    return named.union(roots.select("id", F.col("id").alias("component")))


def label_propagation(edges: DataFrame, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """id, label by synchronous rounds: the label with the greatest sum of ``weight`` among neighbours, ties to the greater
    one; with a sum of one, the greater of it and the node's own. Without ``weight`` each different pair counts once; with
    it, edges of a pair add up in either direction.

    Without ``rounds`` it goes on until nothing changes. Labels may swing for ever; as a round depends on the labels alone,
    it stops as soon as they are what they were after any earlier round, with these. ``MOST_ROUNDS`` bounds longer swings.
    """
    ends = written(edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")), "ends")
    turned = ends.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = written(dealt(ends.union(turned), 2 * ends.count(), "src", "dst").groupBy("src", "dst").agg((F.sum("n") if weight else F.lit(1).cast("long")).alias("n")), "edges")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    rows, seen = both.count(), set()
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        near = dealt(both, rows, "dst").join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", "n")
        votes = dealt(near, rows, "id").groupBy("id", "label").agg(F.sum("n").alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", "label")).alias("m"))
        labels = written(labels.join(best, "id").select("id", F.when(F.col("m.n") > 1, F.col("m.label")).otherwise(F.greatest("m.label", "label")).alias("label")), "labels")
        if rounds is None:
            now = tuple(labels.agg(*[F.sum(F.xxhash64(F.lit(s), "id", "label").cast("decimal(38,0)")) for s in (1, 2)]).first())
            if now in seen:
                break
            seen.add(now)
    return labels


def layers(edges: DataFrame) -> DataFrame:
    """id, layer of a DAG: 0 without successors, else one above the highest successor. A chain has no more layers than the
    graph has nodes; more rounds than that are a cycle, which is an error."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    now, held = checkpointed(ids.withColumn("layer", F.lit(0))), None
    for _ in range(ids.count() + 1):
        above = edges.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("layer") + 1).alias("up"))
        now = checkpointed(now.join(above, "id", "left").select("id", F.coalesce("up", F.lit(0)).alias("layer")))
        total = now.agg(F.sum("layer")).first()
        if total == held:
            return now
        held = total
    raise ValueError("a cycle")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component of strongly connected nodes, by colouring: the greatest id that reaches a node, then back from it."""
    live, done = checkpointed(edges.select("src", "dst").distinct()), None
    ids = checkpointed(live.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    while not ids.isEmpty():
        colour, total = ids.withColumn("colour", F.col("id")), None
        while True:
            up = live.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c"))
            colour = checkpointed(colour.join(up, "id", "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour")))
            now = colour.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()
            if now == total:
                break
            total = now
        same = live.join(colour.withColumnRenamed("id", "src"), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2")
        found = checkpointed(colour.where("id = colour"))
        grown = found
        while not grown.isEmpty():
            back = same.join(grown.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            grown = checkpointed(back.join(found.select("id"), "id", "left_anti"))
            found = checkpointed(found.union(grown))
        part = found.select("id", F.col("colour").alias("component"))
        done = part if done is None else checkpointed(done.union(part))
        ids = checkpointed(ids.join(found.select("id"), "id", "left_anti"))
        live = checkpointed(live.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return done if done is not None else ids.withColumn("component", F.col("id"))


def cycles(edges: DataFrame, most: int = 5) -> DataFrame:
    """Simple cycles of up to ``most`` nodes as arrays that begin with their least id."""
    step = edges.where("src <> dst").select("src", "dst").distinct()
    paths, found = step.where("dst > src").select(F.array("src", "dst").alias("path")), None
    back = step.select(F.col("src").alias("__last"), F.col("dst").alias("__next"))
    for k in range(2, most + 1):
        grown = paths.withColumn("__last", F.get("path", F.size("path") - 1)).join(back, "__last")
        closed = grown.where(F.col("__next") == F.get("path", F.lit(0))).select("path")
        found = closed if found is None else found.union(closed)
        if k < most:
            paths = grown.where((F.col("__next") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("__next"))).select(F.concat("path", F.array("__next")).alias("path"))
    return found.distinct()


def quotient(edges: DataFrame, groups: DataFrame, least: int = 1) -> DataFrame:
    """a < b, weight: edges between different groups. ``groups``: id, community."""
    g = groups.select("id", "community")
    both = edges.join(g.select(F.col("id").alias("src"), F.col("community").alias("x")), "src").join(g.select(F.col("id").alias("dst"), F.col("community").alias("y")), "dst").where("x <> y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """community, n, share of possible inner edges; loops don't count, a single node has 1."""
    g = groups.select("id", "community")
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inner = pairs.join(g.select(F.col("id").alias("src"), "community"), "src").join(g.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").where("community = c2").groupBy("community").agg(F.count("*").alias("e"))
    n = g.groupBy("community").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    return n.join(inner, "community", "left").select("community", "n", F.round(share, 6).alias("cohesion"))


def signatures(groups: DataFrame) -> DataFrame:
    """community and a digest of its members that doesn't depend on their order; one hash a member is added up."""
    return groups.groupBy("community").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("signature"))


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def mint_stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that edges name and ``nodes`` lack."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def resolve(nodes: DataFrame, label: str, limit: int = 5) -> DataFrame:
    """Nodes by the first tier that has any: equal id, equal label, prefix, inside. nodes: id, label."""
    low, want = F.lower("label"), label.lower()
    tier = F.when(F.col("id").cast("string") == label, 0).when(low == want, 1).when(low.startswith(want), 2).when(low.contains(want), 3)
    hit = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hit.agg(F.min("tier").alias("tier"))
    return hit.join(F.broadcast(best), "tier").select("id", "label", "tier").orderBy("id").limit(limit)


def surprise(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """src, dst, score: 1 for each end of low degree that meets a hub, 1 across communities, by degree and community."""
    d = degree(edges)
    g = groups.select("id", "community")
    both = edges.select("src", "dst").distinct()
    for end in ("src", "dst"):
        both = both.join(d.select(F.col("id").alias(end), F.col("degree").alias(f"d_{end}")), end).join(g.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}")), end)
    low, high = F.least("d_src", "d_dst"), F.greatest("d_src", "d_dst")
    return both.select("src", "dst", (F.when(F.col("c_src") != F.col("c_dst"), 1).otherwise(0) + F.when((low <= 2) & (high >= 5), 1).otherwise(0)).alias("score"))


#: Relations that say where a thing is and not what it needs.
STRUCTURE = ("contains", "method", "defines")


def members(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth of everything inside ``seeds``: a walk along the structural relations, to their end or ``most`` levels deep."""
    return frontier(edges.where(F.col("rel").isin(*STRUCTURE)), seeds, most)


def dependents(edges: DataFrame, seeds: DataFrame, depth: int, relations: list[str] | None = None) -> DataFrame:
    """id, depth of what breaks if ``seeds`` or their members change: against the edges, structural ones left out, or along
    ``relations`` only; the start itself isn't shown."""
    start = members(edges, seeds).select("id")
    used = edges.where(F.col("rel").isin(*relations) if relations else ~F.col("rel").isin(*STRUCTURE))
    return frontier(used, start, depth, reverse=True).where("depth > 0")


def hub_bound(edges: DataFrame, least: int = 50, share: float = 0.99) -> int:
    """The degree from which a node counts as a hub: that at ``share`` of all nodes in order of degree, ``least`` at least.
    Exact, over a count of nodes for each degree, of which there are few."""
    counts = sorted(tuple(r) for r in degree(edges.where("src <> dst")).groupBy("degree").agg(F.count("*").alias("n")).collect())
    total, at = sum(n for _, n in counts), 0
    for d, n in counts:
        at += n
        if at > int(total * share):
            return max(least, d)
    return least


def around_seeds(edges: DataFrame, seeds: DataFrame, depth: int, contexts: list[str] | None = None, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, depth; edges among them) within ``depth`` steps in either direction. Hubs are reached but not walked
    through, unless they are seeds. ``contexts``: only edges whose ``context`` is one of them."""
    used = edges.where(F.col("context").isin(*contexts)) if contexts else edges
    both = undirected(used.where("src <> dst"))
    bound = hub_bound(used, least)
    big = degree(used.where("src <> dst")).where(F.col("degree") >= bound).select(F.col("id").alias("src")).join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
    nodes = frontier(both.join(big, "src", "left_anti"), seeds, depth)
    ids = nodes.select("id")
    inside = used.where("src <> dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside


def focus(edges: DataFrame, centre, most: int, depth: int = 2) -> DataFrame:
    """id, depth of the neighbourhood of one node, nearest first, those of high degree first, at most ``most``."""
    seeds = edges.sparkSession.createDataFrame([(centre,)], f"id {edges.schema['src'].dataType.simpleString()}")
    near = frontier(undirected(edges), seeds, depth)
    return near.join(degree(edges), "id").orderBy("depth", F.desc("degree"), "id").limit(most).select("id", "depth", "degree")


def facts_near(facts: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """The facts (src, dst, ...) within ``depth`` hops of ``origins`` (id), along the facts in either direction."""
    near = frontier(undirected(facts), origins, depth - 1).select("id")
    hit = facts.join(near.select(F.col("id").alias("src")), "src", "left_semi").union(facts.join(near.select(F.col("id").alias("dst")), "dst", "left_semi").select(*facts.columns))
    return hit.distinct()


def condensed_layers(edges: DataFrame) -> DataFrame:
    """id, layer of any graph: strongly connected nodes are one; 0 without successors outside, else one above the highest."""
    parts = strong_components(edges)
    c = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    between = edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()
    if between.isEmpty():
        return parts.select("id", F.lit(0).alias("layer"))
    placed = layers(between)
    return parts.join(placed.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def areas(groups: DataFrame, degrees: DataFrame, labels: DataFrame, best: int = 5) -> DataFrame:
    """community, name (its member of highest degree), size and the labels of its ``best`` members by degree. groups: id,
    community; degrees: id, degree; labels: id, label. A large community is cut to ``best`` rows a task before they meet."""
    every = groups.join(degrees, "id", "left").join(labels, "id").withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    first = every.withColumn("k", F.row_number().over(place)).where(F.col("k") <= best)
    top = first.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]).alias("top"))
    return every.groupBy("community").agg(F.count("*").alias("size")).join(top, "community").select("community", F.get("top", F.lit(0)).alias("name"), "size", "top")


def remap(now: DataFrame, before: DataFrame) -> DataFrame:
    """community, previous: which earlier community each one carries on, one to one by the largest overlap first.

    Overlaps are counted in one join. In each round the pairs that are the best of both their sides are settled, ties by the
    lesser ids; as the greatest overlap left always is, this gives what a greedy walk in descending order gives.
    """
    counted = now.join(before.select("id", F.col("community").alias("previous")), "id").groupBy("community", "previous").agg(F.count("*").alias("n"))
    left, done = written(counted, "overlaps"), None
    while not left.isEmpty():
        rank = F.struct(F.col("n"), -F.col("community"), -F.col("previous"))
        a = left.groupBy("community").agg(F.max(rank).alias("a"))
        b = left.groupBy("previous").agg(F.max(rank).alias("b"))
        won = written(left.join(a, "community").join(b, "previous").where((rank == F.col("a")) & (rank == F.col("b"))).select("community", "previous", "n"), "settled")
        done = won if done is None else done.union(won)
        left = written(left.join(won.select("community"), "community", "left_anti").join(won.select("previous"), "previous", "left_anti"), "overlaps")
    return done if done is not None else left


def impact_of(files: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: how many nodes and communities changed ``files`` (path) touch. nodes: id, path; groups: id, community."""
    hit = nodes.join(files.select("path").distinct(), "path", "left_semi").join(groups, "id", "left")
    return hit.agg(F.count_distinct("id").alias("nodes"), F.count_distinct("community").alias("communities"))


def folders(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, weight between folders: ids are paths, cut to their first ``depth`` parts; edges within one don't count."""
    cut = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, depth), "/")
    return edges.select(cut("src").alias("src"), cut("dst").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate_by_group(edges: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """group, id, label: label propagation for each group on its own, all in one run: ids carry their group."""
    key = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("v"))
    named = edges.select(key("src").alias("src"), key("dst").alias("dst"), *([F.col(weight)] if weight else []))
    out = label_propagation(named, weight=weight)
    return out.select(F.col("id.g").alias(group), F.col("id.v").alias("id"), F.col("label.v").alias("label"))


def community_of_new(new: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """id, community for new entities: the one that it has, else the commonest among its neighbours, ties to the least.
    edges: id (new), to. Votes are counted before they are compared."""
    votes = edges.join(groups.select(F.col("id").alias("to"), "community"), "to").groupBy("id", "community").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("community"))).alias("b")).select("id", (-F.col("b.col2")).alias("near"))
    own = groups.select("id", F.col("community").alias("own"))
    return new.select("id").distinct().join(own, "id", "left").join(best, "id", "left").select("id", F.coalesce("own", "near").alias("community"))


def chain_by_time(rows: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """group, key, previous: each episode of a chain with the one before it by time."""
    return rows.select(group, key, F.lag(key).over(Window.partitionBy(group).orderBy(ts, key)).alias("previous"))


def namespaced(graphs: dict[str, DataFrame], held: DataFrame | None = None) -> DataFrame:
    """Edges of several repositories as one graph with ids repo::id; a repository that is added again replaces its edges in
    ``held`` (repo, src, dst)."""
    out = None if held is None else held.where(~F.col("repo").isin(*graphs))
    for repo, edges in graphs.items():
        named = edges.select(F.lit(repo).alias("repo"), F.concat(F.lit(f"{repo}::"), F.col("src").cast("string")).alias("src"), F.concat(F.lit(f"{repo}::"), F.col("dst").cast("string")).alias("dst"))
        out = named if out is None else out.unionByName(named)
    return out


def collapsed_view(edges: DataFrame, ranks: DataFrame, most: int, other: str) -> DataFrame:
    """src, dst, weight of a view with the first ``most`` elements (id, rank: the higher the better) as they are and all
    others as one, ``other``; what lies within one element isn't shown."""
    shown = ranks.orderBy(F.desc("rank"), "id").limit(most).select("id", F.lit(True).alias("shown"))
    at = lambda end: shown.select(F.col("id").alias(end), F.col("shown").alias(f"s_{end}"))
    placed = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    end = lambda c: F.when(F.col(f"s_{c}"), F.col(c)).otherwise(F.lit(other))
    return placed.select(end("src").alias("src"), end("dst").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def scoped_symbol(nodes: DataFrame, target: str, limit: int = 5) -> DataFrame:
    """Nodes (id, label, path) for path::symbol: the path ends in the given one, by whole parts; an equal label before one
    that holds the symbol."""
    path, _, symbol = target.partition("::")
    low, want = F.lower("label"), symbol.lower()
    fits = (F.col("path") == path) | F.col("path").endswith("/" + path)
    tier = F.when(low == want, 0).when(low.contains(want), 1)
    return nodes.where(fits).withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "id").limit(limit).select("id", "tier")


def surprise_full(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, relation, score of edges (src, dst, relation, confidence) by how little they are to be expected. nodes: id,
    category, folder, family, community.

    3, 2 or 1 for ambiguous, inferred or extracted; 2 across kinds of files, 2 across top folders, 1 across communities; one
    and a half times that for likeness of meaning; 1 more where an end of at most two edges meets one of five or more. An
    inferred call across languages, or between code and a document, gets nothing for these but the last.
    """
    d = degree(edges)
    both = edges
    for end in ("src", "dst"):
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("category", "folder", "family", "community")])
        both = both.join(side, end).join(d.select(F.col("id").alias(end), F.col("degree").alias(f"d_{end}")), end)
    other = lambda c: F.col(f"{c}_src") != F.col(f"{c}_dst")
    papers = other("category") & F.col("category_src").isin("code", "document") & F.col("category_dst").isin("code", "document")
    noise = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & ((other("family") & (F.col("family_src") != "other") & (F.col("family_dst") != "other")) | papers)
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    score = F.when(noise, 0).otherwise(base + F.when(other("category"), 2).otherwise(0) + F.when(other("folder"), 2).otherwise(0) + F.when(other("community"), 1).otherwise(0))
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    edge = F.when((F.least("d_src", "d_dst") <= 2) & (F.greatest("d_src", "d_dst") >= 5), 1).otherwise(0)
    return both.select("src", "dst", "relation", (score + edge).cast("long").alias("score"))


def open_questions(nodes: DataFrame, edges: DataFrame, groups: DataFrame, top: int = 5) -> DataFrame:
    """kind, id of what a graph leaves open: ambiguous edges (src), nodes that join most communities (bridge), and nodes with
    no edge or one (isolated), at most ``top`` each."""
    doubtful = edges.where("confidence = 'AMBIGUOUS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(top)
    # Repeated edges change no number of different communities, so that they needn't be made different first.
    rows = 2 * edges.count()
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = dealt(both, rows, "dst").join(groups.select(F.col("id").alias("dst"), "community"), "dst").select(F.col("src").alias("id"), "community")
    other = dealt(near, rows, "id").distinct().groupBy("id").agg(F.count("community").alias("n")).where("n > 1").orderBy(F.desc("n"), "id").limit(top)
    lone = nodes.select("id").join(degree(edges), "id", "left").where("coalesce(degree, 0) <= 1").orderBy("id").limit(top)
    return doubtful.select(F.lit("ambiguous").alias("kind"), "id").union(other.select(F.lit("bridge"), "id")).union(lone.select(F.lit("isolated"), "id"))
