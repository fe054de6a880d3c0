"""Counts, catalogues, filters and orders of fixed shapes, over rows of sessions, tool uses and observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import text as X


def tool_totals(rows: DataFrame, tool: str, output: str, limit: int) -> DataFrame:
    return rows.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.sum(F.length(output)).cast("long").alias("bytes")).orderBy(F.desc("bytes"), "tool").limit(limit)


def catalogue(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, values (different, sorted), n. Counted by value first, so that a set is gathered from one row each."""
    each = rows.groupBy(group, value).agg(F.count("*").alias("k"))
    return each.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("values"), F.sum("k").alias("n"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column) != "").select(column).distinct().orderBy(column)


def corpus_stats(rows: DataFrame, kind: str, ts: str, tokens: str) -> DataFrame:
    """By kind, and over all as kind ``all``: one scan, grouping sets."""
    counted = rows.rollup(kind).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(tokens).cast("long").alias("tokens"), F.grouping(kind).alias("__all"))
    return counted.withColumn(kind, F.when(F.col("__all") == 1, "all").otherwise(F.col(kind))).drop("__all")


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, values: the different values in the order of their first row."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("o"))
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def histogram(rows: DataFrame, column: str, limit: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def best_of(rows: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """Of each key the item of the greatest score, ties to the greatest item."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(score, item)).alias("b"))
    return best.select(*keys, f"b.{item}", f"b.{score}")


def overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the count of each table: the counts are one row each before they are put side by side."""
    counts = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def recent_with_flag(rows: DataFrame, session: str, ts: str, flag: Column, limit: int) -> DataFrame:
    """The last ``limit`` sessions by their last row, shown oldest first, with whether any row has the flag."""
    each = rows.groupBy(session).agg(F.max(ts).alias("last_ts"), F.bool_or(flag).alias("flag"))
    return each.orderBy(F.desc("last_ts"), session).limit(limit).orderBy("last_ts", session)


def latest_with_words(rows: DataFrame, target: str, order: str, tie: str, text: str, words: Sequence[str], limit: int) -> DataFrame:
    """The last row of each target, the newest ``limit`` of them, and of these those that share a word."""
    last = rows.groupBy(target).agg(F.max(F.struct(order, tie, text)).alias("r")).select(target, f"r.{order}", f"r.{text}")
    return last.orderBy(F.desc(order), target).limit(limit).where(F.arrays_overlap(X.words(F.col(text)), F.array(*[F.lit(w) for w in words])))


def session_filter(rows: DataFrame, types=None, concepts=None, platform=None, files=None, since=None, until=None) -> DataFrame:
    """Optional conditions, each (column, value...): one of several types; any of several concepts in an array; a platform
    with what stands for an empty one; a part of any path in an array; bounds of a time, both included."""
    if types:
        rows = rows.where(F.col(types[0]).isin(*types[1]))
    if concepts:
        rows = rows.where(F.coalesce(F.arrays_overlap(F.col(concepts[0]), F.array(*[F.lit(x) for x in concepts[1]])), F.lit(False)))
    if platform:
        column, value, default = platform
        rows = rows.where(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)) == value)
    if files:
        column, parts = files
        rows = rows.where(F.exists(column, lambda path: F.greatest(*[path.contains(p) for p in parts], F.lit(False))))
    for bound, below in ((since, False), (until, True)):
        if bound:
            rows = rows.where(F.col(bound[0]) <= bound[1] if below else F.col(bound[0]) >= bound[1])
    return rows


def tool_filter(rows: DataFrame, equal: Mapping | None = None, among: Mapping | None = None, since=None, before=None, holds: Mapping | None = None) -> DataFrame:
    """Optional conditions on tool uses; plain comparisons, which reach the scan."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (among or {}).items():
        rows = rows.where(F.col(c).isin(*v))
    if since:
        rows = rows.where(F.col(since[0]) >= F.lit(since[1]).cast(rows.schema[since[0]].dataType))
    if before:
        rows = rows.where(F.col(before[0]) < F.lit(before[1]).cast(rows.schema[before[0]].dataType))
    for c, v in (holds or {}).items():
        rows = rows.where(F.col(c).contains(v))
    return rows


def reduction(corpus: DataFrame, answers: DataFrame, text: str) -> DataFrame:
    """ratio: a corpus' tokens over the mean of an answer's; two single rows."""
    whole = corpus.agg((F.sum(F.length(text)) / 4).alias("tokens")).withColumn("one", F.lit(1))
    mean = answers.agg(F.avg(X.tokens(F.col(text))).alias("mean")).withColumn("one", F.lit(1))
    return whole.join(mean, "one").select((F.col("tokens") / F.col("mean")).alias("ratio"))


def ordered(rows: DataFrame, mode: str, relevance: str, ts: str, key: str) -> DataFrame:
    """By relevance, date_asc or date_desc; ties by key."""
    first = {"relevance": F.desc(relevance), "date_asc": F.asc(ts), "date_desc": F.desc(ts)}[mode]
    return rows.orderBy(first, key)


def fetch(rows: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of given ids with their place in the list, as often as the list has them."""
    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame([(list(ids),)], f"ids array<{kind}>").select(F.posexplode("ids").alias("place", key))
    return wanted.join(rows, key).select(F.col("place").cast("long").alias("place"), *rows.columns).orderBy("place")


def numbered(groups: DataFrame) -> DataFrame:
    """number (from 0, the largest first), community, size: ties by the ids, compared in order. The window is over one row a
    community, which holds its ids: for communities whose members a row can hold."""
    each = groups.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))
    order = Window.orderBy(F.desc("size"), "members")
    return each.select((F.row_number().over(order) - 1).cast("long").alias("number"), "community", "size")


def budget(rows: DataFrame, ts: str, key: str, cost: str, last: int) -> DataFrame:
    """One row: calls and cost of the last 24 hours before the newest row, and the mean cost of the newest ``last`` rows."""
    newest = rows.agg(F.max(ts).alias("m"))
    day = rows.join(F.broadcast(newest)).where(F.col(ts) >= F.col("m") - F.expr("INTERVAL 1 DAY")).agg(F.count("*").alias("last_day"), F.sum(cost).alias("spent"))  # one row
    mean = rows.orderBy(F.desc(ts), F.desc(key)).limit(last).agg(F.avg(cost).alias("mean_of_last"))
    return day.withColumn("one", F.lit(1)).join(mean.withColumn("one", F.lit(1)), "one").drop("one")


def best_seeds(rows: DataFrame, key: str, label: str, terms: Sequence[str], degree: str) -> DataFrame:
    """The best row for each term: it has it in its label; of highest degree, then the shortest label, then the least key."""
    low = F.lower(F.col(label))
    hits = rows.select(key, label, degree, F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))).alias("term"))
    rank = F.struct(-F.col(degree), F.length(label), F.col(key))
    return hits.groupBy("term").agg(F.min_by(key, rank).alias(key))


def pick_seeds(scored: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """At most ``most`` rows (id, score, label) with different labels, none below ``gap`` of the best."""
    one = scored.groupBy("label").agg(F.max(F.struct(F.col("score"), -F.col("id"))).alias("b")).select("label", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("id"))
    first = one.orderBy(F.desc("score"), "id").limit(most)
    top = F.max("score").over(Window.partitionBy())  # over three rows at most
    return first.withColumn("__top", top).where(F.col("score") >= gap * F.col("__top")).drop("__top")


def first_relation(rows: DataFrame, key: str, rank: str, ts: str, limit: int) -> DataFrame:
    """Each key once, with its first relation by rank: first by rank, then the newest."""
    return rows.groupBy(key).agg(F.min(rank).alias(rank), F.max(ts).alias(ts)).orderBy(rank, F.desc(ts), key).limit(limit)


def shown_and_rest(rows: DataFrame, layer: str, order: Sequence[Column], most: int) -> DataFrame:
    """How many of each layer are shown, and how many are left."""
    return rows.groupBy(layer).agg(F.count("*").alias("n")).select(layer, F.least("n", F.lit(most)).cast("long").alias("shown"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("rest"))


def shown(rows: DataFrame, layer: str, order: Sequence[Column], most: int) -> DataFrame:
    """The rows of each layer that are shown."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(layer).orderBy(*order))).where(F.col("k") <= most)


def retry_loops(calls: DataFrame, turn: Sequence[str], signature: str, error: str, least: int = 3, failed: int = 2) -> DataFrame:
    """Turns in which one signature was called often and failed often."""
    return calls.groupBy(*turn, signature).agg(F.count("*").alias("calls"), F.count_if(error).alias("failed")).where((F.col("calls") >= least) & (F.col("failed") >= failed))


def window_of(rows: DataFrame, key: str, ts: str, anchor, before: int, after: int, kinds: Mapping[str, DataFrame]) -> DataFrame:
    """kind, n: how many rows of each kind lie in the time from ``before`` keys before an anchor to ``after`` behind it. The
    bounds come from two short sorted reads."""
    low = rows.where(F.col(key) < anchor).orderBy(F.desc(key)).limit(before).agg(F.min_by(ts, key)).first()[0]
    high = rows.where(F.col(key) >= anchor).orderBy(key).limit(after + 1).agg(F.max_by(ts, key)).first()[0]
    out = None
    for kind, table in kinds.items():
        within = table
        if low is not None:
            within = within.where(F.col(ts) >= F.lit(low))
        within = within.where(F.col(ts) <= F.lit(high)).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = within if out is None else out.union(within)
    return out


def routed(rows: DataFrame, id_: str) -> DataFrame:
    """kind and key of ids like kind:key; the key may hold colons."""
    parts = F.split(id_, ":", 2)
    return rows.withColumn("kind", parts[0]).withColumn("key", F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def search_layers(layers: Sequence[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """kind, id of the rows of each layer (kind, rows, key, label, needle) whose label holds the needle."""
    out = None
    for kind, rows, key, label, needle in layers:
        hit = rows.where(F.lower(label).contains(needle.lower())).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        out = hit if out is None else out.unionByName(hit)
    return out


def find_names(rows: DataFrame, key: str, name: str, path: str, needle: str, limit: int) -> DataFrame:
    """Names that begin with the needle before those that hold it, before paths that do; short names first."""
    n, p, x = F.lower(name), F.lower(path), needle.lower()
    score = F.when(n.startswith(x), 3).when(n.contains(x), 2).when(p.contains(x), 1)
    return rows.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), F.length(name), key).limit(limit).select(key, "score")


def symbol_score(name: Column, needle: str) -> Column:
    """10 for a part of the name that is equal, 5 for one that holds the needle, 1 if its letters come in order."""
    low, x = F.lower(name), needle.lower()
    return F.when(F.array_contains(F.split(low, "[ _./-]+"), x), 10).when(low.contains(x), 5).when(low.rlike(".*".join(f"\\Q{c}\\E" for c in x)), 1).otherwise(0)
