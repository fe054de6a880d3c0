"""Filters, joins, aggregations, windows, set operations and merges over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.operators import filters, relational
from corvidex.plans.base import Tables, query
from corvidex.sources import tables


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'F' OR o_totalprice >= 200000) AND o_orderpriority NOT IN ('1-URGENT') AND NOT (o_custkey < 10)""")
def payload_filter_orders(t: Tables) -> DataFrame:
    spec = {"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"gte": 200000}}], "o_orderpriority": {"nin": ["1-URGENT"]}, "$not": [{"o_custkey": {"lt": 10}}]}
    return t.orders.where(filters.payload(spec)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'error'""")
def json_props_filter(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.where(filters.payload({"k": {"gte": 50}, "event_type": {"ne": "error"}})).select("event_id", "k")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01')
OR (o_orderdate > TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2000-02-01')""")
def date_dnf_filter(t: Tables) -> DataFrame:
    groups = [[(">=", "1996-01-01"), ("<", "1996-07-01")], [(">", "2000-01-01"), ("<=", "2000-02-01")]]
    return t.orders.where(filters.date_dnf("o_orderdate", groups)).select("o_orderkey")


@query("""SELECT doc_id FROM documents WHERE contains(text, '100%') OR contains(source, '_1') OR contains(text, 'License')""")
def escaped_substring(t: Tables) -> DataFrame:
    return t.documents.where(filters.some([filters.substring_any(x, c) for x, c in (("100%", ["text"]), ("_1", ["source"]), ("License", ["text"]))])).select("doc_id")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS gross,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS paid
FROM lineitem GROUP BY 1, 2""")
def ledger_rollup(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = {"qty": F.col("l_quantity"), "gross": F.col("l_extendedprice"), "net": net, "paid": net * (1 + F.col("l_tax"))}
    return relational.rollup(t.lineitem, ["l_returnflag", "l_linestatus"], sums)


@query("""SELECT CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS cohort, l_linestatus, count(*) AS n,
round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END), 2) AS kept, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
FROM lineitem GROUP BY 1, 2""")
def ledger_conditional(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("cohort", F.when(F.col("l_discount") >= 0.05, "high").otherwise("low"))
    kept = F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_extendedprice")))
    return rows.groupBy("cohort", "l_linestatus").agg(F.count("*").alias("n"), F.round(kept, 2).alias("kept"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"))


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def kind_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def queue_status_pivot(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count().na.fill(0)


@query("""SELECT user_id, count(*) AS commits, count(*) FILTER (event_type = 'error') AS risky, max(ts) AS last_ts,
array_to_string(list_sort(list(DISTINCT event_type))[1:3], ',') AS kinds FROM events GROUP BY 1""")
def filestats_by_user(t: Tables) -> DataFrame:
    kinds = F.array_join(F.slice(F.sort_array(F.collect_set("event_type")), 1, 3), ",")
    return t.events.groupBy("user_id").agg(F.count("*").alias("commits"), F.count_if(F.col("event_type") == "error").alias("risky"), F.max("ts").alias("last_ts"), kinds.alias("kinds"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem),
n AS (SELECT x, count(*) AS c FROM f GROUP BY 1),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS count FROM f a JOIN f b USING (g) WHERE a.x < b.x GROUP BY 1, 2)
SELECT a, b, count, round(count / greatest(1, least(na.c, nb.c)), 6) AS ratio, round(count / greatest(1, least(na.c, nb.c)) * least(count, 10), 6) AS score
FROM p JOIN n na ON a = na.x JOIN n nb ON b = nb.x WHERE count > 1""")
def event_cochange(t: Tables) -> DataFrame:
    return relational.cooccurrence(t.lineitem, "l_orderkey", "l_partkey").where("count > 1")


@query("""WITH d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
k AS (SELECT DISTINCT event_type FROM events)
SELECT day, k.event_type AS kind, count(event_id) AS n FROM d CROSS JOIN k LEFT JOIN events e ON e.ts::DATE = day AND e.event_type = k.event_type GROUP BY 1, 2""")
def daily_digest(t: Tables) -> DataFrame:
    return relational.digest(t.events, "ts", "event_type")


@query("""SELECT kind, id, ts FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS ts FROM orders UNION ALL
SELECT 'event', event_id, ts FROM events) ORDER BY ts DESC, kind, id LIMIT 50 OFFSET 20""")
def feed_merge(t: Tables) -> DataFrame:
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts")
    return tables.page(orders.unionByName(events), [F.desc("ts"), F.col("kind"), F.col("id")], 20, 50).drop("has_more")


@query("""WITH a AS (SELECT ts, event_id FROM events ORDER BY value DESC, event_id LIMIT 1),
b AS (SELECT event_id, ts, -row_number() OVER (ORDER BY ts DESC, event_id DESC) AS pos FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM a)),
c AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events WHERE (ts, event_id) >= (SELECT (ts, event_id) FROM a))
SELECT event_id, ts, pos FROM (SELECT * FROM b WHERE pos >= -5 UNION ALL SELECT * FROM c WHERE pos <= 5)""")
def timeline_around_anchor(t: Tables) -> DataFrame:
    anchor = t.events.orderBy(F.desc("value"), "event_id").limit(1)
    return relational.around(t.events.select("event_id", "ts"), anchor, "ts", "event_id", 5, 5)


@query("""SELECT 'order_without_lines' AS audit, o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'unlabelled', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'bought_parts', p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def semi_anti_audit(t: Tables) -> DataFrame:
    empty = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order_without_lines").alias("audit"), F.col("o_orderkey").alias("id"))
    bare = t.documents.join(t.labels, "doc_id", "left_anti").select(F.lit("unlabelled").alias("audit"), F.col("doc_id").alias("id"))
    bought = t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.lit("bought_parts").alias("audit"), F.col("p_partkey").alias("id"))
    return empty.union(bare).union(bought)


@query("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer), s AS (SELECT s_suppkey, s_nationkey FROM supplier),
n AS (SELECT s_nationkey, count(*) AS k, min(s_suppkey) AS one FROM s GROUP BY 1)
SELECT c_custkey, coalesce(k, 0) AS candidates, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 1 THEN 'extracted' ELSE 'ambiguous' END AS state,
CASE WHEN k = 1 THEN one END AS target FROM c LEFT JOIN n ON c_nationkey = s_nationkey""")
def route_join_ambiguity(t: Tables) -> DataFrame:
    return relational.unique_join(t.customer.select("c_custkey", F.col("c_nationkey").alias("key")), t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("target")), "key").drop("key")


@query("""WITH o AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
n AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT 'removed' AS change, * FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'new', * FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def diff_snapshots(t: Tables) -> DataFrame:
    cut, rows = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), ("o_custkey", "o_orderstatus")
    return relational.diff(t.orders.where(cut).select(*rows), t.orders.where(~cut).select(*rows))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def last_writer_upsert(t: Tables) -> DataFrame:
    return tables.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH o AS (SELECT user_id, max(value) AS v, min(event_type) FILTER (event_type < 'error') AS k FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
n AS (SELECT user_id, max(value) FILTER (value > 150) AS v, max(event_type) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.v, o.v) AS v, coalesce(n.k, o.k) AS k FROM o FULL JOIN n ON o.user_id = n.user_id""")
def coalescing_upsert(t: Tables) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    old = t.events.where(cut).groupBy("user_id").agg(F.max("value").alias("v"), F.min(F.when(F.col("event_type") < "error", F.col("event_type"))).alias("k"))
    new = t.events.where(~cut).groupBy("user_id").agg(F.max(F.when(F.col("value") > 150, F.col("value"))).alias("v"), F.max("event_type").alias("k"))
    return tables.coalescing_upsert(old, new, ["user_id"])


@query("""SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def additive_upsert(t: Tables) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    part = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return tables.additive_upsert(part(t.events.where(cut)), part(t.events.where(~cut)), ["user_id", "event_type"], ["n"], ["last_ts"])


@query("""SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(greatest(1, n_chars // 4)) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS running FROM
(SELECT source, doc_id, n_chars FROM documents)) WHERE running <= 550""")
def pack_budget_prefix(t: Tables) -> DataFrame:
    cost = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_chars") / 4))
    return relational.budget_prefix(t.documents.select("source", "doc_id", "n_chars", cost.alias("cost")), ["source"], ["n_chars", "doc_id"], "cost", 550).select("source", "doc_id", "running")


@query()
def pack_budget_breadth(t: Tables) -> DataFrame:
    """Top two of each section first, then by score, skipping what doesn't fit."""
    items = t.documents.select(F.lit("pack").alias("pack"), F.col("source").alias("section"), "doc_id", F.col("n_chars").cast("double").alias("score"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_chars") / 4)).alias("cost"))
    return relational.greedy_pack(items, "pack", "section", "score", "cost", "doc_id", 20_000)


@query("""SELECT count(*) AS n, sum(n_chars) AS source_chars, sum(greatest(0, n_chars - 400)) AS kept_out, round(avg(n_chars), 4) AS mean_chars FROM documents""")
def net_value(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("n"), F.sum("n_chars").alias("source_chars"), F.sum(F.greatest(F.lit(0).cast("long"), F.col("n_chars") - 400)).alias("kept_out"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""SELECT role, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens, count(*) AS n FROM conversations GROUP BY 1""")
def token_economics(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"), F.count("*").alias("n"))


@query("""SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k,
max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part) WHERE k <= 3 AND p_retailprice >= 0.2 * top""")
def gap_ratio_seeds(t: Tables) -> DataFrame:
    return relational.gap_ratio(t.part, ["p_brand"], "p_retailprice", "p_partkey", 3, 0.2).select("p_partkey", "p_brand", "p_retailprice")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3""")
def per_group_cap(t: Tables) -> DataFrame:
    return relational.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id")


@query("""WITH p AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), '/') AS parts FROM pages)
SELECT array_to_string(parts[1:k], '/') AS prefix, k AS depth, count(*) AS n FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p) GROUP BY 1, 2""")
def rollup_path_levels(t: Tables) -> DataFrame:
    path = F.trim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit("/"))
    return relational.path_rollup(t.pages.select(path.alias("path")), "path").withColumn("depth", F.col("depth").cast("long"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def endpoint_join(t: Tables) -> DataFrame:
    wide = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return wide.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) FILTER (o_orderstatus = 'P') AS pending, max(o_orderdate) AS last_ts
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def session_list_counts(t: Tables) -> DataFrame:
    done = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.max("o_orderdate").alias("last_ts"))
    return t.customer.join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("pending", F.lit(0)).alias("pending"), "last_ts")


@query("""SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def store_stats(t: Tables) -> DataFrame:
    one = lambda name: getattr(t, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
    return one("orders").union(one("events")).union(one("documents"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS level FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def two_level_regroup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus").cast("long")).alias("level"))


@query("""SELECT user_id, event_id, prev_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events)
WHERE event_type = 'purchase' AND prev_type = 'error'""")
def error_then_fix(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("prev_type", F.lag("event_type").over(w)).where("event_type = 'purchase' AND prev_type = 'error'").select("user_id", "event_id", "prev_type")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1, 99) AS end_line FROM lineitem""")
def symbol_span(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.lead("l_linenumber").over(w) - 1, F.lit(99)).alias("end_line"))


@query("""SELECT kind, id, n FROM (SELECT 'user' AS kind, user_id AS id, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders GROUP BY 2)""")
def scope_unpivot(t: Tables) -> DataFrame:
    users = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).select(F.lit("user").alias("kind"), "id", "n")
    return users.union(t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).select(F.lit("customer").alias("kind"), "id", "n"))


@query("""SELECT l_suppkey, 2 * count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_returnflag <> 'R') AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_suppkey LIMIT 20""")
def activity_ranking(t: Tables) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg((2 * F.count_if(back) + F.count_if(~back)).alias("score")).orderBy(F.desc("score"), "l_suppkey").limit(20)


@query("""SELECT c_custkey, CASE WHEN n >= 15 OR v > 3000000 THEN 'HIGH' WHEN n >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS v FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def impact_risk(t: Tables) -> DataFrame:
    s = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    risk = F.when((F.col("n") >= 15) | (F.col("v") > 3_000_000), "HIGH").when(F.col("n") >= 8, "MEDIUM").otherwise("LOW")
    return t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", risk.alias("risk"))


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000""")
def intersect_rows(t: Tables) -> DataFrame:
    rows = ("o_custkey", "o_orderkey")
    return t.orders.where("o_orderstatus = 'O'").select(*rows).intersect(t.orders.where("o_totalprice > 150000").select(*rows))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'cleared' WHEN a.s = b.s THEN 'reused' ELSE 'stale' END AS state
FROM (SELECT o_custkey AS k, CAST(round(sum(o_totalprice)) AS BIGINT) % 7 AS s FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) a FULL JOIN
(SELECT o_custkey AS k, CAST(round(sum(o_totalprice)) AS BIGINT) % 7 AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b ON a.k = b.k""")
def staleness_recheck(t: Tables) -> DataFrame:
    claim = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg((F.round(relational.sum_in_order("o_totalprice", "o_orderkey")).cast("long") % 7).alias("s"))
    return relational.recheck(claim(t.orders.where("o_orderstatus <> 'O'")), claim(t.orders.where("o_orderstatus <> 'F'")), "k", "s")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_diagnostics(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("copies")).where("copies > 1")
