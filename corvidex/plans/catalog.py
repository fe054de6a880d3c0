"""Counts, catalogues, selections and orders over sessions, tools and observations.

Events stand for tool uses (user: session, event_type: tool), orders for observations (customer: session, priority: type),
customers for sessions (segment: project, nation: platform).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.operators import catalog as C
from corvidex.operators.sequences import error_fixes as error_fixes_of
from corvidex.plans.base import Tables, query


@query("SELECT event_type AS tool, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1 ORDER BY bytes DESC, tool LIMIT 3")
def tool_output_totals(t: Tables) -> DataFrame:
    return C.tool_totals(t.events, "event_type", "props", 3)


@query("SELECT c_nationkey AS platform, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS projects, count(*) AS sessions FROM customer GROUP BY 1")
def project_catalog(t: Tables) -> DataFrame:
    return C.catalogue(t.customer, "c_nationkey", "c_mktsegment").select(F.col("c_nationkey").alias("platform"), F.array_join("values", ",").alias("projects"), F.col("n").alias("sessions"))


@query("SELECT DISTINCT c_mktsegment AS project FROM customer WHERE c_mktsegment <> ''")
def distinct_projects(t: Tables) -> DataFrame:
    return C.distinct_values(t.customer, "c_mktsegment").withColumnRenamed("c_mktsegment", "project")


@query("""SELECT o_orderpriority AS type, count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts, CAST(sum(CAST(ceil(o_totalprice / 4) AS BIGINT)) AS BIGINT) AS tokens FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(*), min(o_orderdate), max(o_orderdate), CAST(sum(CAST(ceil(o_totalprice / 4) AS BIGINT)) AS BIGINT) FROM orders""")
def corpus_stats(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("tokens", F.ceil(F.col("o_totalprice") / 4))
    return C.corpus_stats(rows, "o_orderpriority", "o_orderdate", "tokens").withColumnRenamed("o_orderpriority", "type")


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, string_agg(l_partkey, ',' ORDER BY seq, l_partkey) AS files FROM f GROUP BY 1""")
def file_list_rollup(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.ordered_distinct(rows, "l_suppkey", "l_partkey", "seq").select("l_suppkey", F.array_join("values", ",").alias("files"))


@query("SELECT regexp_extract(p_type, '([A-Za-z]+)$', 1) AS language, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, language LIMIT 8")
def language_histogram(t: Tables) -> DataFrame:
    return C.histogram(t.part.select(F.regexp_extract("p_type", "([A-Za-z]+)$", 1).alias("language")), "language", 8)


@query("""SELECT l_suppkey AS section, l_partkey AS cite, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS item, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2""")
def max_combine(t: Tables) -> DataFrame:
    return C.best_of(t.lineitem, ["l_suppkey", "l_partkey"], "l_extendedprice", "l_orderkey").select(F.col("l_suppkey").alias("section"), F.col("l_partkey").alias("cite"), F.col("l_orderkey").alias("item"), F.col("l_extendedprice").alias("score"))


@query("""SELECT (SELECT count(*) FROM customer) AS sessions, (SELECT count(*) FROM orders) AS observations, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS files""")
def overview_counters(t: Tables) -> DataFrame:
    return C.overview({"sessions": t.customer, "observations": t.orders, "errors": t.events.where("event_type = 'error'"), "files": t.lineitem.select("l_partkey").distinct()})


@query("""WITH s AS (SELECT o_custkey, max(o_orderdate) AS last_ts, bool_or(o_orderstatus = 'F') AS has_summary FROM orders GROUP BY 1 ORDER BY last_ts DESC, o_custkey LIMIT 30) SELECT o_custkey, last_ts, has_summary FROM s""")
def recent_sessions(t: Tables) -> DataFrame:
    return C.recent_with_flag(t.orders, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F", 30).withColumnRenamed("flag", "has_summary")


@query("""WITH l AS (SELECT p_brand, max(p_retailprice) AS last, list_distinct(list_filter(regexp_split_to_array(lower(arg_max(p_name, (p_retailprice, p_partkey))), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part GROUP BY 1 ORDER BY last DESC, p_brand LIMIT 12)
SELECT p_brand, last FROM l WHERE list_has_any(w, ['cold', 'bolt', 'small'])""")
def latest_per_target(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_retailprice", "p_name", "p_partkey")
    return C.latest_with_words(rows, "p_brand", "p_retailprice", "p_partkey", "p_name", ["cold", "bolt", "small"], 12).withColumnRenamed("p_retailprice", "last").select("p_brand", "last")


@query("""SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))
AND coalesce(nullif(c_mktsegment, ''), 'BUILDING') = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def observations_for_context(t: Tables) -> DataFrame:
    """Type, platform with a default, and concepts of an exploded list; newest first."""
    concepts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("concepts"))
    rows = t.orders.join(concepts, "o_orderkey", "left").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    kept = C.session_filter(rows, types=("o_orderpriority", ["1-URGENT", "2-HIGH"]), concepts=("concepts", ["R", "A"]), platform=("c_mktsegment", "BUILDING", "BUILDING"))
    return kept.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND contains(props, '5') ORDER BY ts DESC, event_id LIMIT 100""")
def audit_page(t: Tables) -> DataFrame:
    rows = C.tool_filter(t.events, equal={"user_id": 3}, among={"event_type": ["click", "error"]}, since=("ts", "2024-01-05"), before=("ts", "2024-01-20"), holds={"props": "5"})
    return rows.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id")


@query("""SELECT round((SELECT sum(length(text)) / 4 FROM documents) / avg(greatest(1, length(text) // 4)), 6) AS ratio FROM benchmark""")
def token_reduction(t: Tables) -> DataFrame:
    return C.reduction(t.documents, t.benchmark, "text").select(F.round("ratio", 6).alias("ratio"))


@query("""SELECT event_id FROM events WHERE value > 50 ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ts DESC, event_id LIMIT 25""")
def risky_first(t: Tables) -> DataFrame:
    return t.events.where("value > 50").orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc("ts"), "event_id").limit(25).select("event_id")


@query("""(SELECT 'date_asc' AS by, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10) UNION ALL (SELECT 'date_desc', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
UNION ALL (SELECT 'relevance', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)""")
def order_modes(t: Tables) -> DataFrame:
    parts = [C.ordered(t.orders, mode, "o_totalprice", "o_orderdate", "o_orderkey").limit(10).select(F.lit(mode).alias("by"), "o_orderkey") for mode in ("date_asc", "date_desc", "relevance")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT place, p_partkey, p_name FROM (SELECT unnest([7, 3, 99, 12, 3]) AS id, generate_subscripts([7, 3, 99, 12, 3], 1) - 1 AS place) JOIN part ON p_partkey = id""")
def fetch_in_order(t: Tables) -> DataFrame:
    return C.fetch(t.part.select("p_partkey", "p_name"), "p_partkey", [7, 3, 99, 12, 3])


@query("""WITH c AS (SELECT c_mktsegment AS community, count(*) AS size, string_agg(c_custkey, ',' ORDER BY c_custkey) AS m FROM customer GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, m) - 1 AS number, community, size FROM c""")
def community_order(t: Tables) -> DataFrame:
    return C.numbered(t.customer.select(F.col("c_mktsegment").alias("community"), F.col("c_custkey").alias("id")))


@query("""SELECT count(*) FILTER (ts >= m - INTERVAL 1 DAY) AS last_day, round(sum(value) FILTER (ts >= m - INTERVAL 1 DAY), 2) AS spent, round((SELECT avg(value) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)), 6) AS mean_of_last FROM events CROSS JOIN (SELECT max(ts) AS m FROM events)""")
def budget_usage(t: Tables) -> DataFrame:
    return C.budget(t.events, "ts", "event_id", "value", 50).select("last_day", F.round("spent", 2).alias("spent"), F.round("mean_of_last", 6).alias("mean_of_last"))


@query("""WITH x AS (SELECT p_partkey, p_name, unnest(['cold', 'bolt', 'small']) AS term, p_size FROM part) SELECT term, p_partkey FROM x WHERE contains(lower(p_name), term) QUALIFY row_number() OVER (PARTITION BY term ORDER BY p_size DESC, length(p_name), p_partkey) = 1""")
def best_seed_per_term(t: Tables) -> DataFrame:
    return C.best_seeds(t.part, "p_partkey", "p_name", ["cold", "bolt", "small"], "p_size")


@query("""WITH s AS (SELECT l_suppkey AS id, CAST(count(*) AS DOUBLE) AS score FROM lineitem WHERE l_discount > 0.05 GROUP BY 1), d AS (SELECT id, score, s_nationkey AS label FROM s JOIN supplier ON id = s_suppkey),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1) SELECT id, score FROM f WHERE score >= 0.2 * (SELECT max(score) FROM f) ORDER BY score DESC, id LIMIT 3""")
def seed_pick_distinct(t: Tables) -> DataFrame:
    scored = t.lineitem.where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return C.pick_seeds(scored.join(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label")), "id")).select("id", "score")


@query("""WITH r AS (SELECT o_custkey AS session, l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS rel, o_orderdate AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (1, 2, 3))
SELECT session, min(rel) AS rel, max(ts) AS ts FROM r GROUP BY 1 ORDER BY rel, ts DESC, session LIMIT 30""")
def modifies_before_reads(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem.where(F.col("l_suppkey").isin(1, 2, 3)), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("session"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("rel"), F.col("o_orderdate").alias("ts"))
    return C.first_relation(rows, "session", "rel", "ts", 30)


@query("""WITH r AS (SELECT s_nationkey AS layer, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT layer, count(*) FILTER (k <= 3) AS shown, count(*) FILTER (k > 3) AS rest FROM r GROUP BY 1""")
def layer_shown_rest(t: Tables) -> DataFrame:
    return C.shown_and_rest(t.supplier.select(F.col("s_nationkey").alias("layer"), F.col("s_suppkey").alias("id"), "s_acctbal"), "layer", [F.desc("s_acctbal"), F.col("id")], 3)


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, props, lead(event_id) OVER w AS n1 FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY event_id)),
f AS (SELECT user_id, day, count(*) AS calls, count(*) FILTER (length(props) > 8) AS failed, event_type AS signature FROM x GROUP BY 1, 2, 5) SELECT user_id, day, signature, calls, failed FROM f WHERE calls >= 3 AND failed >= 2""")
def retry_loops(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("signature"), (F.length("props") > 8).alias("error"))
    return C.retry_loops(rows, ["user_id", "day"], "signature", "error")


@query("""WITH c AS (SELECT user_id, event_id AS seq, event_type AS signature, props AS target, length(props) > 8 AS failed, event_type = 'purchase' AND length(props) <= 8 AS edited FROM events),
r AS (SELECT *, coalesce(sum(CAST(edited AS INT)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
n AS (SELECT *, first_value(CASE WHEN NOT failed THEN {'seq': seq, 'target': target, 'before': before} END IGNORE NULLS) OVER (PARTITION BY user_id, signature ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fix FROM r)
SELECT user_id, seq, signature, fix.seq AS fixed_by, CAST(fix.before - before AS BIGINT) AS edits, fix.target <> target AS changed FROM n WHERE failed AND fix IS NOT NULL AND (fix.before > before OR fix.target <> target)""")
def error_fixes(t: Tables) -> DataFrame:
    """A user's whole history is one turn."""
    short = F.length("props") <= 8
    calls = t.events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("signature"), F.col("props").alias("target"), (~short).alias("failed"), short.alias("worked"), (F.col("event_type") == "purchase").alias("edit"))
    return error_fixes_of(calls, ["user_id"])


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 'line', l_orderkey * 10 + l_linenumber FROM lineitem)
SELECT day, count(*) FILTER (kind = 'order') AS orders, count(*) FILTER (kind = 'line') AS lines, min(id) AS first_id FROM a GROUP BY 1""")
def timeline_by_day(t: Tables) -> DataFrame:
    orders = t.orders.select(F.to_date("o_orderdate").alias("day"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    lines = t.lineitem.select(F.to_date("l_shipdate").alias("day"), F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    merged = orders.unionByName(lines).groupBy("day")
    return merged.agg(F.count_if(F.col("kind") == "order").alias("orders"), F.count_if(F.col("kind") == "line").alias("lines"), F.min("id").alias("first_id"))


@query("""WITH a AS (SELECT event_id, ts FROM events ORDER BY value DESC, event_id LIMIT 1), b AS (SELECT min(event_id) AS lo FROM (SELECT event_id FROM events WHERE event_id < (SELECT event_id FROM a) ORDER BY event_id DESC LIMIT 6)),
c AS (SELECT max(event_id) AS hi FROM (SELECT event_id FROM events WHERE event_id >= (SELECT event_id FROM a) ORDER BY event_id LIMIT 7)), e AS (SELECT (SELECT ts FROM events WHERE event_id = lo) AS x, (SELECT ts FROM events WHERE event_id = hi) AS y FROM b, c)
SELECT 'event' AS kind, count(*) AS n FROM events, e WHERE ts BETWEEN x AND y""")
def window_from_neighbours(t: Tables) -> DataFrame:
    anchor = t.events.orderBy(F.desc("value"), "event_id").select("event_id").first()[0]
    return C.window_of(t.events, "event_id", "ts", anchor, 6, 6, {"event": t.events})


@query("""SELECT kind, key, count(*) AS n FROM (SELECT split_part(x, ':', 1) AS kind, substr(x, strpos(x, ':') + 1) AS key FROM (SELECT 'order:' || o_orderpriority AS x FROM orders UNION ALL SELECT 'user:' || user_id || ':' || event_type FROM events)) GROUP BY 1, 2""")
def id_prefix_routing(t: Tables) -> DataFrame:
    ids = t.orders.select(F.concat(F.lit("order:"), "o_orderpriority").alias("id")).union(t.events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))))
    return C.routed(ids, "id").groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("""SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE contains(lower(c_name), '12') UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(lower(p_name), 'bolt') UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE contains(lower(s_name), '12')""")
def search_layers(t: Tables) -> DataFrame:
    """Results of several tables as one, without columns that a table lacks."""
    return C.search_layers([("customer", t.customer, "c_custkey", "c_name", "12"), ("part", t.part, "p_partkey", "p_name", "bolt"), ("supplier", t.supplier, "s_suppkey", "s_name", "12")])


@query("""SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'cold') THEN 3 WHEN contains(lower(p_name), 'cold') THEN 2 WHEN contains(lower(p_type), 'cold') THEN 1 ELSE 0 END AS score FROM part WHERE contains(lower(p_name), 'cold') OR contains(lower(p_type), 'cold') ORDER BY score DESC, length(p_name), p_partkey LIMIT 30""")
def name_find(t: Tables) -> DataFrame:
    return C.find_names(t.part, "p_partkey", "p_name", "p_type", "Cold", 30)


@query("""SELECT p_partkey, CASE WHEN list_contains(string_split(lower(p_name), ' '), 'bolt') THEN 10 WHEN contains(lower(p_name), 'bolt') THEN 5 WHEN regexp_matches(lower(p_name), 'b.*o.*l.*t') THEN 1 ELSE 0 END AS score FROM part""")
def symbol_match(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.symbol_score(F.col("p_name"), "Bolt").alias("score"))


@query("""SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey LIMIT 200""")
def corpus_selection(t: Tables) -> DataFrame:
    """Observations of sessions of one project, oldest first."""
    kept = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus <> 'P'").join(kept, "o_custkey", "left_semi").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderdate")


@query("""SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS risky, max(o_orderdate) AS last_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (1, 5, 9) GROUP BY 1""")
def history_for_files(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_partkey").isin(1, 5, 9)).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("risky"), F.max("o_orderdate").alias("last_ts"))


