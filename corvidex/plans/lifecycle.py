"""Memories and work queues. Orders stand for memories (each later order of a customer with the same priority supersedes
the one before), lineitem for their uses and links, events for queued messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.operators import memory as M
from corvidex.operators import queue as Q
from corvidex.operators import retrieval as R
from corvidex.plans.base import Tables, query

NOW = 1_000_000_000.0
_LINE = "(PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey"
_MEM = f"""m AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus AS text, o_orderpriority AS kind, 86400.0 * date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS created_at,
CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS forgotten, lead(o_orderkey) OVER {_LINE}) AS superseded_by FROM orders)"""
_USE = "u AS (SELECT l_orderkey AS id, max(86400.0 * date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS last_used, count(*) AS uses FROM lineitem GROUP BY 1)"
_AGED = f"""{_MEM}, {_USE}, g AS (SELECT m.*, coalesce(uses, 0) AS uses, kind <> '1-URGENT' AND 1000000000.0 - greatest(coalesce(last_used, 0), created_at) > 90 * 86400 AS stale FROM m LEFT JOIN u USING (id))"""
_MESSAGES = """q AS (SELECT event_id AS id, user_id AS session, CASE event_type WHEN 'purchase' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
CASE WHEN event_type = 'purchase' THEN epoch(date_trunc('second', ts)) END AS claimed_at, CAST(extract(hour FROM ts) // 8 AS BIGINT) AS retries FROM events)"""


def seconds(day: str) -> Column:
    return F.datediff(day, F.lit("1970-01-01")) * 86400.0


def memories(t: Tables) -> DataFrame:
    """With ``supersedes``, as they come in."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.col("o_orderpriority").alias("kind"), seconds("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("forgotten"), F.lit(None).cast("long").alias("superseded_by"), before.alias("supersedes"))


def linked(t: Tables) -> DataFrame:
    """Memories after each has superseded the one before it."""
    new = memories(t)
    return M.supersede(new.where("supersedes IS NULL").drop("supersedes"), new.where("supersedes IS NOT NULL"))


def aged(t: Tables) -> DataFrame:
    uses = t.lineitem.select(F.col("l_orderkey").alias("memory_id"), seconds("l_shipdate").alias("ts"))
    return M.aged(linked(t), uses, NOW, pinned=["1-URGENT"])


@query(f"WITH {_MEM} SELECT id, superseded_by FROM m")
def memory_supersede(t: Tables) -> DataFrame:
    return linked(t).select("id", "superseded_by")


@query(f"""SELECT o_orderkey AS id, last_value(o_orderkey) OVER {_LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head,
count(*) OVER {_LINE} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS steps FROM orders""")
def memory_chain(t: Tables) -> DataFrame:
    return M.chains(linked(t))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1)
SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place FROM orders JOIN f USING (o_custkey, o_orderpriority)""")
def memory_history(t: Tables) -> DataFrame:
    first = t.orders.agg(F.min("o_orderkey")).first()[0]
    return M.history(linked(t), first).select("id", "place")


@query(f"WITH {_AGED} SELECT id, CAST(uses AS BIGINT) AS uses, stale FROM g")
def memory_aging(t: Tables) -> DataFrame:
    return aged(t).select("id", F.col("uses").cast("long").alias("uses"), "stale")


@query(f"WITH {_AGED} SELECT id, stale FROM g WHERE forgotten = 0 AND superseded_by IS NULL ORDER BY stale, created_at DESC, id LIMIT 100")
def memory_fresh_first(t: Tables) -> DataFrame:
    return M.fresh_first(aged(t).where(M.active()), F.desc("created_at"), "id").limit(100).select("id", "stale")


@query(f"""WITH {_AGED}, l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount >= 0.1)
SELECT id FROM g WHERE forgotten = 0 AND superseded_by IS NULL AND (id IN (SELECT id FROM l) OR regexp_matches(text, '(?i)\\b(high)\\b'))
ORDER BY stale, CASE kind WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 10 END, created_at DESC, id LIMIT 40""")
def memory_about(t: Tables) -> DataFrame:
    links = t.lineitem.where("l_discount >= 0.1").select(F.col("l_orderkey").alias("id"))
    return M.about(aged(t), links, ["high", "low"], ["5-LOW", "2-HIGH"], 40).select("id")


@query(f"""WITH {_AGED}, a AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS r FROM g QUALIFY r < 200), b AS (SELECT id, row_number() OVER (ORDER BY uses DESC, id) - 1 AS r FROM g QUALIFY r < 200),
f AS (SELECT id, sum(1.0 / (r + 60)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT id, round(s * CASE WHEN stale THEN 0.6 ELSE 1.0 END, 8) AS score FROM f JOIN g USING (id) WHERE forgotten = 0 AND superseded_by IS NULL ORDER BY s * CASE WHEN stale THEN 0.6 ELSE 1.0 END DESC, id LIMIT 20""")
def memory_recall(t: Tables) -> DataFrame:
    rows = aged(t)
    lists = [R.ranked(R.top(rows, score, "id", 200), score, "id").select("id", "rank") for score in ("created_at", "uses")]
    return M.recall(lists, rows, 20).select("id", F.round("score", 8).alias("score"))


@query("""SELECT 'links ' || l_returnflag AS what, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000) GROUP BY 1
UNION ALL SELECT 'forgotten', count(*) FROM orders WHERE o_totalprice < 100000""")
def memory_forget(t: Tables) -> DataFrame:
    ids = t.orders.where("o_totalprice < 100000").select(F.col("o_orderkey").alias("id"))
    rows, links = M.forget(memories(t).withColumn("forgotten", F.lit(0)), ids, t.lineitem.withColumnRenamed("l_orderkey", "memory_id"))
    counted = links.groupBy(F.concat(F.lit("links "), "l_returnflag").alias("what")).agg(F.count("*").alias("n"))
    return counted.union(rows.select(F.lit("forgotten").alias("what"), "forgotten").groupBy("what").agg(F.sum("forgotten").alias("n")))


@query("SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click'")
def memory_scope(t: Tables) -> DataFrame:
    return M.scoped(t.events, {"event_type": "click"}, user_id=" 7 ").select("event_id")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' GROUP BY 1")
def payload_unexpired(t: Tables) -> DataFrame:
    live = t.orders.where(M.unexpired(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-01-01").cast("date")))
    return live.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 9000 THEN 'PREMIUM' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT -s_suppkey, 'SUPPLIER' FROM supplier)
SELECT k, CASE WHEN a.v IS NULL THEN 'ADD' WHEN b.v IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS event, a.v AS old_value, b.v AS new_value FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def change_feed(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 9000, "PREMIUM").otherwise(F.col("c_mktsegment")).alias("v"))
    return M.changes(old, new.union(t.supplier.select(-F.col("s_suppkey"), F.lit("SUPPLIER"))), "k", "v")


@query("""SELECT c_custkey AS k, 'DELETE' AS event, c_name AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM customer WHERE c_nationkey = 7
UNION ALL SELECT count(*), 'left', NULL, NULL FROM customer WHERE c_nationkey <> 7""")
def delete_scope(t: Tables) -> DataFrame:
    left, feed = M.delete_scope(t.customer, "c_custkey", "c_name", F.col("c_nationkey") == 7)
    return feed.withColumnRenamed("c_custkey", "k").union(left.agg(F.count("*").alias("k"), F.lit("left"), F.lit(None).cast("string"), F.lit(None).cast("string")))


@query("""WITH o AS (SELECT p_partkey AS oid, p_brand || p_size AS k, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part),
n AS (SELECT p_partkey AS id, p_brand || p_size AS k, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' of new make'), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part),
p AS (SELECT id, oid, len(list_intersect(n.w, o.w)) AS i, len(n.w) AS a, len(o.w) AS b, len(list_filter(n.w, lambda x: x NOT IN ('of', 'the', 'and', 'in', 'on'))) AS ca FROM n JOIN o USING (k)),
s AS (SELECT *, i / (a + b - i) AS j, i / least(ca, b) AS ov FROM p),
x AS (SELECT id, max(j) AS mj, max(ov) AS mo, arg_max(oid, (j, -oid)) AS so, arg_max(oid, (ov, -oid)) AS oo FROM s GROUP BY 1)
SELECT id, CASE WHEN mj >= 0.6 THEN 'NONE' WHEN mo >= 0.5 THEN 'UPDATE' ELSE 'ADD' END AS event, CASE WHEN mj >= 0.6 THEN so WHEN mo >= 0.5 THEN oo END AS old_id FROM x""")
def memory_reconcile(t: Tables) -> DataFrame:
    group = F.concat("p_brand", "p_size").alias("k")
    old = t.part.select(F.col("p_partkey").alias("id"), group, F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return M.reconcile(old, t.part.select(F.col("p_partkey").alias("id"), group, F.concat("p_name", F.lit(" of new make")).alias("text")), "k")


def messages(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    at = seconds("ts") + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.when(kind == "purchase", "processing").when(kind == "error", "failed").otherwise("pending").alias("status"), F.when(kind == "purchase", at).alias("claimed_at"), F.floor(F.hour("ts") / 8).alias("retries"))


@query(f"""WITH {_MESSAGES}, k AS (SELECT id FROM q WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY session ORDER BY id) <= 3)
SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN 'processing' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM k) THEN 1000000000.0 ELSE claimed_at END AS claimed_at FROM q""")
def queue_claim(t: Tables) -> DataFrame:
    return Q.claim(messages(t), NOW, 3).select("id", "status", "claimed_at")


@query(f"WITH {_MESSAGES} SELECT status, count(*) AS n FROM q WHERE status <> 'processing' GROUP BY 1")
def queue_confirm(t: Tables) -> DataFrame:
    m = messages(t)
    return Q.confirm(m, m.where("status = 'processing'")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_MESSAGES} SELECT id, CASE WHEN status = 'processing' AND retries + 1 >= 3 THEN 'failed' WHEN status = 'processing' THEN 'pending' ELSE status END AS status,
CASE WHEN status = 'processing' THEN retries + 1 ELSE retries END AS retries FROM q""")
def queue_retry(t: Tables) -> DataFrame:
    m = messages(t)
    return Q.retry(m, m.where("status = 'processing'")).select("id", "status", "retries")


@query(f"""WITH {_MESSAGES} SELECT id, CASE WHEN status = 'processing' AND claimed_at < (SELECT max(claimed_at) FROM q) - 864000 THEN 'pending' ELSE status END AS status FROM q""")
def queue_reset_stale(t: Tables) -> DataFrame:
    m = messages(t)
    last = m.agg(F.max("claimed_at")).first()[0]
    return Q.reset_stale(m, last, 864_000).select("id", "status")


@query("SELECT event_id AS cursor, (SELECT count(*) FROM (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100)) AS n FROM (SELECT max(event_id) AS event_id FROM (SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100))")
def queue_tail(t: Tables) -> DataFrame:
    return Q.tail(t.events, "event_id", 500, 100)[1]


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(length(props)) AS BIGINT) AS cost, max(event_id) AS last FROM events GROUP BY 1)
SELECT * FROM (SELECT *, CAST(sum(cost) OVER (ORDER BY day) AS BIGINT) AS total FROM d) WHERE total <= 20000 OR total = cost""")
def budgeted_days(t: Tables) -> DataFrame:
    rows = t.events.select(F.to_date("ts").alias("day"), "event_id", F.length("props").alias("size"))
    return Q.within_budget(rows, "day", "event_id", "size", 20_000)


@query("""WITH e AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS c, CAST(o_orderdate AS DATE) - CAST(30 * length(o_orderpriority) AS INT) AS v FROM orders),
s AS (SELECT c_custkey AS k, DATE '1998-01-01' AS seen, DATE '1998-06-01' AS reached FROM customer WHERE c_acctbal > 0)
SELECT k, count(*) FILTER (seen IS NULL OR c > seen) AS fresh, count(*) FILTER (c > seen AND v < reached) AS back_dated, greatest(max(seen), max(c)) AS seen,
greatest(max(reached), max(v) FILTER (seen IS NULL OR c > seen)) AS reached FROM e LEFT JOIN s USING (k) GROUP BY 1""")
def chain_watermarks(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_custkey").alias("k"), day.alias("c"), F.date_sub(day, 30 * F.length("o_orderpriority")).alias("v"))
    state = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit("1998-01-01").cast("date").alias("seen"), F.lit("1998-06-01").cast("date").alias("reached"))
    return Q.watermarks(rows, "k", "c", "v", state)


_PROMPT = """CASE event_id % 9 WHEN 0 THEN 'No, that is not it: ' WHEN 1 THEN 'no problem, go on with ' WHEN 2 THEN 'You broke the build with ' WHEN 3 THEN 'Do not forget ' WHEN 4 THEN 'please read '
WHEN 5 THEN 'Stop to explain ' WHEN 6 THEN 'Undo ' WHEN 7 THEN 'this is the wrong file, ' ELSE 'nothing ' END || props"""


@query(f"""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id), {_PROMPT} FROM events)
SELECT conv_id, count(*) AS prompts, count(*) FILTER (number >= 2 AND length(x) BETWEEN 1 AND 600 AND NOT regexp_matches(x, $${Q.NO_CORRECTION}$$) AND (regexp_matches(x, $${Q.CORRECTION_START}$$) OR regexp_matches(x, $${Q.CORRECTION_ANYWHERE}$$))) AS corrections FROM p GROUP BY 1""")
def corrections(t: Tables) -> DataFrame:
    """The users' turns, and events as short prompts; neither has a prompt to correct in its first."""
    said = t.conversations.where("role = 'user'").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("number"), "text")
    done = t.events.select((-1 - F.col("user_id")).alias("conv_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("number"), F.expr(_PROMPT).alias("text"))
    prompts = said.unionByName(done)
    return prompts.groupBy("conv_id").agg(F.count("*").alias("prompts"), F.count_if(Q.is_correction(F.col("text"), F.col("number"))).alias("corrections"))


@query("""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS seq, CASE event_type WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'shell' ELSE 'search' END AS kind, props AS target, event_type AS tool FROM events),
f AS (SELECT user_id, day, kind, target, min(seq) AS seq FROM c GROUP BY 1, 2, 3, 4),
l AS (SELECT user_id, day, array_to_string(list(target ORDER BY seq, target) FILTER (kind = 'read')[1:20], ',') AS r, array_to_string(list(target ORDER BY seq, target) FILTER (kind = 'edit')[1:20], ',') AS m FROM f GROUP BY 1, 2)
SELECT user_id, day, coalesce(r, '') AS read, coalesce(m, '') AS modified, count(*) AS calls, count(DISTINCT tool) AS tools FROM c JOIN l USING (user_id, day) GROUP BY ALL""")
def turn_evidence(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    calls = t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.when(kind == "click", "read").when(kind == "purchase", "edit").when(kind == "signup", "shell").otherwise("search").alias("kind"), F.col("props").alias("target"), kind.alias("tool"))
    return Q.evidence(calls, ["user_id", "day"]).select("user_id", "day", F.array_join("read", ",").alias("read"), F.array_join("modified", ",").alias("modified"), "calls", "tools")
