"""Bi-temporal and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions.text import recency
from corvidex.operators import temporal as T
from corvidex.plans.base import Tables, query
from corvidex.sources.mirror import Mirror, Source
from corvidex.streaming import jobs, timers


def _facts(t: Tables) -> DataFrame:
    return T.validity(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND (nxt IS NULL OR nxt > TIMESTAMP '1998-06-01')""")
def facts_at(t: Tables) -> DataFrame:
    return T.facts_at(_facts(t), F.lit("1998-06-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderdate FROM orders), n AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate) AS nxt FROM d)
SELECT o_orderkey, n.nxt AS invalid_at FROM orders o JOIN n USING (o_custkey, o_orderstatus, o_orderdate)""")
def interval_overlap_contradictions(t: Tables) -> DataFrame:
    facts = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderdate").alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"))
    return T.close_contradictions(facts, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "invalid_at")


@query("""SELECT event_id, last_event_id FROM (SELECT e.event_id, p.event_id AS last_event_id, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS k
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error') WHERE k = 1""")
def asof_join(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select("user_id", "ts", "event_id")
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return T.as_of(errors, bought, "user_id", "ts", ["event_id"], "event_id").select("event_id", "last_event_id")


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * power(0.5, greatest(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts), 0) / 86400000000.0 / 30)), 4) AS score FROM events GROUP BY 1""")
def recency_decay(t: Tables) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(F.lit("2024-02-01")) - micros(F.col("ts"))) / 86_400_000_000
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return t.events.groupBy("user_id").agg(F.round(F.sum(sign * recency(age)), 4).alias("score"))


@query("""SELECT ts::DATE AS day, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 5) AS head FROM (SELECT *, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS k FROM events) GROUP BY 1""")
def episodes_daily(t: Tables) -> DataFrame:
    """A day's body has its first five lines; each partition keeps only its own five before they meet."""
    day = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    from corvidex.operators.relational import top_per_group

    first = top_per_group(t.events.select(F.to_date("ts").alias("day"), "event_id"), ["day"], [F.col("event_id")], 5).groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("head"))
    return day.join(first, "day")


@query("""SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE epoch_us(ts) - epoch_us(p) <= 600000000""")
def dup_within_window(t: Tables) -> DataFrame:
    return T.repeats_within(t.events, ["user_id", "event_type"], "ts", 600, "event_id").select("event_id")


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM
(SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2""")
def sessionize_gap(t: Tables) -> DataFrame:
    s = T.sessions(t.events, "user_id", "ts", 21_600, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT CAST(ts::DATE AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(t: Tables) -> DataFrame:
    """A streaming query over the events table, run until all is read."""
    return jobs.tumbling(t.spark, f"{t.sf_dir}/events.parquet").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_id, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def stateful_merge(t: Tables) -> DataFrame:
    """State by user, merged batch by batch into a table."""
    return jobs.merged(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "n", "last_id", F.round("total", 2).alias("total"))


@query("""SELECT o_custkey, max(o_orderdate) AS valid_mark, max(o_orderkey) AS ingest_mark, count(*) FILTER (o_orderkey >= 100) AS late_included FROM orders GROUP BY 1""")
def two_watermarks(t: Tables) -> DataFrame:
    """What is new is told by arrival (the key), so back-dated rows count; the event-time mark only rises."""
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("valid_mark"), F.max("o_orderkey").alias("ingest_mark"), F.count_if(F.col("o_orderkey") >= 100).alias("late_included"))


@query("""WITH x AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, event_type FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_type) AS k FROM
(SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_type) <= 21600000 THEN 0 ELSE 1 END AS new FROM x)),
f AS (SELECT user_id, k, event_type, min(ms) AS ms FROM b GROUP BY ALL), p AS (SELECT user_id, k, string_agg(event_type, ',' ORDER BY ms, event_type) AS paths FROM f GROUP BY ALL)
SELECT user_id, min(ms) AS first, max(ms) AS last, count(*) AS n, paths FROM b JOIN p USING (user_id, k) GROUP BY user_id, k, paths HAVING max(ms) + 21600000 < (SELECT max((epoch_us(ts) // 1000)) - 600000 FROM events)""")
def change_bursts(t: Tables) -> DataFrame:
    """A streaming query: what each user did without a pause of six hours, once that pause is over."""
    stream = timers.bursts(jobs.source(t.spark, f"{t.sf_dir}/events.parquet"), "user_id", "event_type", "ts", 21_600)
    done = timers.finished(t.spark, stream, "bursts")
    return done.select(F.col("group").alias("user_id"), "first", "last", "n", F.array_join("paths", ",").alias("paths"))


@query("""SELECT user_id, event_id, position, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
CASE WHEN event_type = 'error' THEN 'ValueError: error' ELSE coalesce(CAST(last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR), 'first') END AS result
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS position FROM events) WHERE (epoch_us(ts) // 1000) < (SELECT max((epoch_us(ts) // 1000)) - 600000 FROM events)""")
def group_queues(t: Tables) -> DataFrame:
    """A streaming query: each user's events in turn; a step says which one worked before, errors fail."""

    def step(memory: dict, payload: str) -> tuple[dict, str]:
        name, kind = payload.split(":")
        if kind == "error":
            raise ValueError(kind)
        return {"last": name}, memory.get("last", "first")

    rows = jobs.source(t.spark, f"{t.sf_dir}/events.parquet").withColumn("payload", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    stream = timers.in_turn(rows, "user_id", "ts", "event_id", "payload", step)
    done = timers.finished(t.spark, stream, "queues")
    return done.select(F.col("group").alias("user_id"), F.col("key").alias("event_id"), "position", "status", "result")


@query("""WITH l AS (SELECT 'event:' || event_id AS id, 'event' AS source, event_type AS kind, 'user:' || user_id AS target FROM events UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus, 'user:' || o_custkey FROM orders)
SELECT source, kind, count(*) AS entities, count(DISTINCT target) AS targets FROM l GROUP BY 1, 2""")
def read_model(t: Tables) -> DataFrame:
    """Two sources mirrored in two runs, an older part first; the read tables joined as a reader sees them."""
    events = t.events.select("event_id", "ts", F.col("event_type").alias("kind"), F.concat(F.lit("user:"), "user_id").alias("target"), F.concat(F.lit("event:"), "event_id").alias("id"))
    orders = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("kind"), F.concat(F.lit("user:"), "o_custkey").alias("target"), F.concat(F.lit("order:"), "o_orderkey").alias("id"))
    derive = lambda rows: {"entities": rows.select("id", "kind"), "links": rows.select(F.col("id").alias("src"), F.col("target").alias("dst"))}
    mirror = Mirror(t.spark, jobs.folder(t.spark, "mirror"), {"entities": ["id"], "links": ["src", "dst"]})
    for old, rest in (("ts < '2024-01-10'", "o_orderdate < '1995-01-01'"), ("true", "true")):
        mirror.sync({"event": Source(events.where(old), "ts", "event_id", derive), "order": Source(orders.where(rest), "o_orderdate", "o_orderkey", derive)})
    both = mirror.table("entities").join(mirror.table("links").withColumnRenamed("src", "id").drop("source"), "id")
    return both.groupBy("source", "kind").agg(F.count("*").alias("entities"), F.count_distinct("dst").alias("targets"))
