"""A work queue as a table: claim with a lease, confirm, retry, reset; cursors and budgets; what a turn did.

messages: id, session, status (pending, processing, failed), claimed_at (seconds), retries. Each step returns the new
table; in a stream the same steps run in ``foreachBatch``, where the checkpoint's offsets stand for the leases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a claimed message may take.
LEASE = 600
MOST_RETRIES = 3
#: What a prompt begins with, or holds, that tells an agent that it was wrong; what begins like that and
#: doesn't; and the longest prompt that is one.
CORRECTION_START = (
    r"(?i)^\W*(?:no\b|nope\b|wrong\b|stop\b|don't\b|do not\b|dont\b|never\b|that's (?:not|wrong)|that is (?:not|wrong)|that isn't"
    r"|not (?:that|what|like)|revert\b|undo\b|why did you|you (?:shouldn't|should not|broke|forgot|missed|misunderstood))"
)
CORRECTION_ANYWHERE = (
    r"(?i)\bnot what i (?:asked|wanted|meant|said)\b|\bthat'?s wrong\b|\bi (?:told|asked) you (?:to|not)\b"
    r"|\byou (?:broke|deleted|removed|changed) (?:the |my |it)\b|\bwrong (?:file|approach|function)\b"
)
NO_CORRECTION = (
    r"(?i)^\W*(?:no (?:problem|worries|rush|need|hurry|thanks)|nope,? (?:that'?s|all) (?:fine|good|ok)|don'?t forget|do not forget"
    r"|don'?t hesitate|don'?t worry|never mind|stop by|no,? (?:that'?s|it'?s) (?:fine|good|great|perfect|ok|okay)|stop (?:and|to) (?:think|explain))"
)
CORRECTION_MOST = 600


def claim(messages: DataFrame, now: float, limit: int = 1) -> DataFrame:
    """The next ``limit`` pending messages of each session, by id, are taken into work.

    The window's rows of a session are the pending ones; ``limit`` is pushed into it, so that a long session is cut in each
    task before it is shuffled.
    """
    place = Window.partitionBy("session").orderBy("id")
    taken = messages.where("status = 'pending'").select("session", "id").withColumn("__k", F.row_number().over(place)).where(F.col("__k") <= limit).select("id", F.lit(True).alias("__taken"))
    taken = messages.join(taken, "id", "left")
    return taken.withColumn("status", F.when(F.col("__taken"), "processing").otherwise(F.col("status"))).withColumn("claimed_at", F.when(F.col("__taken"), F.lit(now)).otherwise(F.col("claimed_at"))).drop("__taken")


def confirm(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Done messages go."""
    return messages.join(ids.select("id"), "id", "left_anti")


def retry(messages: DataFrame, ids: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Messages that didn't work out are pending again with one more retry, or failed after ``most``."""
    back = messages.join(ids.select("id").distinct().withColumn("__back", F.lit(True)), "id", "left")
    more = F.col("retries") + 1
    status = F.when(F.col("__back") & (more >= most), "failed").when(F.col("__back"), "pending").otherwise(F.col("status"))
    return back.withColumn("status", status).withColumn("claimed_at", F.when(F.col("__back"), None).otherwise(F.col("claimed_at"))).withColumn("retries", F.when(F.col("__back"), more).otherwise(F.col("retries"))).drop("__back")


def reset_stale(messages: DataFrame, now: float, lease: float = LEASE) -> DataFrame:
    """What was claimed longer ago than the lease, or nobody knows when, is pending again."""
    late = (F.col("status") == "processing") & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - lease))
    return messages.withColumn("claimed_at", F.when(late, None).otherwise(F.col("claimed_at"))).withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def tail(rows: DataFrame, key: str, cursor: int, page: int) -> tuple[DataFrame, DataFrame]:
    """The next page behind a cursor, and one row with the new cursor and whether more is left."""
    found = rows.where(F.col(key) > cursor).orderBy(key).limit(page + 1)
    now = found.orderBy(key).limit(page)
    return now, now.agg(F.coalesce(F.max(key), F.lit(cursor)).alias("cursor"), F.count("*").alias("n"))


def within_budget(rows: DataFrame, day: str, order: str, cost: str, budget: int) -> DataFrame:
    """Whole buckets (days) in order while their sum fits a budget, the first one in any case: bucket, cost, total.

    Costs are added up by bucket first; the running sum is over one row each.
    """
    each = rows.groupBy(day).agg(F.sum(cost).alias("cost"), F.max(order).alias("last"))
    total = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumn("total", F.sum("cost").over(total)).where((F.col("total") <= budget) | (F.col("total") == F.col("cost")))


def watermarks(episodes: DataFrame, group: str, created: str, valid: str, state: DataFrame) -> DataFrame:
    """What is new for each chain, by time of arrival, so that back-dated episodes count; and its two marks after it.

    ``state``: group, seen (arrival mark), reached (event-time mark). The event-time mark only rises.
    """
    known = episodes.join(state, group, "left")
    new = F.col("seen").isNull() | (F.col(created) > F.col("seen"))
    return known.groupBy(group).agg(
        F.count_if(new).alias("fresh"),
        F.count_if(new & (F.col(valid) < F.col("reached"))).alias("back_dated"),
        F.greatest(F.max("seen"), F.max(created)).alias("seen"),
        F.greatest(F.max("reached"), F.max(F.when(new, F.col(valid)))).alias("reached"),
    )


def is_correction(text: Column, number: Column) -> Column:
    """Whether a prompt (not the first, numbers from 1; not a long one) tells that the work before was wrong."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.coalesce((number >= 2) & (F.length(flat).between(1, CORRECTION_MOST)) & ~flat.rlike(NO_CORRECTION) & (flat.rlike(CORRECTION_START) | flat.rlike(CORRECTION_ANYWHERE)), F.lit(False))


def evidence(calls: DataFrame, turn: list[str], most: int = 20) -> DataFrame:
    """What each turn did: the different files read and changed, commands and searches, in the order of their first call, at
    most ``most`` each, and calls by tool. calls: turn columns, seq, kind (read, edit, shell, search), target, tool.

    Targets are reduced to one row each before a turn's are gathered.
    """
    first = calls.where("target IS NOT NULL").groupBy(*turn, "kind", "target").agg(F.min("seq").alias("seq"))
    listed = lambda kind: F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "target")))), lambda x: x["target"]), 1, most)
    lists = first.groupBy(*turn).agg(listed("read").alias("read"), listed("edit").alias("modified"), listed("shell").alias("commands"), listed("search").alias("searches"))
    return lists.join(calls.groupBy(*turn).agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools")), turn)
