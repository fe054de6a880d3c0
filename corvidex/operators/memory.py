"""The life of a memory: superseding, forgetting, ageing, scopes, expiry, reconciliation, and the feed of changes.

memories: id, text, kind, created_at (seconds), forgotten, superseded_by. Nothing is updated in place: each step returns
the new table, which the caller writes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.sources.tables import written

#: The keys that a scope may name.
SCOPES = ("project_id", "team_id", "user_id", "agent_id", "run_id")
DAY = 86_400
STALE_DAYS, STALE_FACTOR = 90, 0.6


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and ``new`` memories; what a new one names in ``supersedes`` points to it, the greatest id if several do."""
    every = old.withColumn("supersedes", F.lit(None).cast(new.schema["supersedes"].dataType)).unionByName(new)
    by = new.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.max("id").alias("__by"))
    return every.join(by, "id", "left").withColumn("superseded_by", F.coalesce("__by", "superseded_by")).drop("__by", "supersedes")


def active() -> Column:
    return (F.col("forgotten") == 0) & F.col("superseded_by").isNull()


def forget(memories: DataFrame, ids: DataFrame, *mentions: DataFrame) -> tuple[DataFrame, ...]:
    """The memories with those of ``ids`` (id) flagged; each of ``mentions`` (events, links, index rows: memory_id) without them."""
    gone = ids.select(F.col("id")).distinct()
    flagged = memories.join(gone.withColumn("__gone", F.lit(1)), "id", "left").withColumn("forgotten", F.coalesce("__gone", "forgotten")).drop("__gone")
    return (flagged, *[rows.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti") for rows in mentions])


def chains(memories: DataFrame) -> DataFrame:
    """id, head (the newest memory of its chain), steps to it: pointers are doubled, so a chain of n takes log2(n) joins.

    What runs into a circle has a null head: its pointers never end, and after as many doublings as ids need it stops.
    """
    now = written(memories.select("id", F.coalesce("superseded_by", "id").alias("to"), F.col("superseded_by").isNotNull().cast("long").alias("steps")), "chain")
    rounds = max(1, now.count()).bit_length()
    for _ in range(rounds):
        on = now.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        moved = now.join(on, "to", "left").select("id", F.coalesce("__to", "to").alias("to"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"))
        moved = written(moved, "chain")
        if moved.agg(F.sum("steps")).first() == now.agg(F.sum("steps")).first():
            return moved.select("id", F.col("to").alias("head"), "steps")
        now = moved
    ends = now.where("steps = 0").select(F.col("id").alias("to"))
    return now.join(ends.withColumn("__end", F.lit(True)), "to", "left").select("id", F.when(F.col("__end"), F.col("to")).alias("head"), F.when(F.col("__end"), F.col("steps")).alias("steps"))


def history(memories: DataFrame, id) -> DataFrame:
    """The whole chain that a memory is in, newest first: place 0 is the head."""
    c = chains(memories)
    mine = c.where(F.col("id") == F.lit(id)).select("head")
    return c.join(F.broadcast(mine), "head", "left_semi").join(memories, "id").withColumnRenamed("steps", "place")  # one head


def aged(memories: DataFrame, uses: DataFrame, now: float, since: float = 0.0, days: float = STALE_DAYS, pinned: Sequence[str] = ()) -> DataFrame:
    """``memories`` with last_used, uses and stale. ``uses``: memory_id, ts (seconds), one row for each use.

    The clock of a memory starts at the latest of its last use, its creation and ``since``.
    """
    used = uses.groupBy(F.col("memory_id").alias("id")).agg(F.max("ts").alias("last_used"), F.count("*").alias("uses"))
    at = F.greatest(F.coalesce("last_used", F.lit(0.0)), F.lit(since), F.coalesce("created_at", F.lit(0.0)))
    stale = ~F.coalesce("kind", F.lit("")).isin(*pinned) & (F.lit(now) - at > days * DAY) & F.lit(days > 0)
    return memories.join(used, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("stale", stale)


def fresh_first(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Stale rows after the rest, each part in ``order``."""
    return rows.orderBy("stale", *order)


def about(memories: DataFrame, links: DataFrame, words: Sequence[str], kinds: Sequence[str], limit: int = 6) -> DataFrame:
    """Active memories that ``links`` (id) name or whose text has one of ``words`` as a whole word: fresh before stale, by
    the order of ``kinds``, newest first."""
    pattern = "(?i)\\b(" + "|".join(_quoted(w) for w in words if len(w) >= 4) + ")\\b"
    named = memories.join(links.select("id").distinct().withColumn("__linked", F.lit(True)), "id", "left")
    hit = F.col("__linked") | F.col("text").rlike(pattern) if any(len(w) >= 4 for w in words) else F.col("__linked")
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0))
    ranked = named.where(active() & hit).withColumn("__kind", F.when(place == 0, 10).otherwise(place))
    return fresh_first(ranked, "__kind", F.desc("created_at"), "id").limit(limit).drop("__kind", "__linked")


def _quoted(word: str) -> str:
    """A word as a Java pattern that means itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def recall(lists: Sequence[DataFrame], memories: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """id, score: ranked lists (id, rank from 0) fused by 1 / (constant + rank), stale ones times ``STALE_FACTOR``; only
    active memories. ``memories``: with stale, as ``aged`` gives them."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score"))
    rows = fused.join(memories.where(active()).select("id", "stale"), "id")
    return rows.select("id", (F.col("score") * F.when(F.col("stale"), STALE_FACTOR).otherwise(1.0)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def scoped(rows: DataFrame, extra: Mapping[str, object] | None = None, **scope: str | None) -> DataFrame:
    """The rows of a scope. At least one of ``SCOPES``, trimmed, not blank; ``extra`` conditions can't name another one."""
    given = {}
    for k, v in scope.items():
        if k not in SCOPES:
            raise ValueError(f"{k} is not a scope")
        if v is None:
            continue
        v = str(v).strip()
        if not v or any(c.isspace() for c in v):
            raise ValueError(f"{k} is blank or holds white space")
        given[k] = v
    if not given:
        raise ValueError("at least one of " + ", ".join(SCOPES) + " is needed")
    for k, v in {**(extra or {}), **given}.items():  # a scope wins over extra conditions
        rows = rows.where(F.col(k).cast("string") == F.lit(v))
    return rows


def unexpired(expires: Column, today: Column | None = None) -> Column:
    """Whether a payload's date (text, YYYY-MM-DD) isn't before today; none or an odd one never expires."""
    day = F.when(expires.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(expires, F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(day >= (F.current_date() if today is None else today), F.lit(True))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The feed between two states: key, event (ADD, UPDATE, DELETE), old_value, new_value; unchanged rows give none."""
    a, b = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("__a")), new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("__b"))
    both = a.join(b, key, "full")
    event = F.when(F.col("__a").isNull(), "ADD").when(F.col("__b").isNull(), "DELETE").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "UPDATE")
    return both.withColumn("event", event).where("event IS NOT NULL").select(key, "event", "old_value", "new_value")


def delete_scope(rows: DataFrame, key: str, value: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the feed of what went. A null condition deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.where(~gone), rows.where(gone).select(key, F.lit("DELETE").alias("event"), F.col(value).alias("old_value"), F.lit(None).cast("string").alias("new_value"))


def reconcile(old: DataFrame, new: DataFrame, key: str, same: float = 0.6, related: float = 0.5) -> DataFrame:
    """What each new text does to the old ones of its ``key``: id, event and old_id.

    NONE where an old text says the same (equal words or Jaccard of at least ``same``), UPDATE of the old text with the
    greatest overlap (shared over the lesser number of content words) from ``related`` on, else ADD. Ties go to the least
    old id. Pairs are those of one key only.
    """
    # Texts of a key with the same words score alike: they are one before pairs are made.
    w = lambda df: df.select("id", key, F.array_sort(F.array_distinct(X.words(F.col("text")))).alias("w"))
    asked = w(new)
    a, b = asked.select(key, "w").distinct(), w(old).groupBy(key, F.col("w").alias("v")).agg(F.min("id").alias("old_id"))
    pairs = a.join(b.hint("merge"), key, "left")
    j, o = X.jaccard(F.col("w"), F.col("v")), X.overlap(X.content(F.col("w")), X.content(F.col("v")))
    scored = pairs.withColumn("__same", F.coalesce(j, F.lit(-1.0))).withColumn("__near", F.coalesce(o, F.lit(-1.0)))
    score = lambda c: F.struct(F.col(c), -F.col("old_id"))
    best = scored.groupBy(key, "w").agg(F.max_by("old_id", score("__same")).alias("s"), F.max("__same").alias("js"), F.max_by("old_id", score("__near")).alias("o"), F.max("__near").alias("no"))
    named = best.withColumnsRenamed({key: "__key", "w": "__w"})
    each = asked.join(named.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & F.col("w").eqNullSafe(F.col("__w"))).groupBy("id").agg(F.max_by("s", F.struct("js", -F.col("s"))).alias("s"), F.max("js").alias("js"), F.max_by("o", F.struct("no", -F.col("o"))).alias("o"), F.max("no").alias("no"))
    event = F.when(F.col("js") >= same, "NONE").when(F.col("no") >= related, "UPDATE").otherwise("ADD")
    return each.select("id", event.alias("event"), F.when(event == "NONE", F.col("s")).when(event == "UPDATE", F.col("o")).alias("old_id"))
