"""Patterns in the order of a turn's calls: a failure, a change, and the success of the same call.

Turns may be long: they are cut into stretches of their sequence numbers. Windows run within a stretch, and what a stretch
needs of the others (how many edits came before it, the first success after it) is worked out from one row a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in a stretch.
STRETCH = 10_000


def error_fixes(calls: DataFrame, turn: Sequence[str], stretch: int = STRETCH) -> DataFrame:
    """turn, seq, signature, fixed_by, edits, changed: failures that a later call of the same signature made good, after an
    edit that worked in between or with another target. A plain repeat that works fixes nothing.

    calls: turn columns, seq (unique in a turn), signature, target, failed, worked, edit. ``fixed_by`` is the next such call
    that worked; ``edits`` counts the edits with a target that worked strictly between; ``changed`` is whether the target
    differs. Nulls in flags are false, a null target differs from any other; calls without a seq are left out.
    """
    turn = list(turn)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = calls.where("seq IS NOT NULL").select(*turn, "seq", "signature", "target", flag("failed").alias("failed"), flag("worked").alias("worked"), F.floor(F.col("seq") / stretch).alias("part"), F.when(flag("edit") & flag("worked") & F.col("target").isNotNull(), 1).otherwise(0).alias("edited"))
    rows = _running(rows, turn)
    success = F.when(F.col("worked"), F.struct("seq", "target", "edits_to"))
    here = Window.partitionBy(*turn, "signature", "part").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("next", F.first(success, ignorenulls=True).over(here))
    # Of each stretch the first success; what lies behind a stretch is looked up by stretch.
    ends = rows.groupBy(*turn, "signature", "part").agg(F.min_by(success, F.when(F.col("worked"), F.col("seq"))).alias("own"))
    behind = Window.partitionBy(*turn, "signature").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    later = ends.select(*turn, "signature", "part", F.first("own", ignorenulls=True).over(behind).alias("later"))
    failures = near.where("failed")
    on = F.lit(True)
    for c in [*turn, "signature", "part"]:
        on = on & F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}"))
    found = failures.alias("f").join(later.alias("l"), on, "left").select("f.*", F.coalesce("f.next", "l.later").alias("fix")).where("fix IS NOT NULL")
    # An edit that is the success itself doesn't count, nor does one that is the failure.
    edits = F.col("fix.edits_to") - F.col("edits_to")
    out = found.select(*turn, "seq", "signature", F.col("fix.seq").alias("fixed_by"), "target", F.col("fix.target").alias("__target"), edits.alias("__edits"), F.col("fix.seq").alias("__at"))
    changed = ~F.col("target").eqNullSafe(F.col("__target")) | F.col("target").isNull()
    return out.select(*turn, "seq", "signature", "fixed_by", F.col("__edits").cast("long").alias("edits"), changed.alias("changed")).where("edits > 0 OR changed")


def _running(rows: DataFrame, turn: list[str]) -> DataFrame:
    """``rows`` with edits_to: the edits of a turn before a row, its own not counted; a failure's own edit has failed anyway."""
    own = Window.partitionBy(*turn, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*turn).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*turn, "part").agg(F.sum("edited").alias("n")).select(*turn, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    on = F.lit(True)
    for c in [*turn, "part"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    local = rows.withColumn("local", F.coalesce(F.sum("edited").over(own), F.lit(0)))
    return local.alias("r").join(sums.alias("s"), on).select("r.*", (F.col("local") + F.col("s.n")).alias("edits_to")).drop("local")
