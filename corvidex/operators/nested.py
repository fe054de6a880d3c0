"""Strings within JSON values, masked where they stand.

A value is cut into its strings, its brackets and what is between them. Windows over the pieces of a value, in order, give
each string its depth and the name that it stands under: its own, or that of the nearest list around it that has one.
Pieces of a value stay together; values are spread over all tasks. Strings are masked in one place, outside of any nesting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import secrets

#: Depth of values that is looked into; what lies deeper stays as it is.
DEPTH = 12
_PIECE = r'"[^"]*"|[\[\]{}]|[^"\[\]{}]+'
# Escaped backslashes and quotes are one sign each while a value is in pieces; JSON has neither sign as such.
_SLASH, _QUOTE = "\x01", "\x02"


def _folded(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _unfolded(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def redact(rows: DataFrame, key: str, value: str, masked: Callable[[Column], Column] = secrets.redact, by_key: bool = True) -> DataFrame:
    """key, value: each JSON text of ``rows`` (``key`` is unique) with its strings masked and all else as it was.

    A string under a name that looks like a credential's goes whole. ``by_key=False`` is the mode for prose: names aren't
    looked at. Null stays null; a string outside of any object or list is masked too.
    """
    pieces = rows.select(F.col(key).alias("__key"), F.posexplode_outer(F.regexp_extract_all(_folded(F.col(value)), F.lit(_PIECE), F.lit(0))).alias("__at", "__piece"))
    piece, order = F.col("__piece"), Window.partitionBy("__key").orderBy("__at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = piece.isin("{", "[")
    marks = pieces.select(
        "*",
        F.lag(piece, 1).over(order).alias("__before"),
        F.lag(piece, 2).over(order).alias("__name"),
        F.lead(piece, 1).over(order).alias("__behind"),
        F.coalesce(F.sum(F.when(opens, 1).when(piece.isin("}", "]"), -1).otherwise(0)).over(before), F.lit(0)).alias("__depth"),
    )
    own = F.when(F.rtrim("__before").endswith(":"), F.regexp_replace("__name", '^"|"$', ""))
    named = marks.withColumn("__own", own)
    # Of each level the name of the container that was opened last; those above a string are around it.
    around = [F.last(F.when(opens & (F.col("__depth") == level), F.struct("__own")), ignorenulls=True).over(before)["__own"] for level in range(DEPTH)]
    named = named.withColumn("__under", F.coalesce("__own", *[F.when(F.col("__depth") > level, around[level]) for level in reversed(range(DEPTH))]))
    is_text = piece.startswith('"') & ~F.coalesce(F.ltrim("__behind").startswith(":"), F.lit(False)) & (F.col("__depth") <= DEPTH)
    text = F.get_json_object(F.concat(F.lit("["), _unfolded(piece), F.lit("]")), "$[0]")
    plain = named.withColumn("__text", F.when(is_text, text))
    whole = F.col("__under").rlike(secrets.SENSITIVE) & secrets.value_is_secret(F.col("__text"), F.lit(True)) if by_key else F.lit(False)
    shown = plain.withColumn("__shown", F.when(F.col("__text").isNull(), None).when(F.coalesce(whole, F.lit(False)), secrets.MASK).otherwise(masked(F.col("__text"))))
    quoted = F.to_json(F.array("__shown"))
    out = F.when(F.col("__shown") != F.col("__text"), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(_unfolded(piece))
    joined = shown.select("__key", "__at", out.alias("__out")).groupBy("__key").agg(F.sort_array(F.collect_list(F.when(F.col("__out").isNotNull(), F.struct("__at", "__out")))).alias("__all"))
    return joined.select(F.col("__key").alias(key), F.when(F.size("__all") > 0, F.array_join(F.transform("__all", lambda x: x["__out"]), "")).alias(value))
