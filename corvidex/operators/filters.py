"""Filter languages compiled to Columns, so that Catalyst can push them down.

Payload filters: a dict is the AND of its clauses. A clause is a value (equals), a list (one of), ``"*"`` (present) or a
dict of operators; ``$and``, ``$or`` and ``$not`` hold lists of filters. A missing or null field satisfies ``ne`` and
``nin`` and nothing else, which is not SQL's three-valued logic: every leaf is made two-valued.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, Column], Column]] = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
SQL_COMPARE = COMPARE | {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def every(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def some(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _leaf(op: str, have: Column, want: Any) -> Column:
    if op == "ne":
        return F.coalesce(have != F.lit(want), F.lit(True))
    if op == "nin":
        return F.coalesce(~have.isin(*want), F.lit(True)) if want else F.lit(True)
    if op == "eq":
        made = have == F.lit(want)
    elif op == "in":
        made = have.isin(*want) if want else F.lit(False)
    elif op == "contains":
        made = have.cast("string").contains(str(want))
    elif op == "icontains":
        made = F.lower(have.cast("string")).contains(str(want).lower())
    elif op in COMPARE:
        # A number compares with whatever reads as one.
        made = COMPARE[op](have.try_cast("double"), F.lit(float(want))) if isinstance(want, (int, float)) else COMPARE[op](have, F.lit(want))
    else:
        raise ValueError(f"no such operator: {op}")
    return F.coalesce(made, F.lit(False))


def payload(spec: Mapping[str, Any] | None, field: Callable[[str], Column] = F.col) -> Column:
    """A payload filter as a Column that is never null."""
    parts = []
    for key, want in (spec or {}).items():
        if key == "$and":
            parts.append(every([payload(x, field) for x in want]))
        elif key == "$or":
            parts.append(some([payload(x, field) for x in want]))
        elif key == "$not":
            parts.append(~some([payload(x, field) for x in want]))
        elif want == "*":
            parts.append(field(key).isNotNull())
        elif isinstance(want, Mapping):
            parts.append(every([_leaf(op, field(key), x) for op, x in want.items()]))
        elif isinstance(want, (list, tuple, set)):
            parts.append(_leaf("in", field(key), list(want)))
        else:
            parts.append(_leaf("eq", field(key), want))
    return every(parts)


def normalise(spec: Mapping[str, Any]) -> dict[str, Any]:
    """AND / OR / NOT of the user's form to the stored one; clauses on one key are merged."""
    out: dict[str, Any] = {}
    for key, want in spec.items():
        low = key.lower().lstrip("$")
        if low in ("and", "or", "not") and isinstance(want, (list, tuple)):
            out.setdefault(f"${low}", []).extend(normalise(x) for x in want)
        elif isinstance(want, Mapping) and isinstance(out.get(key), dict):
            out[key] = {**out[key], **want}
        else:
            out[key] = dict(want) if isinstance(want, Mapping) else want
    return out


def date_dnf(column: str, groups: Sequence[Sequence[tuple[str, Any]]]) -> Column:
    """OR of ANDs of comparisons with a time; ``IS NULL`` and ``IS NOT NULL`` need none."""
    at = F.col(column)

    def one(op: str, want: Any) -> Column:
        if op == "IS NULL":
            return at.isNull()
        if op == "IS NOT NULL":
            return at.isNotNull()
        return F.coalesce(SQL_COMPARE[op](at, F.lit(want).cast("timestamp_ntz")), F.lit(False))

    return some([every([one(*x) for x in group]) for group in groups])


def valid_at(when: Column, start: str = "valid_at", end: str = "invalid_at") -> Column:
    """Half-open validity: from ``start``, before ``end`` or without one."""
    return (F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when))


def current(end: str = "invalid_at", expired: str = "expired_at") -> Column:
    return F.col(end).isNull() & F.col(expired).isNull()


def any_label(column: str, labels: Sequence[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, labels)))


def substring_any(text: str, columns: Sequence[str]) -> Column:
    """The text as it is, wildcards included, in any of the columns."""
    return some([F.coalesce(F.col(c).contains(text), F.lit(False)) for c in columns])


def direct_child(path: str, folder: str) -> Column:
    """Files right below a folder."""
    base = folder.rstrip("/") + "/"
    return F.startswith(path, F.lit(base)) & ~F.substring(F.col(path), len(base) + 1, 1 << 30).contains("/") & (F.length(path) > len(base))


def in_repo(path: str) -> Column:
    """Relative, without climbing and without a drive letter."""
    return ~F.col(path).rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)") & (F.col(path) != "")


def workflow_predicate(text: str) -> Column:
    """A condition as workflows write it, {{ a == "x" and not (b in [1, 2]) }}, as a Column: its operators are put in SQL's
    spelling and Spark reads it. Text within quotes stays as it is."""
    body = re.sub(r"^\s*\{\{|\}\}\s*$", "", text).strip()
    parts = re.split(r"(\"[^\"]*\"|'[^']*')", body)
    for i, part in enumerate(parts):
        if i % 2:
            parts[i] = "'" + part[1:-1].replace("'", "''") + "'"
        else:
            part = re.sub(r"\[", "(", re.sub(r"\]", ")", part.replace("==", "=")))
            parts[i] = re.sub(r"\|\s*default\(", "?? (", part)
    sql = "".join(parts)
    sql = re.sub(r"(\w+)\s*\?\?\s*(\([^()]*\))", r"coalesce(\1, \2)", sql)
    return F.expr(sql)
