"""Joins that link names: mentions in texts, imports, nearness of paths, other repositories, routes, packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import text as X

#: Labels of more than this many things, or shorter than ``LEAST_LETTERS``, don't link a text to anything.
MOST_HOMONYMS, LEAST_LETTERS = 3, 4
#: Labels too general to link by.
GENERIC = tuple("""self this that data value values result results item items list dict type types name names
string object error errors config client server request response default params param args kwargs test tests
main init index model models util utils helper helpers base core common app user users file files path paths
node nodes edge edges event events state status count total time date info message messages handler handlers
""".split())


def dictionary(labels: DataFrame, general: Sequence[str] = GENERIC) -> DataFrame:
    """label, ids: the labels (label, id) fit to link by, those of ``general`` left out; a label's ids are gathered only up to
    the bound."""
    low = labels.select(F.lower("label").alias("label"), "id").where((F.length("label") >= LEAST_LETTERS) & ~F.col("label").isin(*general) & F.col("label").rlike("^[a-z_][a-z0-9_]*$")).distinct()
    few = low.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_HOMONYMS)
    return low.join(few.select("label"), "label", "left_semi")


def mention_links(texts: DataFrame, labels: DataFrame, key: str, text: str, general: Sequence[str] = GENERIC) -> DataFrame:
    """key, label, id: the things that a text's words name. Words are made different in the row, before they are shuffled."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))).alias("label")).where(F.length("label") >= LEAST_LETTERS)
    return words.join(dictionary(labels, general), "label").select(key, "label", "id")


def imported(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (file, name) x imports (file, name, module) x symbols (module, name, id): the calls with one target only.

    Of a module's name the least and the greatest id say whether there is another one, so that no import meets symbols one by
    one and repeats need not be taken out first.
    """
    targets = symbols.groupBy("module", "name").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    known = imports.select("file", "name", "module").join(targets, ["module", "name"]).groupBy("file", "name").agg(F.min("least").alias("id"), F.max("most").alias("most"))
    return known.where(F.col("id") == F.col("most")).join(calls.select("file", "name"), ["file", "name"], "left_semi").select("file", "name", "id")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def shared_parts(a: Column, b: Column) -> Column:
    """How many first parts two folders have in common."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    upto = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.slice(x, 1, k) == F.slice(y, 1, k)))
    return F.when((a == "") | (b == ""), 0).otherwise(F.size(upto))


def nearest(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """call, id: for calls (call, file, name) the declaration (id, file, name) that lies nearest: in the same file, else the
    same folder, else with the longest shared path, of more than nothing. Where the best of these is not alone, none.

    Declarations are counted for each file, folder and beginning of a folder; a call looks up its own ones. So no call meets
    its candidates one by one, and work grows with calls and declarations, not with their pairs.
    """
    there = declared.where("file IS NOT NULL").select("name", "id", F.explode(_levels(F.col("file"))).alias("at"))
    counted = there.groupBy("name", "at").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    here = calls.where("file IS NOT NULL").select("file", "name").distinct().withColumn("at", F.explode(_levels(F.col("file"))))
    best = here.join(counted, ["name", "at"]).groupBy("file", "name").agg(F.max(F.struct(F.col("at.level").alias("tier"), "k", "id")).alias("b"))
    found = calls.select("call", "file", "name").join(best, ["file", "name"]).select("call", "b.*")
    top = found.groupBy("call").agg(F.max("tier").alias("tier"))
    return found.join(top, ["call", "tier"]).groupBy("call").agg(F.sum("k").alias("k"), F.min("id").alias("id")).where("k = 1").select("call", "id")


def _levels(file: Column) -> Column:
    """(level, place) of a file: itself, its folder, and the beginnings of its folder by their number of parts."""
    at = folder(file)
    parts = F.split(at, "/")
    level = lambda n, place: F.struct(n.cast("int").alias("level"), place.alias("place"))
    begins = F.when(at == "", F.array().cast("array<struct<level:int,place:string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: level(k, F.array_join(F.slice(parts, 1, k), "/"))))
    return F.concat(F.array(level(F.lit(1_000_001), file), level(F.lit(1_000_000), at)), begins)


def across(calls: DataFrame, declared: DataFrame, on: Sequence[str]) -> DataFrame:
    """Calls (repo, call, ...) x declarations (repo, id, ...) of other repositories on equal columns, where one fits."""
    # One id fits if the least and the greatest of all others' are one; both are taken of each repository before any call.
    d = declared.groupBy(*on, F.col("repo").alias("other")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    seen = calls.select("repo", *on).distinct().join(d, list(on)).where("repo <> other").groupBy("repo", *on).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hit = calls.select("repo", "call", *on).join(seen, ["repo", *on]).groupBy("repo", "call").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return hit.where("lo = hi").select("repo", "call", F.col("lo").alias("id"))


def shared_declarations(declared: DataFrame, on: Sequence[str]) -> DataFrame:
    """The columns ``on`` that several repositories declare alike, with the repositories."""
    return declared.groupBy(*on).agg(F.sort_array(F.collect_set("repo")).alias("repos")).where(F.size("repos") > 1)


def route_key(path: Column) -> Column:
    """A path with its parameters ({id}, :id, <id>, numbers) as one sign, without a last slash or a query."""
    bare = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "(?<=.)/$", "")
    return F.regexp_replace(F.lower(bare), "/(\\{[^/}]*\\}|:[^/]+|<[^/>]*>|[0-9]+)(?=/|$)", "/{}")


def suffix_join(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call, route: the routes (route, path) that a call's path (call, path) is the end of, by whole parts. Each route is
    laid out with all its ends, one row a part, so that this is a join on equal values."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    laid = routes.select("route", F.explode(F.array_distinct(ends)).alias("end"))
    return calls.join(laid, F.concat(F.lit("/"), F.array_join(F.filter(F.split(calls["path"], "/"), lambda x: x != ""), "/")) == laid["end"]).select("call", "route")


def consumers(uses: DataFrame, provides: DataFrame, on: str) -> DataFrame:
    """consumer, provider, n: who uses what another provides; uses and provides: repo and the column ``on``."""
    u, p = uses.select(on, F.col("repo").alias("consumer")).distinct(), provides.select(on, F.col("repo").alias("provider")).distinct()
    return u.join(p, on).where("consumer <> provider").groupBy("consumer", "provider").agg(F.count("*").alias("n"))


def token_overlap(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, n: how many of a query's words a text has."""
    wanted = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(w) > 1})
    n = F.size(F.array_intersect(X.words(F.col(text)), F.array(*[F.lit(w) for w in wanted])))
    return rows.select(key, n.alias("n")).where("n > 0")


def best_in_group(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)
