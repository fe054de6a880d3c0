"""Resolution of extracted names and facts against what is known, and duplicates within a batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.operators.graph import components
from corvidex.sources.tables import spread, written

LEAST_ENTROPY, LEAST_JACCARD, LEAST_LENGTH, LEAST_WORDS = 1.5, 0.9, 6, 2
#: New and known facts of one end that are scored at once.
NEW_AT_ONCE, FACTS_AT_ONCE = 256, 4096


def exact_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "\\s+", " "))


def fuzzy_key(name: Column) -> Column:
    """Letters a to z, digits and apostrophes; the rest as single blanks."""
    return F.regexp_replace(F.trim(F.regexp_replace(exact_key(name), "[^a-z0-9' ]", " ")), " +", " ")


def telling(key: Column) -> Column:
    """Whether a fuzzy key says enough: long enough or of several words, and of enough entropy without its blanks."""
    long = (F.length(key) >= LEAST_LENGTH) | (F.size(F.split(key, " ")) >= LEAST_WORDS)
    return long & (X.entropy(F.replace(key, F.lit(" "), F.lit(""))) >= LEAST_ENTROPY)


def grams(key: Column) -> Column:
    """Three-letter runs without blanks; of a shorter key the key."""
    bare = F.replace(key, F.lit(" "), F.lit(""))
    n = F.length(bare)
    return F.when(n < 3, F.array(bare)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(bare, i, F.lit(3)))))


def _marks(rows: DataFrame, key: str) -> DataFrame:
    """key, mark: two sets of runs with a Jaccard of ``LEAST_JACCARD`` or more share a mark.

    Sizes are in classes that grow by the inverse of that bound, so those of such a pair are in one class or two neighbouring
    ones, and a set has the marks of its own class and of the next. The least Jaccard bounds in how many runs two sets of a
    class differ, d. All runs are dealt into d + 2 parts by a hash: two parts at least are the same in both, and are a mark.
    """
    base = 1 / LEAST_JACCARD + 1e-6
    own = F.floor(F.log(F.size("grams").cast("double")) / math.log(base))
    classed = spread(rows).select(key, F.array_sort(F.transform("grams", lambda g: F.xxhash64(g))).alias("h"), F.explode(F.array(own, own + 1)).alias("c"))
    differ = F.floor((1 - LEAST_JACCARD) / (1 + LEAST_JACCARD) * 2 * F.ceil(F.pow(F.lit(base), F.col("c") + 1)) + 1e-9)
    first = classed.withColumn("n", differ + 2).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)))
    each = first.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)))
    part = lambda p: F.filter("h", lambda x: F.pmod(x, F.col("n")) == F.col(p))
    return each.select(key, F.xxhash64("c", "i", "j", part("i"), part("j")).alias("mark"))


def candidates(new: DataFrame, known: DataFrame) -> DataFrame:
    """id, known_id, jaccard of names that may be alike: those that share a mark, exact, without a cross join. Names with the
    same runs are one; of known ones the least id is given, which is the one that ties go to."""
    a = written(new.select("id", F.array_sort("grams").alias("grams")), "names")
    b = written(known.groupBy(F.array_sort("grams").alias("other")).agg(F.min("id").alias("known_id")), "names")
    asked = written(a.groupBy("grams").agg(F.min("id").alias("first")), "names")
    pairs = _marks(asked, "first").join(_marks(b.withColumnRenamed("other", "grams"), "known_id"), "mark").select("first", "known_id").distinct()
    both = pairs.join(asked, "first").join(b, "known_id")
    scored = both.select("grams", "known_id", X.jaccard(F.col("grams"), F.col("other")).alias("jaccard")).where(F.col("jaccard") >= LEAST_JACCARD)
    return a.join(scored, "grams").select("id", "known_id", "jaccard")


def resolve_names(new: DataFrame, known: DataFrame) -> DataFrame:
    """id, known_id, how for each new name (id, name): exact (one known name is equal), ambiguous (several are), fuzzy (the
    most alike known name from 0.9 on, ties to the least id) or unresolved."""
    k = known.select(exact_key(F.col("name")).alias("key"), "id")
    equal = k.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    placed = new.select("id", "name", exact_key(F.col("name")).alias("key"), fuzzy_key(F.col("name")).alias("fuzzy")).join(equal, "key", "left")
    open_ = placed.where(F.col("n").isNull() & telling(F.col("fuzzy"))).select("id", grams(F.col("fuzzy")).alias("grams"))
    pool = known.select("id", grams(fuzzy_key(F.col("name"))).alias("grams"))
    best = candidates(open_, pool).groupBy("id").agg(F.max(F.struct("jaccard", -F.col("known_id"))).alias("m")).select("id", (-F.col("m.col2")).alias("near"))
    how = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("near").isNotNull(), "fuzzy").otherwise("unresolved")
    out = placed.join(best, "id", "left").withColumn("how", how)
    return out.select("id", F.when(F.col("how") == "exact", F.col("only")).when(F.col("how") == "fuzzy", F.col("near")).alias("known_id"), "how")


def alias_map(pairs: DataFrame) -> DataFrame:
    """alias, canonical: chains of directed pairs (alias, canonical) followed to their ends, by doubling. The first target
    by value counts where an alias has several; what runs in a circle keeps its own id."""
    step = pairs.where("alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    now = written(step, "alias")
    for _ in range(max(1, now.count()).bit_length()):
        on = now.select(F.col("alias").alias("canonical"), F.col("canonical").alias("next"))
        further = written(now.join(on, "canonical", "left").select("alias", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")), "alias")
        moved = not further.where("moved").isEmpty()
        now = further.select("alias", "canonical")
        if not moved:
            break
    circle = now.select(F.col("alias").alias("canonical")).distinct().withColumn("open", F.lit(True))
    return now.join(circle, "canonical", "left").select("alias", F.when(F.col("open"), F.col("alias")).otherwise(F.col("canonical")).alias("canonical"))


def compressed(pairs: DataFrame) -> DataFrame:
    """id, canonical: the least id of everything that pairs (a, b) join."""
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "canonical")


def first_facts(edges: DataFrame, order: str) -> DataFrame:
    """Extracted facts (src, dst, fact, ...), the first of those with one pair of ends and equal words."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    kept = edges.groupBy("src", "dst", exact_key(F.col("fact")).alias("__fact")).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return kept.select("src", "dst", *[F.col("__row")[c].alias(c) for c in rest])


def batch_facts(edges: DataFrame) -> DataFrame:
    """id, canonical of the facts (id, src, dst, fact) of a batch that say the same of the same ends: two are compared if
    they share a word, by the rule of ``same_fact``; the least id stands for all.

    Equal texts of a pair of ends are one before words are exploded, so that repeats give no pairs.
    """
    keyed = edges.select("id", "src", "dst", exact_key(F.col("fact")).alias("fact"))
    once = written(keyed.groupBy("src", "dst", "fact").agg(F.min("id").alias("first")), "facts")
    words = once.select("src", "dst", "first", "fact", F.explode(F.array_distinct(X.words(F.col("fact")))).alias("word"))
    a, b = words.alias("a"), words.alias("b")
    on = (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.first") < F.col("b.first"))
    pairs = a.join(b, on).select(F.col("a.first").alias("a"), F.col("b.first").alias("b"), F.col("a.fact").alias("x"), F.col("b.fact").alias("y")).distinct()
    same = pairs.where(X.same_fact(F.col("x"), F.col("y"))).select("a", "b")
    named = compressed(same).withColumnRenamed("id", "first")
    mine = keyed.join(once, ["src", "dst", "fact"]).join(named, "first", "left")
    return mine.select("id", F.coalesce("canonical", "first").alias("canonical"))


def collapsed(nodes: DataFrame, message: str) -> DataFrame:
    """The nodes (id, name) of one message with the same name, as the least id: id, canonical."""
    key = nodes.groupBy(message, exact_key(F.col("name")).alias("key")).agg(F.min("id").alias("canonical"))
    return nodes.select("id", message, exact_key(F.col("name")).alias("key")).join(key, [message, "key"]).select("id", "canonical")


def survivors(nodes: DataFrame) -> DataFrame:
    """Of the records of one id (id, label, path, defines): one that defines it, on a path that isn't archived, of the
    shortest label, by label, then by the path read from its end."""
    archived = F.lower("path").rlike("(^|/)(archive|archived|done|old|deprecated|legacy)(/|$)")
    rank = F.struct(~F.col("defines"), archived, F.length("label"), "label", F.reverse(F.split("path", "/")))
    return nodes.groupBy("id").agg(F.min_by(F.struct("label", "path"), rank).alias("r")).select("id", "r.label", "r.path")


def _ends(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, end, v, dims of facts with a whole vector, a row for each end; vectors of other lengths have no cosine."""
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col("id").alias(key), F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dims")).where("end IS NOT NULL")


def _best_of_block(a: np.ndarray, b: np.ndarray, same: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and cosine of the ``most`` best columns of each row above ``least``, ties to the first; sums go one number
    after the other, as ``X.cosine`` adds them."""
    dot, sizes = np.zeros((len(a), len(b))), []
    for i in range(a.shape[1]):
        dot += a[:, i, None] * b[None, :, i]
    for m in (a, b):
        square = np.zeros(len(m))
        for i in range(m.shape[1]):
            square += m[:, i] * m[:, i]
        sizes.append(np.sqrt(square))
    size = sizes[0][:, None] * sizes[1][None, :]
    score = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
    score[same] = -np.inf
    if len(b) > most:
        bar = np.partition(score, len(b) - most, axis=1)[:, len(b) - most, None]
        above, at = score > bar, score == bar
        kept = above | (at & (at.cumsum(axis=1) <= most - above.sum(axis=1, keepdims=True)))
    else:
        kept = np.ones(score.shape, bool)
    row, column = np.nonzero(kept & (score > least))
    return row, column, score[row, column]


def invalidation_candidates(new: DataFrame, facts: DataFrame, vector: str, least: float, most: int) -> DataFrame:
    """id, fact_id, score: for each new fact (id, src, dst, vector) the ``most`` known facts that touch either of its ends
    with a cosine above ``least``.

    The facts of an end are cut into blocks by a hash, and so are the new ones; a task scores a block against a block and
    hands on the best of each new fact. No pair is a row before that, and a block doesn't grow with an end.
    """
    a, b = _ends(new, "id", vector), _ends(facts, "fact_id", vector)
    count = lambda rows, at_once, name: rows.groupBy("end", "dims").agg(F.ceil(F.count("*") / at_once).cast("int").alias(name))
    sizes = count(a, NEW_AT_ONCE, "n").join(count(b, FACTS_AT_ONCE, "m"), ["end", "dims"])
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, at = ["end", "dims", "i", "j"], sizes.hint("merge")
    left = a.join(at, ["end", "dims"]).select("id", "v", "end", "dims", own("id", "n").alias("i"), every("m").alias("j"))
    right = b.join(at, ["end", "dims"]).select("fact_id", "v", "end", "dims", own("fact_id", "m").alias("j"), every("n").alias("i"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id": x["id"][:0], "fact_id": y["fact_id"][:0], "score": np.zeros(0)})
        y = y.sort_values("fact_id")
        ids, others = x["id"].to_numpy(), y["fact_id"].to_numpy()
        row, column, score = _best_of_block(np.stack(x["v"].to_list()), np.stack(y["v"].to_list()), ids[:, None] == others[None, :], least, most)
        return pd.DataFrame({"id": ids[row], "fact_id": others[column], "score": score})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"id {kind(a, 'id')}, fact_id {kind(b, 'fact_id')}, score double").distinct()  # a pair may share two ends
    place = Window.partitionBy("id").orderBy(F.desc("score"), "fact_id")
    return scored.withColumn("k", F.row_number().over(place)).where(F.col("k") <= most).select("id", "fact_id", "score")


def merged_graphs(parts: list[DataFrame], key: str) -> DataFrame:
    """Fragments of a graph as one table: of rows with one key the last fragment's counts."""
    every = None
    for place, rows in enumerate(parts):
        numbered = rows.withColumn("__place", F.lit(place))
        every = numbered if every is None else every.unionByName(numbered, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "__place")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "__place").alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in rest])

