"""Entity resolution over labels: shingles, MinHash bands, similarity with guards, components, rewiring."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.operators.graph import components
from corvidex.sources.tables import checkpointed

PERMUTATIONS, ROWS = 32, 4
MIN_ENTROPY, MIN_SIMILARITY = 2.5, 0.92
#: Words whose change restates a label, labels that count as short, and a short label's stem with its variant.
FUNCTION_WORDS = frozenset("a an the and or of for to in on at by with from as is are be this that its".split())
SHORT_LABEL, SHORT_SIMILARITY, LONG_WORD = 12, 0.97, 6
VARIANT = re.compile(r"(.*[a-z])(\d+[a-z]*|[a-z]{2,})")


def shingles(label: Column, k: int = 3) -> Column:
    """Letter k-grams without blanks; a shorter label is its own."""
    bare = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")
    n = F.length(bare)
    return F.when(n < k, F.array(bare)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(bare, i, F.lit(k)))))


def minhash(grams: Column, permutations: int = PERMUTATIONS) -> Column:
    """The least hash of the set for each seed."""

    def seeded(seed: int):
        return lambda g: F.xxhash64(F.lit(seed), g)

    return F.array(*[F.array_min(F.transform(grams, seeded(s))) for s in range(permutations)])


def bands(signature: Column, permutations: int = PERMUTATIONS, rows: int = ROWS) -> Column:
    return F.array(*[F.xxhash64(F.lit(i), *[signature[j] for j in range(i, i + rows)]) for i in range(0, permutations, rows)])


def lsh_parameters(threshold: float, permutations: int, steps: int = 1000) -> tuple[int, int]:
    """(bands, rows) with the least sum of two areas: pairs below the threshold that meet in a band, and pairs above that don't.

    Both weigh the same; of equal sums the one with fewer bands. Arithmetic on numbers alone, for the driver.
    """
    s = (np.arange(steps) + 0.5) / steps
    far = s < threshold
    choices = [(b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)]

    def wrong(choice: tuple[int, int]) -> float:
        apart = (1 - s ** choice[1]) ** choice[0]
        return float(np.where(far, 1 - apart, apart).sum())

    return min(choices, key=wrong)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    right = [c for c, f in zip(b, free) if not f]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _numbers(label: str) -> list[str]:
    return sorted(n.lstrip("0") for n in re.findall("[0-9]+", label))


def _slip(a: str, b: str) -> bool:
    """Whether words of one length differ in one letter, or in two neighbours changed over."""
    at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    if len(a) != len(b) or len(at) > 2:
        return False
    return len(at) < 2 or (at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])


def _other_word(a: str, b: str) -> bool:
    """Whether two words in one place of two labels are different words, not one misspelt or a function word."""
    if a == b or a in FUNCTION_WORDS or b in FUNCTION_WORDS or _slip(a, b):
        return False
    return min(len(a), len(b)) < LONG_WORD or jaro_winkler(a, b) < MIN_SIMILARITY


def guarded(a: str, b: str) -> bool:
    """Whether two labels must stay apart, however alike they look: other numbers, one a longer form of the other, short ones
    with other endings or with more than a slip between them, or another word in one place."""
    x, y = (" ".join(re.split(r"[\W_]+", s.lower())).strip() for s in (a, b))
    if x == y:
        return False
    if _numbers(x) != _numbers(y) or x.startswith(y) or y.startswith(x):
        return True
    if max(len(x), len(y)) < SHORT_LABEL:
        p, q = VARIANT.fullmatch(x), VARIANT.fullmatch(y)
        if (p and q and p[1] == q[1]) or not _slip(x, y) or jaro_winkler(x, y) < SHORT_SIMILARITY:
            return True
    left, right = x.split(), y.split()
    return len(left) == len(right) and any(map(_other_word, left, right))


def _must_agree(label: Column) -> Column:
    """What ``guarded`` wants equal in both labels: their numbers, without noughts before them, in any order."""
    found = F.regexp_extract_all(F.lower(label), F.lit("([0-9]+)"), F.lit(1))
    return F.array_join(F.array_sort(F.transform(found, lambda n: F.regexp_replace(n, "^0+", ""))), " ")


def bucketed(labels: DataFrame) -> DataFrame:
    """id, label, buckets: a hash for each band, and of what two labels must agree in to be merged."""
    rows = labels.where(X.entropy(F.col("label")) >= MIN_ENTROPY).select("id", "label", shingles(F.col("label")).alias("grams"))
    signed = rows.select("id", "label", minhash(F.col("grams")).alias("signature"), F.xxhash64(_must_agree(F.col("label"))).alias("own"))
    return signed.select("id", "label", F.transform(bands(F.col("signature")), lambda x: F.xxhash64(x, "own")).alias("buckets"))


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, la, b, lb) that pass similarity and guards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [not guarded(x, y) and jaro_winkler(x.lower(), y.lower()) >= least for x, y in zip(pdf["la"], pdf["lb"])]
            yield pdf[good][["a", "b"]]

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInPandas(run, f"a {kind}, b {kind}")


def similar_pairs(labels: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """(a, b) of labels in one band bucket that pass similarity and guards: enough for all components of such pairs.

    ``labels``: id, label, different labels. A bucket's members are first compared with its least, which is linear. What then
    still lies in several components of one bucket is compared pair by pair across them, so that no neighbour is left out;
    a bucket holds only labels with the same numbers, as the guards keep all others apart. Both sides of each join grow with the
    labels, so none is sent through the driver, whatever the sizes of their files promise.
    """
    held = checkpointed(bucketed(labels))
    rows = checkpointed(held.select("id", "label", "buckets", F.posexplode("buckets").alias("band", "bucket")))
    first = rows.groupBy("bucket").agg(F.min(F.struct("id", "label")).alias("f"), F.count("*").alias("n")).where("n > 1")
    star = rows.join(first.hint("merge"), "bucket").where("id <> f.id").select(F.col("f.id").alias("a"), F.col("f.label").alias("la"), F.col("id").alias("b"), F.col("label").alias("lb")).distinct()
    found = checkpointed(_verified(star, least))
    roots = components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = rows.join(first.select("bucket").hint("merge"), "bucket").join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    # Two members alone have been compared.
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 AND n > 2").select("bucket")
    left = checkpointed(placed.join(open_.hint("merge"), "bucket").select("id", "label", "buckets", "band", "bucket", "root"))
    x, y = left.alias("x"), left.alias("y")
    # A pair counts in the first bucket that it shares.
    shared = F.array_position(F.zip_with("x.buckets", "y.buckets", lambda a, b: a == b), True) == F.col("x.band") + 1
    rest = x.join(y.hint("merge"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & shared)
    return found.union(_verified(rest.select(F.col("x.id").alias("a"), F.col("x.label").alias("la"), F.col("y.id").alias("b"), F.col("y.label").alias("lb")), least))


def entities(nodes: DataFrame) -> DataFrame:
    """id, canonical: equal keys first, then similar labels; the least id of a group stands for it."""
    keyed = nodes.select("id", F.col("label"), X.key(F.col("label")).alias("key"))
    exact = keyed.groupBy("key").agg(F.min("id").alias("first"), F.min_by("label", "id").alias("label"))
    found = components(similar_pairs(exact.select(F.col("first").alias("id"), "label")).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    merged = exact.join(found.select(F.col("id").alias("first"), F.col("component").alias("root")).hint("merge"), "first", "left")
    return keyed.join(merged.select("key", F.coalesce("root", "first").alias("canonical")).hint("merge"), "key").select("id", "canonical")


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Endpoints by their canonical ids; loops and repeats that arise go."""
    m = mapping.select("id", "canonical")
    a = edges.join(m.select(F.col("id").alias("src"), F.col("canonical").alias("__s")), "src", "left")
    b = a.join(m.select(F.col("id").alias("dst"), F.col("canonical").alias("__d")), "dst", "left")
    out = b.select(F.coalesce("__s", "src").alias("src"), F.coalesce("__d", "dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return out.where("src <> dst").distinct()


def jaccard_pairs(rows: DataFrame, key: str, tokens: Column, least: float) -> DataFrame:
    """All pairs (a < b) of sets with a similarity of ``least`` or more, by prefix filtering.

    Tokens are ordered from rare to common; two sets that are similar enough share one of their first
    n - ceil(least * n) + 1 tokens, so only rows that share such a token are compared. Then the whole sets decide.
    """
    sets = rows.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("s")).where(F.size("s") > 0)
    freq = sets.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    ordered = sets.select("k", F.explode("s").alias("t")).join(freq, "t").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    n = F.size("o")
    held = checkpointed(ordered.select("k", F.transform("o", lambda x: x["t"]).alias("s"), (n - F.ceil(least * n - 1e-9) + 1).cast("int").alias("p")))
    heads = held.select("k", F.explode(F.slice("s", F.lit(1), F.col("p"))).alias("t"))
    candidates = heads.alias("x").join(heads.alias("y"), "t").where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    both = candidates.join(held.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("jaccard", X.jaccard(F.col("sa"), F.col("sb"))).where(F.col("jaccard") >= least).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
