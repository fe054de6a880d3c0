"""Quality rules by weak supervision (operator 10), in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Rules are of several kinds of junk; a kind has two to
four rules that look at it from different sides. Expectation-maximisation over the votes of all documents fits one class
of good documents and one for each kind: how common it is, and how often each rule finds fault with its documents. A
document's posterior probability of being good replaces a filter that all rules must pass: what a noisy rule finds is
outvoted by the others of its kind, since EM learns how often that rule finds fault with good documents. Only a failed
base rule is final. A single vote decides where its rule hardly ever finds fault with good documents.

Nothing but the names of the classes is assumed: a rule finds fault with at least half the documents of its own kind and
with at most half the good ones. Where EM starts (``START``) counts as one document.

The rules depend on the votes alone, so the fit runs over counts of vote patterns: one aggregation over all documents,
whose result has at most 3 ** 13 rows whatever the input (some hundreds in practice), and a loop over those counts in the
driver. Signals are array functions within a row: nothing is exploded or shuffled by document. The narrow table of signals
is written once, so that texts are read once.

Words are ``[^\\x20\\x09-\\x0D]+``. Null text: no words, base_failed. Very long texts are whole, one row of arrays
each. Repeated rows each count and get the same verdict; a posterior of exactly ``KEEP_FROM`` keeps. An empty table gives
an empty result and a model that keeps whatever passes the base rule. Extra columns may have any name: names that the
input lacks are chosen for all that is added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.common import fresh, materialize, plainly, table

#: Words of a window that is looked for twice in a text.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
ROUNDS = 300
KEEP_FROM = 0.5
#: Where EM starts: how often a rule finds fault with documents of its own kind, of other kinds, and with good ones.
START = {"own": 0.8, "other": 0.05, "good": 0.02}
#: Share of each kind of junk at the start.
START_SHARE = 0.02
#: The kinds of junk and the rules of each.
KINDS = {
    "symbols": ("symbol_share", "symbol_runs", "symbols_on_words"),
    "tables": ("bars", "bars_in_lines"),
    "shouting": ("shouting", "capitals"),
    "repetition": ("repeated_lines", "repeated_windows", "echoes", "variety"),
    "form": ("word_length", "sentences"),
}
RULES = tuple(r for rules in KINDS.values() for r in rules)
_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"
_SYMBOL = "[#*$%&|<>]"


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def with_signals(df: DataFrame, name: str = "quality") -> DataFrame:
    """``df`` with a struct of signals of its text."""
    given = [c for c in df.columns if c != name]
    mark = fresh_prefix(df)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn(f"{mark}words", F.array_remove(F.split(text, _SPACE), "")).withColumn(f"{mark}lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)))
    words, n = F.col(f"{mark}words"), F.size(f"{mark}words")
    df = df.withColumn(f"{mark}hashed", F.transform(words, lambda x: F.xxhash64(x)))
    # Element by element: slice() copies the whole array each time.
    window = lambda i: [F.get(f"{mark}hashed", i + k) for k in range(WINDOW)]
    starts = F.sequence(F.lit(0), n - WINDOW)
    nothing = F.array().cast("array<bigint>")
    echo = F.zip_with(f"{mark}hashed", F.slice(f"{mark}hashed", 2, F.greatest(n, F.lit(1))), lambda a, b: a == b)
    df = df.withColumn(f"{mark}windows", F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*window(i)))).otherwise(nothing))
    hashes = F.col(f"{mark}windows")
    # Most texts repeat no window and end here. For the others: 128 bits a window, sorted, equal neighbours.
    keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("a"), F.xxhash64(F.lit(1), *window(i)).alias("b"), i.alias("i")))
    df = df.withColumn(f"{mark}sorted", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(keyed)))
    ordered = F.col(f"{mark}sorted")
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    twice = F.transform(ordered, lambda x, k: F.when(F.when(k > 0, same(x, F.get(ordered, k - 1))).otherwise(False) | same(x, F.get(ordered, k + 1)), x["i"]))
    df = df.withColumn(f"{mark}at", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    at = F.col(f"{mark}at")
    covered = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))).cast("long"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    signals = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, _SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size(f"{mark}lines") - F.size(F.array_distinct(f"{mark}lines"))).cast("long").alias("n_dup_lines"),
        F.when(ordered.isNull(), 0).otherwise(_sum(covered)).cast("long").alias("n_repeat_words"),
        F.size(f"{mark}lines").cast("long").alias("n_lines"),
        count("\\p{Lu}{3}|!!").alias("n_shouted"),
        count("\\p{Lu}").alias("n_capitals"),
        count("\\|").alias("n_bars"),
        count(f"{_SYMBOL}+").alias("n_runs"),
        count(f"[^#*$%&|<>\\s]{_SYMBOL}{{2}}").alias("n_on_words"),
        F.size(F.filter(echo, lambda x: x)).cast("long").alias("n_echoes"),
        F.size(F.array_distinct(f"{mark}hashed")).cast("long").alias("n_distinct"),
        count("[.!?](?=[\\x20\\x09-\\x0D]|$)").alias("n_ends"),
    )
    df = df.withColumn(f"{mark}out", signals)
    q = F.col(f"{mark}out")
    return df.select(*given, q.withField("votes", F.struct(*[v.cast("tinyint").alias(k) for k, v in votes(q).items()])).alias(name))


def fresh_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has."""
    mark = "__q_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def votes(q: Column) -> dict[str, Column]:
    """The rules: (bad if, good if), of signals per word, per line or per letter."""
    words, chars, lines = (F.greatest(q[c], F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    rules = {
        "symbol_share": (q["n_symbols"] > 0.05 * chars, q["n_symbols"] < 0.01 * chars),
        "symbol_runs": (q["n_runs"] > 0.15 * words, q["n_runs"] < 0.03 * words),
        "symbols_on_words": (q["n_on_words"] > 0.05 * words, q["n_on_words"] < 0.01 * words),
        "bars": (q["n_bars"] > 0.15 * words, q["n_bars"] < 0.02 * words),
        "bars_in_lines": (q["n_bars"] > 2 * lines, q["n_bars"] < 0.5 * lines),
        "shouting": (q["n_shouted"] > 0.2 * words, q["n_shouted"] < 0.03 * words),
        "capitals": (q["n_capitals"] > 0.2 * chars, q["n_capitals"] < 0.1 * chars),
        "repeated_lines": ((q["n_dup_lines"] > 0.3 * lines) & (q["n_dup_lines"] > 2), q["n_dup_lines"] <= 0.05 * lines),
        "repeated_windows": (100 * q["n_repeat_words"] > 15 * q["n_words"], 100 * q["n_repeat_words"] <= 2 * q["n_words"]),
        "echoes": (q["n_echoes"] > 0.2 * words, q["n_echoes"] < 0.03 * words),
        # Different words grow about as the square root of a text's length, so this is fair to long ones.
        "variety": ((q["n_distinct"] * q["n_distinct"] < 4 * words) & (q["n_words"] >= 20), q["n_distinct"] * q["n_distinct"] > 9 * words),
        "word_length": ((q["word_chars"] > 14 * words) | (q["word_chars"] < 2 * words), (q["word_chars"] >= 3 * words) & (q["word_chars"] <= 11 * words)),
        "sentences": ((q["n_ends"] < 0.01 * words) & (q["n_words"] >= 40), (q["n_ends"] >= 0.02 * words) & (q["n_ends"] <= 0.5 * words)),
    }
    return {k: F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules.items()}


@dataclass
class Model:
    """log_odds: by kind of junk, the log ratio of its share to that of good documents. weights: by kind, rule and vote, the
    log ratio of the vote's chance in the kind and among good documents. faults: by class, how often each rule finds fault."""

    log_odds: dict[str, float] = field(default_factory=dict)
    weights: dict[str, dict[str, dict[int, float]]] = field(default_factory=dict)
    faults: dict[str, dict[str, float]] = field(default_factory=dict)

    def score(self, q: Column) -> Column:
        """The posterior probability of being good."""
        against = F.lit(0.0)
        for kind, z in self.log_odds.items():
            odds = F.lit(z)
            for rule, w in self.weights[kind].items():
                vote = q["votes"][rule]
                odds = odds + F.when(vote == 1, w[1]).when(vote == -1, w[-1]).otherwise(0.0)
            against = against + F.exp(odds)
        return 1 / (1 + against)


def em(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], kinds: dict[str, tuple[str, ...]] | None = None, rounds: int = ROUNDS) -> Model:
    """A class of good documents and one for each kind, rules independent given the class; a rule that abstains says nothing.

    ``patterns``: the votes of ``rules`` and how many documents have them.
    """
    kinds = kinds or {k: own for k, own in KINDS.items() if set(own) <= set(rules)}
    if not patterns:
        return Model()
    vote, count = np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], float)
    bad, good = (vote == -1).astype(float), (vote == 1).astype(float)
    own = np.array([[False] * len(rules), *[[r in names for r in rules] for names in kinds.values()]])
    start = np.where(own, START["own"], START["other"])
    start[0] = START["good"]
    fault, share = start.copy(), np.array([1 - START_SHARE * len(kinds), *[START_SHARE] * len(kinds)])
    opening, before = share.copy(), None
    for _ in range(rounds):
        z = np.log(share) + bad @ np.log(fault).T + good @ np.log1p(-fault).T
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        if before is not None and np.abs(z - before).max() < 1e-9:
            break
        before = z
        mass = (z * count[:, None]).T
        share = (mass.sum(1) + opening) / (count.sum() + 1)
        fault = (mass @ bad + start) / (mass @ (bad + good) + 1)
        # What gives the classes their names, and a bound for the logarithms.
        fault = np.where(own, np.maximum(fault, 0.5), fault)
        fault[0] = np.minimum(fault[0], 0.5)
        fault = np.clip(fault, 1e-12, 1 - 1e-12)
    log = {"bad": np.log(fault) - np.log(fault[0]), "good": np.log1p(-fault) - np.log1p(-fault[0])}
    return Model(
        {kind: float(np.log(share[k] / share[0])) for k, kind in enumerate(kinds, 1)},
        {kind: {r: {-1: float(log["bad"][k, i]), 1: float(log["good"][k, i])} for i, r in enumerate(rules)} for k, kind in enumerate(kinds, 1)},
        {name: dict(zip(rules, fault[k].tolist())) for k, name in enumerate(["good", *kinds])},
    )


def fit(df: DataFrame, name: str = "quality") -> Model:
    """Estimate the model from the signals of all rows of ``df`` that pass the base rule, the others being decided.

    ``df`` should be a written table: else each use of a signal computes it again.
    """
    v = F.col(name)["votes"]
    code = sum(((v[r] + 1).cast("int") * 3**i for i, r in enumerate(RULES)), F.lit(0))
    counted = df.where(~base_failed(F.col(name))).groupBy(code.alias("code")).agg(F.count("*").alias("documents")).collect()
    return em(sorted((tuple(r["code"] // 3**i % 3 - 1 for i in range(len(RULES))), r["documents"]) for r in counted), list(RULES))


def judged(df: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """The struct of signals with base_failed, posterior and kept."""
    q = F.col(name)
    df = df.withColumn(name, q.withField("base_failed", base_failed(q)).withField("posterior", model.score(q)))
    return df.withColumn(name, q.withField("kept", ~q["base_failed"] & (q["posterior"] >= KEEP_FROM)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the method keeps, with their columns as they were."""

    def kept(rows: DataFrame) -> DataFrame:
        name = fresh(rows, "quality")
        held = materialize(with_signals(rows, name), "quality")
        return judged(held, fit(held, name), name).where(F.col(name)["kept"]).select(*rows.columns)

    return plainly(docs, kept)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = materialize(with_signals(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged(held, fit(held)).select("doc_id", *[f"quality.{c}" for c in shown])


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
