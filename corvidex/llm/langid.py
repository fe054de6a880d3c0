"""Language ID (operator 5): bit-sliced Bloom filters over byte n-grams.

One table of ``SLOTS`` masks; bit l of a mask says that language l has set the slot. An n-gram is looked up in
``HASHES`` slots, and the bitwise and of the masks gives *all* languages that contain it at once. A text's count for a
language is the number of its n-grams with that bit; from it goes what false positives add, n * f for a filter that is
full to f ** (1 / HASHES). The largest corrected count decides, its share of all is the score.

An n-gram is four bytes of the lower-cased text, white space and ASCII signs as one blank, blanks at its ends only.
A language contains it if its share there is at least ``NEAR`` of the largest share in any language.

Learning: from all labelled rows, the ``GRAMS_PER_LANGUAGE`` commonest n-grams of each language. Prediction is one pass over whole texts
without a shuffle; what is broadcast is the table of ``SLOTS`` masks, 8 MB for up to 64 languages.

Null text or no letter: ``und`` with score 0. No n-gram known (or no labelled row at all: ``und``): the language with
most labelled rows, score 0. Of two languages with equal counts the first by name is taken. Texts count whole, however
long; copies of a labelled text count as often as they occur, and counts are taken before anything is shuffled. Empty tables give empty results; repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvidex.llm.common import materialize, plainly, table, without

GRAMS_PER_LANGUAGE = 40_000
SLOTS = 1 << 20
HASHES = 3
NEAR = 0.25
#: What ``learn_with_floor`` asks of a text, and the share of labelled rows that may be junk or in another language.
FLOOR, OUTLIERS = 0.5, 0.01
#: Bytes of text that are looked up at once, and those of one language that are counted at once.
SLICE, COUNTED = 1 << 20, 1 << 22
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of folded texts, as 32-bit integers, and the number of the text each is from."""
    joined = np.frombuffer(b"    ".join([b"", *texts, b""]), np.uint8)
    if len(joined) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    inner = (joined[1:-2] != 32) & (joined[2:-1] != 32)
    at = np.flatnonzero(inner)
    a = joined.astype(np.uint32)
    gram = a[at] | a[at + 1] << 8 | a[at + 2] << 16 | a[at + 3] << 24
    ends = np.cumsum([len(x) + 4 for x in texts])
    return gram, np.searchsorted(ends, at, side="right")


def slots(gram: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams by double hashing."""
    h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    a, b = h >> np.uint64(40), h >> np.uint64(16) & np.uint64(0xFFFFFF) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """``masks``: SLOTS x words of 64 languages each."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    fallback: str

    @classmethod
    def build(cls, languages: list[str], members: list[tuple[str, np.ndarray]], fallback: str) -> Model:
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        false = np.zeros(len(languages))
        for name, gram in members:
            i = languages.index(name)
            own = np.unique(np.concatenate(slots(gram)))
            masks[own, i // 64] |= np.uint64(1 << i % 64)
            false[i] = (len(own) / SLOTS) ** HASHES
        return cls(languages, masks, false, fallback)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text; corrected counts by text and language."""
        gram, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        at = slots(gram)
        raw = np.zeros((len(texts), len(self.languages)))
        for word in range(self.masks.shape[1]):
            table = self.masks[:, word]
            hit = table[at[0]]
            for k in at[1:]:
                hit &= table[k]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                raw[:, i] = np.bincount(owner[(hit >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        return n, np.maximum(0, (raw - n[:, None] * self.false) / (1 - self.false))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.read(texts)[:2]

    def read(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and the share of a text's n-grams that the language knows."""
        names, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        todo: list[int] = []
        held: list[bytes] = []

        def flush() -> None:
            if not held:
                return
            n, c = self.counts(held)
            best, total = c.argmax(1), c.sum(1)
            for k, i in enumerate(todo):
                names[i] = self.languages[best[k]] if total[k] > 0 else self.fallback
                scores[i] = float(c[k, best[k]] / total[k]) if total[k] > 0 else 0.0
                known[i] = float(c[k, best[k]] / n[k]) if n[k] > 0 else 0.0
            todo.clear()
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            if text and self.languages and _LETTER.search(text):
                todo.append(i)
                held.append(_folded(text))
                size += len(held[-1])
                if size >= SLICE:
                    flush()
                    size = 0
        flush()
        return names, scores, known


def _labelled(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The rows of (text, lang) that are learned from, and their number for each language."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows, {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}


def learn(labelled: DataFrame) -> Model:
    """Fit the filters on all rows of (text, lang)."""
    return _learn(*_labelled(labelled))


def learn_with_floor(labelled: DataFrame) -> tuple[Model, float]:
    """The model, and the least share of known n-grams for a text to be in a learned language: ``FLOOR`` times the share
    that all but ``OUTLIERS`` of the labelled rows reach. 0 without labelled rows."""
    rows, sizes = _labelled(labelled)
    model = _learn(rows, sizes)
    if not sizes:
        return model, 0.0
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"known": pa.array(sent.value.read(batch.column("text").to_pylist())[2], pa.float64())})

    low = rows.where(F.length("text") > 0).mapInArrow(run, "known double").agg(F.percentile_approx("known", OUTLIERS, 10_000)).first()[0]
    return model, FLOOR * (low or 0.0)


def _learn(rows: DataFrame, share: dict[str, int]) -> Model:
    if not share:
        return Model([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0), UNKNOWN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, texts: list[bytes]) -> pa.RecordBatch:
            gram, n = np.unique(grams(texts)[0], return_counts=True)
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(_folded(text))
                size[lang] = size.get(lang, 0) + len(by[lang][-1])
                if size[lang] >= COUNTED:
                    yield counted(lang, by.pop(lang))
                    size[lang] = 0
            for lang, texts in by.items():
                yield counted(lang, texts)

    # Written once: what follows reads it three times.
    counted = materialize(rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The totals of a language are one row each.
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shared = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = shared.groupBy("gram").agg(F.max("share").alias("most"))
    members = shared.join(most, "gram").where((F.col("share") >= NEAR * F.col("most")) & (F.col("n") > 1))
    members = members.withColumn("k", F.row_number().over(best)).where(F.col("k") <= GRAMS_PER_LANGUAGE).select("lang", "gram")
    got = members.toArrow()
    names, gram = np.asarray(got["lang"].to_pylist(), object), got["gram"].to_numpy().astype(np.uint32)
    languages = sorted(share)
    return Model.build(languages, [(x, gram[names == x]) for x in languages], max(sorted(share), key=lambda x: share[x]))


#: What ``identify`` adds.
RESULTS = ("lang_pred", "score")


def identify(docs: DataFrame, model: Model, keep: bool = False, least: float = 0.0, least_known: float = 0.0) -> DataFrame:
    """``docs`` with lang_pred and score; or, with ``keep``, the rows with a language, a score of at least ``least`` and a
    share of known n-grams of at least ``least_known``."""
    if keep:
        return plainly(docs, lambda x: _read(x, model, True, least, least_known))
    return plainly(without(docs, RESULTS), lambda x: _read(x, model, False, least, least_known), RESULTS)


def _read(docs: DataFrame, model: Model, keep: bool, least: float, least_known: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = docs.schema if keep else T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, known = sent.value.read(batch.column("text").to_pylist())
            if keep:
                yield batch.filter(pa.array([x != UNKNOWN and s >= least and k >= least_known for x, s, k in zip(lang, score, known)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text, modulo 4, is 2. Null doc_id: of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
