"""Benchmark decontamination (operator 6): Wu-Manber search for all windows of the benchmark items in whole documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 13 consecutive words of an item;
an item of fewer, but not none, is one window. The patterns of one length m form a class: a shift table tells for a
block of two words how far the search may jump, m - 1 words where no pattern has the block; where the jump is 0, the
suffix bucket of the block names the few patterns to compare word by word.

The benchmark is taken in parts of at most ``PART_WORDS`` words, each sent to the workers as plain word lists; whatever
its size, the documents pass by once for each part, and no text is shuffled. A document's hits from all parts are merged
before anything is decided.

Null or empty texts have no words: n_hit 0, not contaminated. Null item_id counts as an empty string, rows with one
item_id are one item. Repeated documents give repeated rows. Very long texts are searched whole, in linear time. Empty
tables: no documents give an empty result, no items leave every document clean. Columns that clash with results give way
to them, others come back as they were, whatever their names.

The benchmark is held by the driver part by part and by the workers as one broadcast each: its size, not that of the
documents, bounds this, and each ``PART_WORDS`` words of it cost a pass over the documents. It is meant for test sets of up
to some millions of words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvidex.llm.common import fresh, plainly, table, without

WINDOW = 13
#: Words of benchmark items in one part: about 60 MB of tables in each worker.
PART_WORDS = 200_000
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class PatternClass:
    """Shift table and suffix buckets for the patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[list]] = {}

    def add(self, pattern: list[bytes], item: str) -> None:
        b, m = self.block, self.length
        end = tuple(pattern[m - b :])
        for held in self.bucket.setdefault(end, []):
            if held[0] == pattern:
                held[1].add(item)
                return
        self.bucket[end].append([pattern, {item}])
        for j in range(b, m + 1):
            key = tuple(pattern[j - b : j])
            self.shift[key] = min(self.shift.get(key, m), m - j)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, after the last, items) of each occurrence."""
        m, b, n = self.length, self.block, len(words)
        shift, bucket, most = self.shift.get, self.bucket, self.length - self.block + 1
        i = m
        while i <= n:
            key = (words[i - 2], words[i - 1]) if b == 2 else (words[i - 1],)
            jump = shift(key, most)
            if jump:
                i += jump
                continue
            found = words[i - m : i]
            for pattern, items in bucket[key]:
                if pattern == found:
                    yield i - m, i, items
            i += 1


def build(items: list[tuple[str, list[bytes]]]) -> list[PatternClass]:
    classes: dict[int, PatternClass] = {}
    for item, words in items:
        m = min(WINDOW, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            classes.setdefault(m, PatternClass(m)).add(words[i : i + m], item)
    return list(classes.values())


def hits(classes: list[PatternClass], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """The merged spans of hit words, and the items."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for c in classes:
        for start, end, own in c.search(words):
            spans.append((start, end))
            items |= own
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_TABLES: dict[str, list[PatternClass]] = {}


def _classes(key: str, part: Broadcast) -> list[PatternClass]:
    """A worker's tables for a part of the benchmark; it keeps those of one part."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = build(part.value)
    return _TABLES[key]


def parts_of(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    part, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        # A long item is cut into pieces that overlap by a window less one word.
        for at in range(0, max(1, len(words) - WINDOW + 1), PART_WORDS):
            piece = words[at : at + PART_WORDS + WINDOW - 1]
            if part and size + len(piece) > PART_WORDS:
                yield part
                part, size = [], 0
            part.append((row["item_id"], piece))
            size += len(piece)
    yield part


def mark(docs: DataFrame, benchmark: DataFrame, only_clean: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; or the clean rows as they were.

    A chain of ``mapInArrow`` passes, one for each part of the benchmark; nothing is shuffled.
    """
    if only_clean:
        return plainly(docs, lambda x: _marked(x, benchmark, True))
    return plainly(without(docs, RESULTS), lambda x: _marked(x, benchmark, False), RESULTS)


def _marked(docs: DataFrame, benchmark: DataFrame, only_clean: bool) -> DataFrame:
    given = docs.schema
    at_spans, at_items = fresh(docs, "spans"), fresh(docs, "items")
    held = T.StructType([*given, T.StructField(at_spans, T.ArrayType(T.LongType())), T.StructField(at_items, T.ArrayType(T.StringType()))])
    final = given if only_clean else T.StructType([*given, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    names = given.names

    def passing(part: Broadcast, first: bool, last: bool):
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes = _classes(key, part)
            for batch in batches:
                text = batch.column("text").to_pylist()
                old = [([], [])] * len(text) if first else zip(batch.column(at_spans).to_pylist(), batch.column(at_items).to_pylist())
                spans, items, n_words = [], [], []
                for x, (flat, own) in zip(text, old):
                    words = words_of(x)
                    found, more = hits(classes, words)
                    n_words.append(len(words))
                    spans.append(merged([*found, *zip(flat[::2], flat[1::2])]))
                    items.append(more.union(own))
                columns = {c: batch.column(c) for c in names}
                if not last:
                    columns |= {at_spans: pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int64())), at_items: pa.array([sorted(own) for own in items], pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_pydict(columns)
                    continue
                n_hit = [sum(end - start for start, end in own) for own in spans]
                bad = pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)], pa.bool_())
                if only_clean:
                    yield batch.select(names).filter(pa.array([not x for x in bad.to_pylist()], pa.bool_()))
                    continue
                columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(own) for own in items], pa.int64())}
                columns |= {"items_sha256": pa.array([hashlib.sha256(",".join(sorted(own)).encode()).hexdigest() for own in items], pa.string()), "contaminated": bad}
                yield pa.RecordBatch.from_pydict(columns)

        return run

    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(part) for part in parts_of(benchmark)]
    out = docs
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        out = out.mapInArrow(passing(part, k == 0, last), final if last else held)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
