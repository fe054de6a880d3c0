"""Ranked lexical search by variable-block-max WAND (operator 12).

``build`` makes an index in the shared folder. Each task turns its documents, a few megabytes at a time, into segments
(shards): postings of all terms of all its documents. When the number of documents and of terms is known, each posting gets
its score without the term's weight, and each list is cut into blocks: dynamic programming over runs of ``RUN`` postings
finds the cuts with the least sum of bound errors (block maximum less score, over all postings) and a price a block.

``search`` takes queries in blocks of bounded size over all segments. In a segment, the blocks of a query's terms bound the
score of every document at once: a block adds its maximum from its first document on and takes it off behind its last.
Documents whose bound doesn't reach the k-th score found so far can't enter, the pivot test of WAND for all of them at
once; blocks without a document left aren't read. The rest is scored exactly. A task hands its k best of each query on, and
one window ranks them. A task reads, holds and writes one segment at a time, so that its memory doesn't depend on how many
segments it has. No segment, no list and no task is left out, so results are those of scoring everything.

Scores: ``weight(df, N) * ((1000000000 * tf) div (1000 * tf + 20 * m))`` over a query's different terms, where m is
100 - 50 + ((50 * n * N) div L). 50 * n * N must stay below 2^63.

Null texts, and those without a term, are in no list and count in neither N nor L. Queries that are null, have no term or no
document with one give no rows. Each row of queries is one query, so that a repeated item_id repeats its ranks. Equal scores
rank by ascending doc_id, nulls first; repeated documents are ranked each. Empty tables give an empty result. Other columns
are ignored, whatever their names. Very long texts are a segment of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.common import materialize_large, one_row_a_batch, shared_path, table

#: Bytes of text in a segment.
SEGMENT = 8_000_000
#: Postings that a cut may not part, and the most such runs in a block.
RUN, MOST_RUNS = 4, 32
#: Price of a block, in mean scores of its list.
PRICE = 6.0
#: Queries and bytes of their texts that one pass over the index answers.
QUERIES_AT_ONCE, BYTES_AT_ONCE = 4096, 8_000_000

#: A-Z in lower case, all other ASCII but digits and a-z as a space.
_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def segments(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row a segment: its documents that have terms, and the postings (document, tf) of each term in document order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment bigint, documents bigint, words bigint, doc_id array<{kind}>, lengths array<int>, terms array<binary>, df array<int>, places binary, tf binary"

    def row(number: int, ids: list, lengths: list[int], numbers: _Numbers, said: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        words = np.concatenate(said) if said else np.zeros(0, np.int64)
        key = np.sort((words << 32) + np.repeat(np.arange(len(lengths)), lengths))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        tf, key = np.diff(np.append(first, len(key))), key[first]
        df = np.bincount(key >> 32, minlength=len(numbers))
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([number], pa.int64()), "documents": pa.array([len(ids)], pa.int64()), "words": pa.array([len(words)], pa.int64()), "doc_id": pa.array([ids], pa.list_(kind)), "lengths": pa.array([lengths], pa.list_(pa.int32())),
            "terms": pa.array([list(numbers)], pa.list_(pa.binary())), "df": pa.array([df.astype(np.int32)], pa.list_(pa.int32())), "places": [(key & 0xFFFFFFFF).astype("<i4").tobytes()], "tf": [tf.astype("<i4").tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, lengths, numbers, said = [], [], _Numbers(), []
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                if ids and held + len(text) > size:
                    yield row(number, ids, lengths, numbers, said, kind)
                    number, held, ids, lengths, numbers, said = number + 1, 0, [], [], _Numbers(), []
                held += len(text)
                ids.append(i)
                lengths.append(len(terms))
                said.append(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)))
        if ids:
            yield row(number, ids, lengths, numbers, said, kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cuts(scores: np.ndarray, df: np.ndarray, run: int = RUN, most: int = MOST_RUNS, price: float = PRICE) -> np.ndarray:
    """First postings of the blocks of all lists, whose scores stand one after the other, ``df`` of them each.

    Least sum, over the blocks, of (postings * maximum) and the price; the sum of the scores themselves is the same for all
    cuts. All lists go step by step together, the longest first, so that a step is a few array operations."""
    starts = np.cumsum(df) - df
    units = -(-df // run)
    order = np.argsort(-units, kind="stable")
    units, begin, size = units[order], starts[order], df[order]
    offset = np.cumsum(units) - units
    within = np.arange(units.sum()) - np.repeat(offset, units)
    unit_start = np.repeat(begin, units) + within * run
    unit_size = np.minimum(run, np.repeat(size, units) - within * run)
    highest = np.full(len(unit_start) + most, -1, np.int64)  # what lies before a list is masked below
    back = np.argsort(unit_start)
    highest[most + back] = np.maximum.reduceat(scores, unit_start[back]) if len(scores) else 0
    sums = np.add.reduceat(scores, begin[np.argsort(begin)])[np.argsort(np.argsort(begin))] if len(scores) else np.zeros(0)
    cost_of_block = price * sums / np.maximum(size, 1)
    # cost[list's offset + its number + j]: the least cost of its first j runs
    state = offset + np.arange(len(units))
    cost = np.zeros(len(unit_start) + len(units) + most)
    last = np.zeros(len(unit_start), np.int64)
    filled = np.concatenate(([0], np.cumsum(unit_size)))
    back_by = np.arange(most)
    for j in range(1, int(units[0]) + 1 if len(units) else 0):
        active = int(np.searchsorted(-units, -j, side="right"))
        wide = min(j, most)
        at = offset[:active] + j - 1
        window = at[:, None] - back_by[None, :wide]
        peak = np.maximum.accumulate(highest[most + window], axis=1)
        postings = filled[at + 1][:, None] - filled[window]
        total = cost[(state[:active] + j)[:, None] - 1 - back_by[None, :wide]] + peak * postings
        choice = np.argmin(total, axis=1)
        rows = np.arange(active)
        cost[state[:active] + j] = total[rows, choice] + cost_of_block[:active]
        last[at] = choice
    # Back along the choices, all lists at once.
    found, at, left = [], offset + units - 1, np.flatnonzero(units > 0)
    while len(left):
        first = at[left] - last[at[left]]
        found.append(unit_start[first])
        at[left] = first - 1
        left = left[first > offset[left]]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Index:
    """A written index: ``rows`` (its segments), the number of documents with a term and of their terms."""

    def __init__(self, rows: DataFrame, documents: int, words: int) -> None:
        self.rows, self.documents, self.words = rows, documents, words


def build(docs: DataFrame, size: int = SEGMENT) -> Index:
    """Index every row of ``docs``; three passes, two tables in the shared folder, nothing collected but two sums."""
    held = materialize_large(segments(docs, size), "segments")
    found = held.agg(F.sum("documents"), F.sum("words")).first()
    documents, words = int(found[0] or 0), int(found[1] or 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment bigint, doc_id array<{kind}>, terms array<binary>, df array<int>, places binary, scores binary, blocks binary, highest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                df = batch.column("df")[k].values.to_numpy().astype(np.int64)
                places, tf = (np.frombuffer(batch.column(c)[k].as_py(), "<i4") for c in ("places", "tf"))
                n = batch.column("lengths")[k].values.to_numpy().astype(np.int64)
                m = 100 - 50 + (50 * n * documents) // words
                scores = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m[places])
                blocks = cuts(scores, df)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in ("segment", "doc_id", "terms", "df", "places")], *[pa.array([x.astype("<i4").tobytes()]) for x in (scores, blocks, np.maximum.reduceat(scores, blocks))]], names=["segment", "doc_id", "terms", "df", "places", "scores", "blocks", "highest"])

    with one_row_a_batch(docs.sparkSession):
        return Index(materialize_large(held.drop("documents", "words").mapInArrow(run, schema), "ranked-index"), documents, words)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _blocks_of(queries: DataFrame) -> Iterator[list[tuple]]:
    """Rows of (item_id, terms) in blocks that are bounded in rows and bytes; one partition of queries at a time here."""
    block, held = [], 0
    for item, text in queries.select("item_id", "text").toLocalIterator():
        if block and (len(block) >= QUERIES_AT_ONCE or held + len(text or "") > BYTES_AT_ONCE):
            yield block
            block, held = [], 0
        block.append((item, sorted(set(terms_of(text)))))
        held += len(text or "")
    if block:
        yield block


class _Best:
    """The k best (score, doc_id) of one query so far, best first."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list, ranks: np.ndarray) -> None:
        if len(scores) > self.k:
            chosen = np.lexsort((ranks, -scores))[: self.k]
        else:
            chosen = np.arange(len(scores))
        new = [(-int(scores[i]), ids[i] is not None, ids[i]) for i in chosen.tolist()]
        self.rows = sorted(self.rows + new, key=lambda x: x if x[1] else x[:2])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


class _Segment:
    """One segment, opened for searching. ``read``: blocks read and blocks met, to be looked at in tests."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        value = lambda c: batch.column(c)[k].values
        self.ids, self.terms = value("doc_id"), value("terms")
        self.places, self.scores, self.blocks, self.highest = (np.frombuffer(batch.column(c)[k].as_py(), "<i4") for c in ("places", "scores", "blocks", "highest"))
        df = value("df").to_numpy().astype(np.int64)
        self.list_start = np.concatenate(([0], np.cumsum(df)))
        self.first_block = np.searchsorted(self.blocks, self.list_start)
        self.block_end = np.append(self.blocks[1:], len(self.places)).astype(np.int64)
        self.first_place = self.places[self.blocks]
        self.behind_place = self.places[self.block_end - 1] + 1
        self.ranks = np.empty(len(self.ids), np.int64)
        self.ranks[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        self.met = self.read = 0

    def search(self, rows: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """rows: numbers of the query's terms in this segment."""
        if not len(rows):
            return
        n = len(self.ids)
        count = self.first_block[rows + 1] - self.first_block[rows]
        blocks = np.arange(count.sum()) + np.repeat(self.first_block[rows] - np.cumsum(count) + count, count)
        times = np.repeat(weights, count)
        most = times * self.highest[blocks]
        self.met += len(blocks)
        bound = np.cumsum(np.bincount(self.first_place[blocks], most, n + 1) - np.bincount(self.behind_place[blocks], most, n + 1))[:n]
        live = bound >= best.least
        alive = np.concatenate(([0], np.cumsum(live)))
        kept = alive[self.behind_place[blocks]] > alive[self.first_place[blocks]]
        blocks, times = blocks[kept], times[kept]
        if not len(blocks):
            return
        self.read += len(blocks)
        size = self.block_end[blocks] - self.blocks[blocks]
        at = np.arange(size.sum()) + np.repeat(self.blocks[blocks] - np.cumsum(size) + size, size)
        total = np.bincount(self.places[at], np.repeat(times, size) * self.scores[at], n)  # whole numbers below 2^53
        found = np.flatnonzero(live & (total >= best.least))
        if len(found):
            best.add(total[found].astype(np.int64), self.ids.take(pa.array(found)).to_pylist(), self.ranks[found])


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of ``queries`` (item_id, text)."""
    spark = queries.sparkSession
    item, doc = queries.schema["item_id"].dataType, index.rows.schema["doc_id"].dataType.elementType
    path, documents = shared_path(spark, "ranked"), index.documents
    schema = f"query bigint, item_id {item.simpleString()}, doc_id {doc.simpleString()}, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    before = 0
    for block in _blocks_of(queries):
        known = sorted({t for _, terms in block for t in terms})
        # Documents of each term: lists of one block's terms alone leave the index.
        wanted = spark.createDataFrame([(bytearray(t),) for t in known], "term binary")
        lists = index.rows.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        df = {bytes(r["term"]): r["df"] for r in lists.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        numbers = {t: n for n, t in enumerate(t for t in known if t in df)}
        weights = np.array([weight(df[t], documents) for t in numbers], np.int64)
        asked = [(i, np.array([numbers[t] for t in terms if t in numbers], np.int64)) for i, (_, terms) in enumerate(block)]
        vocabulary, items, start = list(numbers), [x for x, _ in block], before

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(k) for _ in asked]
            known = pa.array(vocabulary, pa.binary())
            ids = None
            for batch in batches:
                for s in range(batch.num_rows):
                    segment = _Segment(batch, s)
                    ids = segment.ids.type
                    place = pc.index_in(known, value_set=segment.terms).fill_null(-1).to_numpy()
                    for q, terms in asked:
                        here = place[terms]
                        held = (here >= 0) & (weights[terms] > 0)
                        segment.search(here[held], weights[terms[held]], best[q])
            if ids is not None:
                rows = [(start + q, q, x[2], -x[0]) for q, b in enumerate(best) for x in b.rows]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], ids), pa.array(columns[3], pa.int64())], names=["query", "at", "doc_id", "score"])

        found = index.rows.mapInArrow(run, f"query bigint, at bigint, doc_id {doc.simpleString()}, score bigint")
        names = spark.createDataFrame(list(enumerate(items)), f"at bigint, item_id {item.simpleString()}")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
        best = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "at")
        with one_row_a_batch(spark):
            best.select("query", "item_id", "doc_id", "score").write.mode("append").parquet(path)
        before += len(block)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return spark.read.schema(schema).parquet(path).select("item_id", place.alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op12_ranked_search": f"""
        WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
        d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
        stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
        q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
        asked AS (SELECT q, item_id, unnest(terms) AS term FROM q),
        postings AS (
            SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, stats GROUP BY term),
        scored AS (
            SELECT q, item_id, r, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
            FROM asked JOIN postings USING (term) JOIN weights USING (term), stats GROUP BY ALL),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
            FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50"""
}
