"""Token-id files by an adaptive context-mixing range coder (operator 7).

Ids are coded in blocks of ``BLOCK``; each starts from a reset model and coder, has a checksum, and needs nothing but its group's header to be decoded.
All blocks of a group run in lockstep: one vectorised step codes the next id of every block.

Model of an id x after ids a, b:
- order 2: the id that last followed (a, b), with a confidence of 0 to 3; order 1: likewise after b.
- order 0: the group's id frequencies, kept in its header.
- "x is the guess of order 2 (of order 1 where order 2 has none)" is one binary event. Its probability mixes what all three
  orders say of that id in the logistic domain, with weights that follow the coding error. "x is the guess of order 1" is a
  second event, where that guess differs.
- otherwise x is coded by order 0 alone.
All arithmetic is on integers, so files don't depend on a machine's floating point.

The coder keeps 56 bits and moves 16 at a time; carries are added to words already put out and spread at the end.

A file is a sequence of groups, each closed by a newline: magic, sizes, document index (doc_id, ids), frequencies, words
and checksum of each block, words. Files are written in ascending doc_id order, null doc_ids first, equal ones by a hash of the text.
They are written and read by Spark's text and binaryFile sources, so any store that Spark knows will do.

Null text: an empty one, the end id alone. A very long text may fill a group by itself. Repeated rows are documents each,
ties in doc_id are ordered by a hash of the text; other columns are ignored; an empty table gives files without groups.
A file is read as one cell of Spark's binaryFile source, so that a partition's coded ids must stay below 2 GB.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.bpe import VOCABULARY
from corvidex.llm.common import materialize, shared_path, table
from corvidex.llm.lockstep import load_lockstep

END = 2
BLOCK = 1024
#: Bytes of texts of a group: what a worker holds at once. A byte gives an id at most, with the end id of each document.
GROUP = 1 << 24
#: Groups of a file, which is read as one cell: so it stays below 2 GB whatever the number of documents.
GROUPS = 64
_SLOTS = 512
_MAGIC = b"CVXR2"
_HEAD = struct.Struct("<5sIIQIII")
_U = np.uint64
#: From 12-bit probabilities to the logistic domain (8 fractional bits) and back.
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
_SQUASH = np.array([min(4080, max(16, round(4096 / (1 + math.exp(-z / 256))))) for z in range(-2047, 2048)], np.int32)


class _Model:
    """The state of all blocks of a group. A slot of an order holds the id that it expects, times 4, plus its confidence."""

    def __init__(self, lanes: int, share_of: np.ndarray) -> None:
        self.at = np.arange(lanes, dtype=np.int64) * _SLOTS
        self.slots1, self.slots2 = np.zeros(lanes * _SLOTS, np.int32), np.zeros(lanes * _SLOTS, np.int32)
        # Of the ids before: products that the slots are computed from.
        self.near, self.far, self.next_far = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.lane8 = np.arange(lanes, dtype=np.int64) * 8
        self.p1, self.p2, self.pb = (np.full(lanes * 8, 2048, np.int32) for _ in range(3))
        self.w0, self.w1, self.w2 = np.full(lanes, 6144, np.int32), np.full(lanes, 32768, np.int32), np.full(lanes, 32768, np.int32)
        self.zero = _STRETCH[np.minimum(share_of >> 4, 4095)]

    def guess(self) -> None:
        self.s1 = (self.near >> 4 & _SLOTS - 1) + self.at
        self.s2 = (self.near + self.far >> 5 & _SLOTS - 1) + self.at
        self.v1, self.v2 = self.slots1.take(self.s1), self.slots2.take(self.s2)
        self.g1, self.g2 = self.v1 >> 2, self.v2 >> 2
        self.c1, self.c2 = self.v1 & 3, self.v2 & 3
        self.g = np.where(self.c2 > 0, self.g2, self.g1)
        same = self.g1 == self.g
        # What each order says of the joint guess.
        self.kb = self.lane8 + self.c1
        self.k1, self.k2 = self.kb + (same.view(np.int8) << 2), self.lane8 + self.c2
        self.q1, self.q2 = self.p1.take(self.k1), self.p2.take(self.k2)
        self.t0, self.t1, self.t2 = self.zero.take(self.g), _STRETCH.take(self.q1), _STRETCH.take(self.q2)
        z = self.w0 * self.t0 + self.w1 * self.t1 + self.w2 * self.t2 >> 16
        self.pa = _SQUASH.take(z + 2047, mode="clip")
        self.other = ~same & (self.c1 > 0)

    def ask(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the second event is coded, and the probability of order 1's guess there."""
        self.asked = np.flatnonzero(self.other & ~hit)
        self.qb = self.pb.take(self.kb.take(self.asked))
        return self.asked, np.minimum(np.maximum(self.qb, 32), 4064).astype(np.uint64)

    def learn(self, x: np.ndarray, hit: np.ndarray, second: np.ndarray) -> None:
        """``second``: the id was order 1's guess, of those that were asked for."""
        bit = hit.astype(np.int32) << 12
        err = bit - self.pa
        for w, t in ((self.w0, self.t0), (self.w1, self.t1), (self.w2, self.t2)):
            w += t * err >> 10
            np.minimum(w, 1 << 17, out=w)
            np.maximum(w, -(1 << 17), out=w)
        self.p1[self.k1] = self.q1 + (bit - self.q1 >> 4)
        self.p2[self.k2] = self.q2 + (bit - self.q2 >> 4)
        self.pb[self.kb.take(self.asked)] = self.qb + ((second.astype(np.int32) << 12) - self.qb >> 4)
        fresh = (x << 2) + 1
        for slots, s, v, g, c in ((self.slots1, self.s1, self.v1, self.g1, self.c1), (self.slots2, self.s2, self.v2, self.g2, self.c2)):
            # Surer by one, or less sure by one, or anew; an empty slot that expects id 0 comes to the same.
            slots[s] = np.where(g == x, v + (c < 3), np.where(c > 1, v - 1, fresh))
        self.near, self.far, self.next_far = x * np.int64(40503), self.next_far, x * np.int64(60493)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of 65536, at least 1 each."""
    n = np.bincount(ids)
    seen = np.flatnonzero(n)
    n = n[seen]
    share = 1 + (n * (65536 - len(seen)) // n.sum())
    share[np.argmax(n)] += 65536 - share.sum()
    return seen, share


def compress(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Frequencies, word counts with checksums, and words, of all blocks of a group."""
    lanes = -(-len(ids) // BLOCK)
    length = np.full(lanes, BLOCK)
    length[-1] = len(ids) - BLOCK * (lanes - 1)
    padded = np.full(lanes * BLOCK, ids[0], np.int32)
    padded[: len(ids)] = ids
    x_of = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    seen, share = frequencies(ids)
    size = int(seen[-1]) + 1
    start_of, share_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    share_of[seen] = share
    start_of[seen] = np.cumsum(share) - share
    model = _Model(lanes, share_of)
    share_of = share_of.astype(np.uint64)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 56, np.uint64)
    # At most 12 + 12 + 16 bits an id, so at most 2.5 words; pages that nothing is written to take no memory.
    most = BLOCK * 5 // 2 + 8
    out, n_out, lane = np.zeros(lanes * most, np.int32), np.arange(lanes, dtype=np.int64) * most, np.arange(lanes)
    top = _U((1 << 56) - 1)

    def put(some: np.ndarray) -> None:
        at, due = n_out.take(some), low.take(some)
        carry = due > top
        if carry.any():
            out[at[carry] - 1] += 1
            due &= top
        out[at] = (due >> _U(40)).astype(np.int32)
        n_out[some] = at + 1
        low[some] = (due & _U((1 << 40) - 1)) << _U(16)
        wide[some] <<= _U(16)

    for t in range(int(length.max())):
        x = x_of[t]
        model.guess()
        hit = model.g == x
        bound = (wide >> _U(12)) * model.pa.astype(np.uint64)
        low += np.where(hit, _U(0), bound)
        wide = np.where(hit, bound, wide - bound)
        plain = ~hit
        asked, pb = model.ask(hit)
        second = model.g1.take(asked) == x.take(asked)
        part = wide.take(asked)
        bound = (part >> _U(12)) * pb
        low[asked] += np.where(second, _U(0), bound)
        wide[asked] = np.where(second, bound, part - bound)
        plain[asked[second]] = False
        unit = wide >> _U(16)
        low += np.where(plain, start_of.take(x) * unit, _U(0))
        wide = np.where(plain, share_of.take(x) * unit, wide)
        model.learn(x, hit, second)
        while len(some := np.flatnonzero(wide < _U(1 << 40))):
            put(some)
    for _ in range(4):
        put(lane)
    # The last block may be shorter than the others: what it coded beyond, a reader leaves alone.
    out, n_out = out.reshape(lanes, most), n_out - lane * most
    for k in range(int(n_out.max()) - 1, 0, -1):
        over = out[:, k] >> 16
        if over.any():
            out[:, k - 1] += over
            out[:, k] &= 0xFFFF
    crc = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(lanes)]
    table_ = zlib.compress(seen.astype("<u4").tobytes() + share.astype("<u4").tobytes(), 1)
    blocks = np.stack([n_out, crc], 1).astype("<u4").tobytes()
    return table_, blocks, b"".join(out[k, :n].astype("<u2").tobytes() for k, n in enumerate(n_out.tolist()))


def decompress(n: int, table_: bytes, blocks: bytes, words: bytes) -> np.ndarray:
    """The ids of a group. Raises ValueError where a block's checksum doesn't fit."""
    sizes, crc = np.frombuffer(blocks, "<u4").reshape(-1, 2).astype(np.int64).T
    lanes = len(sizes)
    flat = np.frombuffer(words, "<u2")
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(zlib.decompress(table_), "<u4").reshape(2, -1).astype(np.int64)
    seen, share = raw
    start = np.cumsum(share) - share
    index_of = np.repeat(np.arange(len(seen)), share)
    seen32, start64, share64 = seen.astype(np.int32), start.astype(np.uint64), share.astype(np.uint64)
    share_of = np.zeros(int(seen[-1]) + 1, np.int64)
    share_of[seen] = share
    model = _Model(lanes, share_of)
    last = begin + sizes
    flat = np.concatenate((flat, np.zeros(8, "<u2"))).astype(np.uint64)
    wide = np.full(lanes, 1 << 56, np.uint64)
    # The first put-out word holds bits 40 to 55: of the 64 read bits the lowest 8 aren't due yet.
    at = begin + 3
    value = (flat[begin] << _U(40)) | (flat[begin + 1] << _U(24)) | (flat[begin + 2] << _U(8)) | (flat[begin + 3] >> _U(8))
    rest = flat[begin + 3] & _U(0xFF)
    out = np.zeros((BLOCK, lanes), np.int32)
    for t in range(min(BLOCK, n)):
        model.guess()
        bound = (wide >> _U(12)) * model.pa.astype(np.uint64)
        hit = value < bound
        value -= np.where(hit, _U(0), bound)
        wide = np.where(hit, bound, wide - bound)
        plain = ~hit
        asked, pb = model.ask(hit)
        part, due = wide.take(asked), value.take(asked)
        bound = (part >> _U(12)) * pb
        second = due < bound
        value[asked] = np.where(second, due, due - bound)
        wide[asked] = np.where(second, bound, part - bound)
        plain[asked[second]] = False
        # Whoever was asked and isn't plain has order 1's guess; so a copy of the guesses, mended, is the result.
        x = model.g.copy()
        x[asked] = model.g1.take(asked)
        some = np.flatnonzero(plain)
        unit, due = wide.take(some) >> _U(16), value.take(some)
        k = index_of.take(np.minimum(due // unit, _U(65535)).astype(np.int64))
        x[some] = seen32.take(k)
        value[some] = due - start64.take(k) * unit
        wide[some] = share64.take(k) * unit
        model.learn(x, hit, second)
        out[t] = x
        while len(some := np.flatnonzero(wide < _U(1 << 40))):
            wide[some] <<= _U(16)
            here = at.take(some) + 1
            at[some] = here
            word = flat.take(np.minimum(here, last.take(some)))
            value[some] = value.take(some) << _U(16) | rest.take(some) << _U(8) | word >> _U(8)
            rest[some] = word & _U(0xFF)
    ids = out.T.reshape(-1)[:n].astype(np.uint32)
    for k in range(lanes):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != crc[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


def pack(doc_ids: list[int | None], lengths: Sequence[int], ids: np.ndarray) -> bytes:
    """One group of a file."""
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    index = zlib.compress(known + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    table_, blocks, words = compress(ids)
    return _HEAD.pack(_MAGIC, len(doc_ids), len(index), len(ids), len(table_), len(blocks), len(words)) + index + table_ + blocks + words


def unpack(content: memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each group of a file."""
    at = 0
    while at < len(content):
        magic, docs, *sizes = _HEAD.unpack(content[at : at + _HEAD.size])
        if magic != _MAGIC:
            raise ValueError("not a token-id file")
        index_size, n, *more = sizes
        at += _HEAD.size
        parts = []
        for size in (index_size, *more):
            parts.append(bytes(content[at : at + size]))
            at += size
        raw = zlib.decompress(parts[0])
        known, doc_id, length = raw[:docs], np.frombuffer(raw[docs : 9 * docs], "<i8"), np.frombuffer(raw[9 * docs :], "<u4")
        yield [int(x) if k else None for k, x in zip(known, doc_id)], length.astype(np.int64), decompress(n, *parts[1:])
        at += 1  # the writer's newline


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, group: int = GROUP, groups: int = GROUPS) -> None:
    """Encode whole texts, close each with ``end``, and write them in ascending doc_id order."""
    # The hash in place of the text: keys are sampled to the driver.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_lockstep(vocabulary)
        names, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            lengths, ids = bpe.texts(texts, end)
            return pa.RecordBatch.from_pydict({"raw": pa.array([pack(names, lengths, ids)], pa.binary())})

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for doc_id, text, n in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), sizes):
                if texts and size + n > group:
                    yield flush()
                    names, texts, size = [], [], 0
                names.append(doc_id)
                texts.append(text)
                size += n
        if texts:
            yield flush()

    dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", groups).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, group, doc_no, start (within the group), n_tokens and ids_crc32 of the documents in files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for g, (doc_ids, length, ids) in enumerate(unpack(memoryview(content.as_buffer()))):
                    start = np.cumsum(length) - length
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist())]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "file": pa.array([name.rsplit("/", 1)[1]] * n, pa.string()), "group": pa.array([g] * n, pa.int64()), "doc_no": pa.array(np.arange(n)), "start": pa.array(start), "n_tokens": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("path", "content").mapInArrow(run, "doc_id bigint, file string, group bigint, doc_no bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "coded")
    write(table(spark, sf_dir, "documents"), path)
    held = materialize(read(spark, path), "read")
    # One row for each group of a file.
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)")]
    before = Window.orderBy(*number, "group").rowsBetween(Window.unboundedPreceding, -1)
    base = held.groupBy("file", "group").agg(F.sum("n_tokens").alias("n")).select("file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(base, ["file", "group"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
