"""Cross-tokenizer alignment (operator 13).

Whole documents of an Arrow batch are concatenated as bytes; the ends of the tokens of both tokenizers are counted for each
byte offset (one bincount a side); where both occur is a cut, and the number of cuts before a token's end is its group. A
prefix sum over the cuts gives each document's groups as a difference at its borders. All links of a group are counted as a
product; pairs of ids are written out only for small groups, and for large ones from their different ids with their counts.

How many documents hold a pair linked is counted over all documents without sending every document's pairs around: a batch
is one row of a written table, with its documents' different pairs as numbers into its list of pairs. The lists are shuffled
by pair and summed, the sums go back to the batches that have the pair (one row a batch and pair, however many documents),
and each batch then works out its documents' results.

Tokenizer A is a byte-level BPE file (its merges are given to tiktoken as ranks); B a sentencepiece model with byte fallback. Both encode
strings between spaces, which a cache holds; that no merge crosses such a border is checked of the vocabulary at load, and
whole texts are encoded where it doesn't hold.

Null and empty texts, and those whose tokens don't give space + text (for instance with U+2581, which B reads as a space)
have no tokens: zeros and an empty groups_sha256. Repeated rows are documents of their own, in counts too. An empty table
gives an empty one. Other columns are ignored, whatever their names. Memory is that of a batch of ``BLOCK`` bytes, or of the
longest text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm.bpe import LONGEST, RARE_SPACE, byte_letters, resolve
from corvidex.llm.common import materialize, table

BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at once; a longer text is a block of its own.
BLOCK = 2_000_000
#: Different chunks whose ids a worker keeps, twice over; longer ones than ``LONGEST`` aren't kept.
CACHED = 200_000
#: Tokens whose digits are written at once, but for those of a longer document.
WRITTEN = 200_000
#: Groups of more links than this give their pairs from different ids and counts.
LARGE = 1024

#: Fixed value: how A's tokenizer cuts texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The white space of tokenizer A's pattern, and that of it which is no border: all but a newline and a plain space.
_SPACE = "\\t-\\r " + RARE_SPACE[1:-1]
_OTHER = "\\t\\x0b-\\r" + RARE_SPACE[1:-1]
#: A string that begins with white space, up to the next space or newline behind a character that is none.
_CHUNK = re.compile(f"[{_SPACE}]*(?:[^{_SPACE}]+(?:[{_OTHER}][{_SPACE}]*)?)+|[{_SPACE}]+")


class Bytes:
    """A byte-level BPE file; its ids are the ranks of its merges, which is checked at load."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in name): i for name, i in model["vocab"].items() if all(c in byte_of for c in name)}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        if any(model["vocab"][left + right] != 256 + i for i, (left, right) in enumerate(pairs)):
            raise ValueError("ids aren't in the order of merges")
        ranks = {raw: i for raw, i in ranks.items() if i < 256 + len(model["merges"])}
        self.encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(1 + max(ranks.values()), np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]


class Pieces:
    """A sentencepiece model that encodes chunks of texts: ``encode(chunks)`` as if each stood within a text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.names = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.names], np.int64)
        plain = [x for i, x in enumerate(names) if not self.model.is_byte(i) and not self.model.is_control(i)]
        # Borders hold if a space stands in no piece behind another character, and a newline in none at all.
        self.chunked = not any("\n" in x or re.search("[^\u2581]\u2581", x) for x in plain)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """The model puts a space before what it is given: take one off, or take its token off."""
        spaced = [x[0] == " " for x in chunks]
        found = self.model.encode([x[1:] if s else x for x, s in zip(chunks, spaced)], num_threads=1)
        space = self.model.piece_to_id("\u2581")
        return [(ids or [space]) if s else ids[1:] for ids, s in zip(found, spaced)]


class Pair(dict):
    """Ids of both tokenizers by chunk, as little-endian 32-bit integers. Two generations of ``CACHED`` chunks are kept."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Bytes(resolve(a)), Pieces(resolve(b))
        self.lengths = (self.a.lengths, self.b.lengths)
        self.bad: set[str] = set()
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.digits = [_Digits(len(x)) for x in self.lengths]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that aren't held; ``bad`` gets those that B doesn't give back."""
        for chunk, a, b in zip(chunks, map(self.a.encode, chunks), self.b.encode(chunks)):
            if b"".join([self.b.names[t] for t in b]) != chunk.encode():
                self.bad.add(chunk)
            self[chunk] = struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Ids of both for space + text and the length in bytes; none if the tokens don't give the bytes back."""
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        cut = _CHUNK.findall if self.b.chunked else lambda x: [x]
        chunks = [cut(" " + x) if x else [] for x in texts]
        new = list(set().union(*chunks).difference(self))
        self.update({x: self.old[x] for x in new if x in self.old})
        self.learn([x for x in new if x not in self])
        out = [self._one(text, x) for text, x in zip(texts, chunks)]
        for x in new:
            if len(x) > LONGEST:
                del self[x]
                self.bad.discard(x)
        if len(self.bad) > CACHED:
            self.bad.clear()  # what the caches hold may be bad
            self.clear()
            self.old.clear()
        return out

    def _one(self, text: str | None, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none, 0
        got = list(map(self.__getitem__, chunks))
        a, b = (np.frombuffer(b"".join(x), "<u4") for x in zip(*got))
        size = len(text.encode()) + 1
        if self.lengths[0][a].sum() != size or self.lengths[1][b].sum() != size:
            return none, none, 0
        if self.bad and not self.bad.isdisjoint(chunks) and b"".join([self.b.names[t] for t in b]) != (" " + text).encode():
            return none, none, 0
        return a, b, size


class _Digits:
    """Decimal ids with one sign behind each, through an offset table."""

    def __init__(self, size: int) -> None:
        names = [b"%d," % i for i in range(size)]
        self.letters = np.frombuffer(b"".join(names), np.uint8)
        self.length = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.length) - self.length


@functools.lru_cache(maxsize=1)
def load(a: str, b: str) -> Pair:
    return Pair(a, b)


def _ranged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Aligned:
    """Documents of one block: groups, links, digests, and the different pairs of each with their number of links."""

    def __init__(self, pair: Pair, texts: list[str | None]) -> None:
        encoded = pair.encode(texts)
        a, b = (np.concatenate([x[side] for x in encoded]).astype(np.int64) for side in (0, 1))
        self.n = [np.array([len(x[side]) for x in encoded], np.int64) for side in (0, 1)]
        borders = np.concatenate(([0], np.cumsum([x[2] for x in encoded]))).astype(np.int64)
        ends = [np.cumsum(pair.lengths[side][ids]) for side, ids in ((0, a), (1, b))]
        at = [np.bincount(x, minlength=borders[-1] + 1) > 0 for x in ends]
        cuts = np.cumsum(at[0] & at[1])
        self.n_groups = cuts[borders[1:]] - cuts[borders[:-1]]
        group = [cuts[x - 1] for x in ends]
        total = int(cuts[-1])
        count = [np.bincount(x, minlength=total) for x in group]
        links = count[0] * count[1]
        self.n_links = self._each(links, cuts, borders)
        self.sha256 = self._digests(pair, a, b, group, count, cuts, borders)
        self._pairs(a, b, group, count, links, cuts, borders)

    @staticmethod
    def _each(of_group: np.ndarray, cuts: np.ndarray, borders: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of_group)))
        return sums[cuts[borders[1:]]] - sums[cuts[borders[:-1]]]

    def _digests(self, pair: Pair, a: np.ndarray, b: np.ndarray, group: list, count: list, cuts: np.ndarray, borders: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups in writing, a run of documents at a time."""
        tokens = [np.concatenate(([0], np.cumsum(x))) for x in self.n]
        groups = cuts[borders]
        runs = np.unique(np.searchsorted(tokens[0] + tokens[1], np.arange(0, tokens[0][-1] + tokens[1][-1], WRITTEN)))
        out = []
        for i, j in zip(runs.tolist(), [*runs[1:].tolist(), len(self.n[0])]):
            mine = [slice(x[i], x[j]) for x in tokens]
            of = slice(groups[i], groups[j])
            ends = np.cumsum(self.n[0][i:j] + self.n[1][i:j])
            out += self._written(pair, (a[mine[0]], b[mine[1]]), [g[x] - groups[i] for g, x in zip(group, mine)], [x[of] for x in count], ends)
        return out + [""] * (len(self.n[0]) - len(out))

    @staticmethod
    def _written(pair: Pair, ids: tuple[np.ndarray, np.ndarray], group: list, count: list, ends: np.ndarray) -> list[str]:
        """A's ids of a group stand before B's, a sign behind each."""
        before = [np.concatenate(([0], np.cumsum(x))) for x in count]
        place = np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]
        n = len(ids[0]) + len(ids[1])
        length, start, signs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        for side in (0, 1):
            length[place[side]], start[place[side]] = pair.digits[side].length[ids[side]], pair.digits[side].start[ids[side]]
        signs[place[0][before[0][1:] - 1]] = ord("|")
        signs[place[1][before[1][1:] - 1]] = ord(";")
        written = np.cumsum(length)
        out = np.zeros(written[-1] if n else 0, np.uint8)
        for side, where in enumerate(place):
            out[_ranged(written[where] - length[where], length[where])] = pair.digits[side].letters[_ranged(start[where], length[where])]
        out[written - 1] = signs
        raw, written, ends = out.tobytes(), np.concatenate(([0], written)), [0, *ends.tolist()]
        return [hashlib.sha256(raw[written[x] : written[y] - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]

    def _pairs(self, a: np.ndarray, b: np.ndarray, group: list, count: list, links: np.ndarray, cuts: np.ndarray, borders: np.ndarray) -> None:
        document = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        small = links <= LARGE
        first = [np.cumsum(x) - x for x in count]
        chosen = small[group[0]]
        g = group[0][chosen]
        partners = count[1][g]
        wide = 1 << 32
        keys = [np.repeat(document[g] * wide + (a[chosen] << 16), partners) + b[_ranged(first[1][g], partners)]]
        times = [np.ones(len(keys[0]), np.int64)]
        for k in np.flatnonzero(~small):
            ids = [np.unique(x[first[side][k] : first[side][k] + count[side][k]], return_counts=True) for side, x in ((0, a), (1, b))]
            keys.append((document[k] * wide + (ids[0][0] << 16)[:, None] + ids[1][0][None, :]).ravel())
            times.append((ids[0][1][:, None] * ids[1][1][None, :]).ravel())
        if len(keys) == 1:
            key = np.sort(keys[0])
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
        else:
            key, many = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times = np.add.reduceat(many[order], new)
        key = key[new]
        self.pairs, self.at, self.documents = np.unique(key & (wide - 1), return_inverse=True, return_counts=True)
        self.times = times
        self.first = np.searchsorted(key >> 32, np.arange(len(self.n_groups) + 1))


def _squeezed(x: np.ndarray, kind: str) -> bytes:
    return pa.compress(np.ascontiguousarray(x, kind).tobytes(), "zstd", asbytes=True)


def _opened(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def blocks(docs: DataFrame, a: str = BYTES, b: str = PIECES, size: int = BLOCK) -> DataFrame:
    """One row a block of documents: their own results, their pairs, and how many of them have each pair."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, first array<bigint>, n_pairs bigint, pairs binary, documents binary, at binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = load(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end] or "") <= size):
                    held += len(texts[end] or "")
                    end += 1
                x = Aligned(pair, texts[start:end])
                # Within a document numbers rise, so their differences are small.
                steps = np.diff(x.at, prepend=0)
                row = {
                    "block": [number], "doc_id": pa.array([ids[start:end].to_pylist()], pa.list_(ids.type)), "n_a": [x.n[0].tolist()], "n_b": [x.n[1].tolist()], "n_groups": [x.n_groups.tolist()], "n_links": [x.n_links.tolist()],
                    "groups_sha256": [x.sha256], "first": [x.first.tolist()], "n_pairs": [len(x.pairs)], "pairs": [_squeezed(np.diff(x.pairs, prepend=0), "<i8")], "documents": [_squeezed(x.documents, "<i4")], "at": [_squeezed(steps, "<i4")], "times": [_squeezed(x.times, "<i8")],
                }
                yield pa.RecordBatch.from_pydict(row)
                number += 1
                start = end

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_rows(of_blocks: DataFrame) -> DataFrame:
    """block, pair (A's id * 65536 + B's), its place in the block and the block's documents that have it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_pairs"]
                pairs, documents = np.cumsum(_opened(row["pairs"], "<i8", n)), _opened(row["documents"], "<i4", n)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(n, row["block"])), "pair": pa.array(pairs), "place": pa.array(np.arange(n, dtype=np.int32)), "documents": pa.array(documents)})

    return of_blocks.select("block", "n_pairs", "pairs", "documents").mapInArrow(run, "block bigint, pair bigint, place int, documents int")


def counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that have it linked) and whether it is the highest of its A id."""
    summed = rows.groupBy("pair").agg(F.sum("documents").alias("count")).withColumn("a", F.shiftright("pair", 16))
    highest = summed.groupBy("a").agg(F.max("count").alias("highest"))
    return summed.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a: str = BYTES, b: str = PIECES, size: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = materialize(blocks(docs, a, b, size), "aligned")
    rows = pair_rows(held)
    back = rows.select("block", "pair", "place").join(counts(rows), "pair").select("block", "place", "count", "best")
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_batches():
            for x in row.to_pylist():
                n = x["n_pairs"]
                count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                place = right.column("place").to_numpy()
                count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
                first = np.array(x["first"])
                at, times = np.cumsum(_opened(x["at"], "<i4", first[-1])), _opened(x["times"], "<i8", first[-1])
                sums = [np.concatenate(([0], np.cumsum(times * v[at]))) for v in (count, best)]
                values = {c: x[c] for c in ("n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[1][first[1:]] - sums[1][first[:-1]], "count_sum": sums[0][first[1:]] - sums[0][first[:-1]]}
                ids = row.column("doc_id").type.value_type
                out.append(pa.table({"doc_id": pa.array(x["doc_id"], ids)} | {c: pa.array(v, pa.int64()) for c, v in values.items()} | {"groups_sha256": pa.array(x["groups_sha256"], pa.string())}))
        return pa.concat_tables(out)

    ours = held.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "n_pairs", "at", "times")
    return ours.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
