"""Texts to pieces, and texts to hashed vectors."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X

DIMENSIONS = 384


def by_size(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the end of the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    rows = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("body", F.substr(F.col(text), F.col("chunk") * step + 1, F.lit(size)))


def messages(rows: DataFrame, key: str, order: str, text: str, size: int) -> DataFrame:
    """Whole messages to chunks in order: a new chunk begins where a message would make it longer than ``size``; only a single
    message may exceed it. Of each conversation only the lengths are gathered, in one row."""
    lengths = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n")))).alias("m"))
    start = F.struct(F.array().cast("array<bigint>").alias("chunks"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("filled"))

    def place(acc, x):
        new = (acc["chunk"] < 0) | (acc["filled"] + x["n"] > size)
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(F.concat(acc["chunks"], F.array(chunk)).alias("chunks"), chunk.alias("chunk"), (F.when(new, 0).otherwise(acc["filled"]) + x["n"]).alias("filled"))

    placed = lengths.select(key, "m", F.aggregate("m", start, place)["chunks"].alias("c"))
    each = placed.select(key, F.explode(F.arrays_zip(F.col("c").alias("chunk"), F.transform("m", lambda x: x["n"]).alias("n"))).alias("z"))
    return each.groupBy(key, F.col("z.chunk").alias("chunk")).agg(F.count("*").alias("turns"), F.sum("z.n").alias("chars"))


def slices(text: str, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` characters that give the text back, cut before the last heading, else behind the last blank
    line, else behind the last line end."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(at + size, len(text))
        if end < len(text):
            part = text[at:end]
            heading, blank, line = part.rfind("\n#"), part.rfind("\n\n"), part.rfind("\n")
            end = at + (heading + 1 if heading > 0 else blank + 2 if blank > 0 else line + 1 if line > 0 else size)
        out.append((at, end))
        at = end
        if not text:
            break
    return out


def by_lines(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, chunk, start, body: each text cut by ``slices``; a text's slices stay within its row's batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, t[a:b]) for k, t in zip(pdf[key], pdf[text].fillna("")) for i, (a, b) in enumerate(slices(t, size))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "body"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, start int, body string")


def worth_chunking(text: Column, least_tokens: int = 1000, density: float = 100.0) -> Column:
    """Whether a text is large and has many capitalised words for its size."""
    return (X.tokens(text) >= least_tokens) & (X.density(text) >= density)


def fields(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each field of a record that isn't empty: id (key and field), field, text. A map, not a union of scans."""
    listed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])
    filled = F.filter(listed, lambda x: x["text"].isNotNull() & (x["text"] != ""))
    each = rows.select(F.col(key), F.explode(filled).alias("f"))
    return each.select(F.concat_ws("_", F.col(key).cast("string"), "f.field").alias("id"), key, "f.field", "f.text")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs, then sentences, then characters, packed up to ``size``, each piece led in by the end of the last."""
    parts: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        pieces = [paragraph] if len(paragraph) <= size else re.split(r"(?<=[.!?])\s+", paragraph)
        for piece in pieces:
            parts += [piece[i : i + size] for i in range(0, max(1, len(piece)), size)]
    out, now = [], ""
    for part in parts:
        if now and len(now) + len(part) + 1 > size:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = f"{tail} {part}" if len(tail) + len(part) < size else part
        else:
            now = f"{now}\n{part}" if now else part
    return [*out, now] if now or not out else out


def by_structure(docs: DataFrame, key: str, text: str, size: int = 12_000, overlap: int = 800) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, x) for k, t in zip(pdf[key], pdf[text]) for i, x in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "body"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, body string")


def json_elements(rows: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each element of a JSON array, or each field of an object."""
    array, fields = F.from_json(column, "array<string>"), F.map_values(F.from_json(column, "map<string,string>"))
    return rows.select(key, F.explode(F.when(F.trim(column).startswith("["), array).otherwise(fields)).alias("element"))


#: Fixed value: the bucket's name for a text without words.
NOTHING = "<empty>"


def _slot(feature: str, dimensions: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return h % dimensions, 1.0 if h >> 63 else -1.0


def light_stem(word: str) -> str:
    return next((word[: -len(x)] for x in X.SUFFIXES if word.endswith(x) and len(word) > len(x) + 2), word)


def embed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Stems 1, pairs of stems 0.5, letter triples of padded stems 0.25, into signed buckets; of unit length. Identifiers are
    taken apart; a text without words has one bucket of its own."""
    split = re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text or "").replace("_", " ").lower()
    stems = [light_stem(w) for w in re.findall("[a-z0-9]+", split)]
    weights = {f"w:{w}": float(n) for w, n in Counter(stems).items()}
    weights |= {f"b:{a} {b}": 0.5 * n for (a, b), n in Counter(zip(stems, stems[1:])).items()}
    triples = Counter(p[i : i + 3] for p in (f"#{w}#" for w in stems) for i in range(max(1, len(p) - 2)))
    weights |= {f"c:{x}": 0.25 * n for x, n in triples.items()}
    out = np.zeros(dimensions)
    for feature, weight in weights.items():
        at, sign = _slot(feature, dimensions)
        out[at] += sign * weight
    size = np.linalg.norm(out)
    if size:
        return out / size
    out[_slot(NOTHING, dimensions)[0]] = 1.0
    return out


#: Bytes of texts that ``embed_all`` works on at once.
AT_ONCE = 1 << 22
#: Signs of padded stems, in the order of their numbers.
_SIGNS = "#0123456789abcdefghijklmnopqrstuvwxyz"
_NUMBER = np.zeros(256, np.int64)
_NUMBER[[ord(x) for x in _SIGNS]] = np.arange(len(_SIGNS))
#: The only characters beyond ASCII with a letter or digit of ASCII in lower case.
_ODD = re.compile("[\u0130\u212a]")


def _slots(features: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """``_slot`` of each."""
    h = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in features]), "<u8")
    return (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


@functools.lru_cache(maxsize=4)
def _triples(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    return _slots([f"c:{a}{b}{c}".encode() for a in _SIGNS for b in _SIGNS for c in _SIGNS], dimensions)


def _stems(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each word its text and its stem's number; the different stems."""
    parts = [(re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", x).lower() if _ODD.search(x) else x).encode() for x in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    small = (raw >= 97) & (raw <= 122) | (raw >= 48) & (raw <= 57)
    inside = upper | small
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | small[:-1] & upper[1:]
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in parts]), np.flatnonzero(begins), "right")
    letters = (raw + upper * np.uint8(32))[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(owner), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    stems: dict[str, int] = {}
    number = np.array([stems.setdefault(light_stem(w), len(stems)) for w in words.dictionary.to_pylist()], np.int64)
    return owner, number[words.indices.to_numpy()] if len(owner) else owner, list(stems)


def embed_all(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """``embed`` of each, a row each. Weights are multiples of a quarter, so that the order of sums doesn't matter."""
    out = np.zeros(len(texts) * dimensions)
    owner, stem, stems = _stems(texts)
    if stems:
        at = owner * dimensions
        slot, sign = _slots([b"w:" + x.encode() for x in stems], dimensions)
        out += np.bincount(at + slot[stem], sign[stem], len(out))
        pairs = pa.array((stem[:-1] << 32 | stem[1:])[owner[:-1] == owner[1:]]).dictionary_encode()
        if len(pairs):
            bare = [x.encode() for x in stems]
            slot, sign = _slots([b"b:%b %b" % (bare[x >> 32], bare[x & 0xFFFFFFFF]) for x in pairs.dictionary.to_pylist()], dimensions)
            code = pairs.indices.to_numpy()
            out += np.bincount(at[:-1][owner[:-1] == owner[1:]] + slot[code], 0.5 * sign[code], len(out))
        # Each stem has as many triples as letters; they lie side by side, that of its first letter before the others.
        padded = _NUMBER[np.frombuffer("".join([f"#{x}#" for x in stems]).encode(), np.uint8)]
        size = np.array([len(x) for x in stems])
        ends = np.cumsum(size + 2)
        triple = (padded[:-2] * len(_SIGNS) + padded[1:-1]) * len(_SIGNS) + padded[2:]
        n = size[stem]
        place = np.arange(n.sum()) + np.repeat((ends - size - 2)[stem] - np.cumsum(n) + n, n)
        slot, sign = _triples(dimensions)
        code = triple[place]
        out += np.bincount(np.repeat(at, n) + slot[code], 0.25 * sign[code], len(out))
    out = out.reshape(len(texts), dimensions)
    length = np.sqrt((out * out).sum(1))
    out[length == 0, _slot(NOTHING, dimensions)[0]] = 1.0
    return out / np.where(length == 0, 1.0, length)[:, None]


def hash_embed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``embed`` of each text as array<float>; texts are taken together in groups of ``AT_ONCE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pc.fill_null(batch.column(1), "")
            number = (np.cumsum(pc.binary_length(whole).to_numpy().astype(np.int64)) - 1) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(whole)]
            for a, b in zip(cuts, cuts[1:]):
                rows = embed_all(whole[a:b].to_pylist()).astype(np.float32)
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))], [key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, embedding array<float>")
