"""BPE encoding and decoding (operator 1).

A backtracking encoder: an Aho-Corasick automaton over the whole vocabulary gives, at each position, the tokens that
match there, longest first; a token is taken if it may stand right of the token before it, by a table of compatible
pairs. A chain of pairwise compatible tokens *is* the merge result, so a dead position stays dead and each is tried
once: exact merges in linear time, without a merge loop. Decoding gathers bytes through an offset table.

The vocabulary file is that of a public tokenizer (BPE with word ends, lower case); its place is a parameter. Where it
is a bare name, ``public_tokenizers.path`` gives the place on each machine.

Null text counts as empty: no ids, an empty decoded text. Special strings in a text give their own ids, as the library
does it, unless ``specials=False``.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import os
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corvidex.llm.common import by_batch, table

VOCABULARY = "word_bpe_49k.json"
#: Distinct white-space separated strings whose ids a worker keeps, twice over: at the limit it starts anew and takes
#: back from the generation before what occurs again.
CACHED = 120_000
#: The same for words of letters, digits or signs, whose merging costs the most.
PIECES = 170_000
#: Longer strings are encoded each time and never kept, so that both caches are bounded in bytes too: with some 60 bytes
#: of overhead for a key, an entry and its ids each, about 120 MB at most.
LONGEST = 48

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: str.split() also cuts at these four; the tokenizer's white space lacks them.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
#: What the tokenizer takes for white space beyond ASCII, and all of it.
RARE_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE = regex.compile(r"[\t-\r " + RARE_SPACE[1:-1] + "]+")
_UNIT = 0x100


def resolve(vocabulary: str) -> str:
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in set(shown) else chr(next(rest)) for b in range(256))


class WordBpe:
    """Encoder and decoder for one vocabulary file.

    ``ids`` of a token: its place in the file. ``order``: base units first, then merges by rank.
    """

    def __init__(self, path: str, specials: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        inner, last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        base = sorted({*inner, *last})
        self.order = {t: i for i, t in enumerate(base)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        units = {t: chr(_UNIT + self.order[t]) for t in base}
        for i, (left, right) in enumerate(model["merges"]):
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = t
            if t not in self.order:
                self.order[t], self.parts[t], units[t] = len(base) + i, (a, b), units[a] + units[b]
        self.pairs: dict[int, bool] = {}
        # A token that its own units don't merge into can't occur in a result.
        sound: set[int] = set(base)
        self.matches = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for t in sorted(units, key=self.order.__getitem__):
            if t in self.parts and self.parts[t][0] in sound and self.parts[t][1] in sound and self._stays(*self.parts[t], self.order[t]):
                sound.add(t)
            if t in sound:
                self.matches.add_word(units[t], (len(units[t]), t))
                self.whole[units[t]] = t
        self.matches.make_automaton()
        # The longest other token that a token begins with, to fall back on.
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for name, t in self.whole.items():
            k = next((k for k in range(len(name) - 1, 0, -1) if name[:k] in self.whole), 0)
            self.shorter[t] = (k, self.whole[name[:k]]) if k else None
        self.inner = "".join(units[t] for t in inner)
        self.last = [units[t] for t in last]
        self.specials = added if specials else {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if self.specials else None
        size = 1 + max([*vocab.values(), *added.values()])
        names = [b""] * size
        for name, t in [*vocab.items(), *added.items()]:
            names[t] = name.encode() + b" "
        self.size = size
        self.letters = np.frombuffer(b"".join(names), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def _stays(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins what touches at the border of ``a`` and ``b``; undoes merges from the last."""
        order, parts, merged = self.order, self.parts, self.merged
        while True:
            t = merged.get((a, b))
            if t is not None and order[t] < limit:
                return False
            if order[a] > order[b]:
                if a not in parts:
                    return True
                limit = min(limit, order[a])
                a = parts[a][1]
            else:
                if b not in parts:
                    return True
                limit = min(limit, order[b] + 1)  # of equal merges the left one comes first
                b = parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        held = self.pairs.get(key)
        if held is None:
            if len(self.pairs) >= 2 * CACHED:
                self.pairs.clear()
            held = self.pairs[key] = self._stays(a, b, 1 << 60)
        return held

    def merge(self, units: str) -> list[int]:
        """The ids of one word in base units."""
        one = self.whole.get(units)
        if one is not None:
            return [one]
        # Where the longest tokens follow each other; other positions are looked up when the search comes there.
        longest = {at - match[0] + 1: match for at, match in self.matches.iter_long(units)}
        n, pairs, shorter = len(units), self.pairs, self.shorter
        dead: set[int] = set()
        path: list[tuple[int, int]] = []
        pos, before = 0, -1
        option = longest[0]
        while True:
            while option:
                length, t = option
                if pos + length not in dead:
                    fits = before < 0 or pairs.get(before << 32 | t)
                    if fits or fits is None and self.compatible(before, t):
                        break
                option = shorter[t]
            if option:
                path.append((pos, t))
                pos, before = pos + length, t
                if pos == n:
                    return [t for _, t in path]
                option = longest.get(pos) or self._longest(units, pos)
            else:
                dead.add(pos)
                pos, t = path.pop()
                before = path[-1][1] if path else -1
                option = self.shorter[t]

    def _longest(self, units: str, pos: int) -> tuple[int, int]:
        rest = units[pos:]
        k = self.matches.longest_prefix(rest)
        while rest[:k] not in self.whole:
            k -= 1
        return k, self.whole[rest[:k]]

    def _piece(self, piece: str) -> bytes:
        held = self.pieces.get(piece)
        if held is None:
            if len(self.pieces) >= PIECES:
                self.older, self.pieces = self.pieces, {}
            held = self.older.pop(piece, None)
            if held is None:
                raw = piece.encode()
                units = codecs.charmap_decode(raw, "strict", self.inner)[0][:-1] + self.last[raw[-1]]
                ids = self.merge(units)
                held = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= LONGEST:
                self.pieces[piece] = held
        return held

    def chunk(self, chunk: str) -> bytes:
        """The ids, as little-endian 32-bit integers, of a string without white space."""
        if self.special and any(x in chunk for x in self.specials):
            parts = self.special.split(chunk)
            return b"".join(self.specials[x].to_bytes(4, "little") if x in self.specials else self.chunk(x) for x in parts if x)
        if chunk.isascii():
            return b"".join(map(self._piece, _ASCII_PIECE.findall(chunk.lower())))
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower() has a rule of its own for a last sigma
        return b"".join(map(self._piece, _PIECE.findall(chunk.lower())))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        chunks = text.split() if not _NOT_SPACE.search(text) else [x for x in SPACE.split(text) if x]
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: tokens in their vocabulary form, a space between, through the offset table."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(start - ends + length, length)
        return self.letters[at[:-1]].tobytes()


class _Chunks(dict):
    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.bpe.chunk(chunk)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        got = self.old.pop(chunk, None)
        if got is None:
            got = self.bpe.chunk(chunk)
        self[chunk] = got
        return got


#: Fixed value: how the byte-level vocabulary's tokenizer cuts texts; its white space is Unicode's, not Python's.
_BYTE_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^_S\p{L}\p{N}]+|[_S]+(?![^_S])|[_S]+".replace("_S", r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))


class ByteBpe(WordBpe):
    """For a byte-level vocabulary without word ends: nothing is normalised or left out, so ids give the text back, and the
    bytes of each token its place in it."""

    def __init__(self, path: str) -> None:
        super().__init__(path, specials=False)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(vocab.values())] = [len(name) for name in vocab]
        self.chunk = self._piece

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, _BYTE_PIECE.findall(text))) if text else b""

    def offsets_of(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First character of each token and the one behind its last, n x 2; a character that tokens share counts for each."""
        raw = np.frombuffer(text.encode(), np.uint8)
        characters = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))
        end = np.cumsum(self.bytes_of[ids])
        begin = end - self.bytes_of[ids]
        return np.stack([characters[begin + 1] - 1, characters[end]], 1) if len(ids) else np.zeros((0, 2), np.int64)


@functools.lru_cache(maxsize=1)
def load_bytes(vocabulary: str) -> ByteBpe:
    return ByteBpe(resolve(vocabulary))


@functools.lru_cache(maxsize=2)
def load(vocabulary: str = VOCABULARY, specials: bool = True) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(resolve(vocabulary), specials)


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again; no shuffle, one pass, memory for one Arrow batch.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded (string).
    Null texts are empty ones, repeated rows give repeated rows, an empty table an empty one; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocabulary)
        n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            raw = bpe.encode_bytes(text)
            ids = np.frombuffer(raw, "<u4")
            decoded = bpe.decode_bytes(ids)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(raw).hexdigest())
            text_hash.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                all_ids.append(ids.astype(np.int32))
                texts.append(decoded.decode())
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if with_ids:
            columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_pydict(columns)

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
