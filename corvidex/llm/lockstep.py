"""Many words at once by the merge rule itself, in lockstep: for files of ids (operators 2 and 7).

Texts are cut at white space, each different string gets a number, and only these strings are encoded: cut into words,
the different words laid out by length, one row each. A step looks for the pair of lowest rank in every row, the left one
of equals, merges it, and looks up the two pairs that arise; rows without a pair are done. That is the definition of BPE,
so results equal those of the backtracking encoder, whose linear time long words and special strings go back to.

Memory is that of a group of texts: nothing is kept from one to the next.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corvidex.llm.bpe import RARE_SPACE, SPACE, VOCABULARY, WordBpe, load

#: Words of more bytes are left to the backtracking encoder: steps times bytes would be quadratic.
LONGEST_ROW = 64
#: Bytes of the rows that are merged at once.
ROWS = 1 << 20
_NEVER = np.int32(2**31 - 1)
_PIECE = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
_ASCII_PIECE = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``pool``, one after the other."""
    end = np.cumsum(length)
    return pool[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + length, length)]


class Lockstep:
    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe
        pairs = np.array([a << 32 | b for a, b in bpe.merged], np.int64)
        self.result = np.array(list(bpe.merged.values()), np.int32)
        # Open addressing: a place holds the rank of a merge or one past the last, and whether a key had to go on from it.
        self.bits = max(12, int(len(pairs)).bit_length() + 3)
        self.slots = np.full(1 << self.bits, len(pairs), np.int32)
        self.full = np.zeros(1 << self.bits, bool)
        self.keys = np.append(pairs, -1)
        left, self.probes = np.arange(len(pairs), dtype=np.int32), 0
        while len(left):
            at = self._place(pairs[left], self.probes)
            free = np.flatnonzero(self.slots[at] == len(pairs))
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            self.full[at[lost]] = True
            left = left[lost]
            self.probes += 1
        self.inner = np.array([bpe.whole[x] for x in bpe.inner], np.int32)
        self.last = np.array([bpe.whole[x] for x in bpe.last], np.int32)

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys ^ (keys >> 15)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * probe * 0x632BE59BD9B4E019 & 2**64 - 1)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the merge of each pair; ``_NEVER`` where there is none."""
        keys = a.astype(np.int64) << 32 | b
        at = self._place(keys, 0)
        found = self.slots[at]
        out = np.where(self.keys[found] == keys, found, _NEVER)
        open_ = np.flatnonzero(self.full[at] & (out == _NEVER))
        for probe in range(1, self.probes):
            found = self.slots[self._place(keys[open_], probe)]
            out[open_] = np.where(self.keys[found] == keys[open_], found, out[open_])
        return out

    def rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each row, ids) of words of one length: ``raw`` has a row of bytes each."""
        n, size = raw.shape
        token = self.inner[raw]
        token[:, -1] = self.last[raw[:, -1]]
        if size == 1:
            return np.ones(n, np.int64), token[:, 0]
        rank = np.full((n, size), _NEVER)
        rank[:, :-1] = self.rank(token[:, :-1].reshape(-1), token[:, 1:].reshape(-1)).reshape(n, size - 1)
        # Neighbours in each row; the column ``size`` stands for none.
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        alive = np.ones((n, size), bool)
        row = np.arange(n)
        while True:
            at = rank[row].argmin(1) if len(row) < n else rank.argmin(1)
            best = rank[row, at]
            some = np.flatnonzero(best != _NEVER)
            if not len(some):
                return alive.sum(1), token[alive]
            row, at, best = row[some], at[some], best[some]
            gone, merged = after[row, at], self.result[best]
            behind, ahead = after[row, gone], before[row, at]
            token[row, at] = merged
            alive[row, gone] = False
            rank[row, gone] = _NEVER
            after[row, at] = behind
            more = behind < size
            before[row[more], behind[more]] = at[more]
            fresh = np.full(len(row), _NEVER)
            fresh[more] = self.rank(merged[more], token[row[more], behind[more]])
            rank[row, at] = fresh
            more = ahead >= 0
            rank[row[more], ahead[more]] = self.rank(token[row[more], ahead[more]], merged[more])

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, pool): where the ids of each different word lie."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        begin, size = offsets[:-1], np.diff(offsets)
        length, pool = np.zeros(len(words), np.int64), []
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(1, LONGEST_ROW + 2))
        for k in range(1, LONGEST_ROW + 1):
            step = max(1, ROWS // k)
            for a in range(cuts[k - 1], cuts[k], step):
                some = order[a : min(a + step, cuts[k])]
                length[some], ids = self.rows(data[begin[some, None] + np.arange(k)])
                pool.append(ids)
        for i in order[cuts[LONGEST_ROW] :].tolist():
            ids = np.frombuffer(self.bpe._piece(words[i].as_py()), "<u4").astype(np.int32)
            length[i] = len(ids)
            pool.append(ids)
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return start, length, np.concatenate(pool) if pool else np.zeros(0, np.int32)

    def strings(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each, ids) of strings without white space that hold no special string."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), " ")[0].as_py()
        if joined.isascii():
            cut = _ASCII_PIECE.findall(joined.lower())
        else:
            cut = _PIECE.findall(unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower())
        coded = pa.array(cut, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy()
        gap = coded.dictionary.index(" ").as_py()
        start, length, pool = self.words(coded.dictionary)
        inside = code != gap
        owner = np.cumsum(~inside)[inside]
        code = code[inside]
        n = np.bincount(owner, length[code], len(strings)).astype(np.int64)
        return n, gather(pool, start[code], length[code])

    def texts(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each, ids) of whole texts, each closed by ``end``."""
        whole = pa.array(texts, pa.string())
        rare = pc.match_substring_regex(whole, RARE_SPACE).to_numpy(zero_copy_only=False)
        if rare.any():
            whole = pa.array([SPACE.sub(" ", x) if odd else x for x, odd in zip(texts, rare)], pa.string())
        cut = pc.ascii_split_whitespace(whole)
        coded = cut.values.dictionary_encode()
        strings = coded.dictionary
        marked = np.zeros(len(strings), bool)
        for name in self.bpe.specials:
            marked |= pc.match_substring(strings, name).to_numpy(zero_copy_only=False)
        ascii_ = pc.string_is_ascii(strings).to_numpy(zero_copy_only=False)
        # The end is number 0. Blanks at a text's ends leave empty strings, without ids.
        start, length, pool, held = np.zeros(len(strings) + 1, np.int64), np.zeros(len(strings) + 1, np.int64), [np.array([end], np.int32)], 1
        length[0] = 1
        plain = ~marked & (pc.binary_length(strings).to_numpy() > 0)
        for mask in (plain & ascii_, plain & ~ascii_):
            at = np.flatnonzero(mask)
            if not len(at):
                continue
            n, ids = self.strings(strings.take(pa.array(at)))
            length[at + 1], start[at + 1] = n, held + np.cumsum(n) - n
            pool.append(ids)
            held += len(ids)
        for i in np.flatnonzero(marked).tolist():
            ids = np.frombuffer(self.bpe.chunk(strings[i].as_py()), "<u4").astype(np.int32)
            length[i + 1], start[i + 1] = len(ids), held
            pool.append(ids)
            held += len(ids)
        sizes = np.diff(cut.offsets.to_numpy()).astype(np.int64)
        codes = np.insert(coded.indices.to_numpy().astype(np.int64) + 1, np.cumsum(sizes), 0)
        lengths = length[codes]
        ends = np.cumsum(lengths)[np.cumsum(sizes + 1) - 1]
        return np.diff(ends, prepend=0), gather(np.concatenate(pool), start[codes], lengths)


@functools.lru_cache(maxsize=1)
def load_lockstep(vocabulary: str = VOCABULARY, specials: bool = True) -> Lockstep:
    return Lockstep(load(vocabulary, specials))
