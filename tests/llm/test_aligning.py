"""Token alignment against both libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvidex.llm import aligning

A = Tokenizer.from_file(public_tokenizers.path(aligning.BYTES))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(aligning.PIECES))


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}


BYTE_OF = letters()


def bytes_a(t):
    return bytes(BYTE_OF[c] for c in A.id_to_token(t))


def bytes_b(t):
    name = B.id_to_piece(t)
    return bytes([int(name[3:5], 16)]) if B.is_byte(t) else name.replace("▁", " ").encode()


def tokens(text):
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    return (a, b) if b"".join(map(bytes_a, a)) == raw == b"".join(map(bytes_b, b)) else ([], [])


def grouped(a, b):
    ends = [list(accumulate(len(f(t)) for t in ids)) for ids, f in ((a, bytes_a), (b, bytes_b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        k = 0
        for t, end in zip(ids, ends[side]):
            while end > cuts[k]:
                k += 1
            out[k][side].append(t)
    return out


def plain(rows):
    docs = [(i, *tokens(text)) for i, text in rows]
    groups = [grouped(a, b) for _, a, b in docs]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in groups]
    held = Counter(pair for x in links for pair in x)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (i, a, b), g, x in zip(docs, groups, links):
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        row = i, len(a), len(b), len(g), sum(x.values()), sum(n for p, n in x.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x.items())
        out[(*row, hashlib.sha256(written.encode()).hexdigest() if g else "")] += 1
    return out


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r) for r in df.collect())


ODD = [
    None, "", " ", "  ", "\n", "\r\n", "\t", " a", "a ", "a  b", "a\r\n\r\nb \r c", "a\n b\n\nc", "don't we'll ▁ here", "▁", "x▁y", "\x00\x01", "ﬁ ① é é", "日本語の文です。", "नमस्ते दुनिया", "😀👍🏽",
    "<s> </s> <unk> <0x41> <|endoftext|>", "　wide　space", "a\xa0b c\x85d", "a\x1cb", "1234567890" * 5, "_" * 70, "=" * 500, "aAaA" * 300, "supercalifragilistic " * 40, "​﻿", "();\r\n});\r\n", "tab\tsep\tvalues \t x",
]


def test_odd_texts_nulls_repeated_rows(spark, docs_of):
    rows = list(enumerate(ODD)) + [(3, "a  b"), (None, "a  b"), (50, "a  b"), (50, "a  b")]
    assert got(aligning.align(docs_of(rows))) == plain(rows)


def test_chunks_give_what_whole_texts_give():
    pair = aligning.load(aligning.BYTES, aligning.PIECES)
    assert pair.b.chunked
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choices(["a", "B", "the", " ", "  ", "\n", "\r", "\t", ";", "}", "1", "é", "　", "\xa0", "日", "'s", "_"], k=draw.randint(1, 25)))
        [(a, b, _)] = pair.encode([text])
        assert (a.tolist(), b.tolist()) == tokens(text)


def test_very_long_texts_and_large_groups(spark, docs_of):
    draw = random.Random(2)
    long = " ".join("".join(draw.choices("abcdeé", k=draw.randint(1, 9))) for _ in range(30_000))
    rows = [(1, long), (2, "".join(draw.choices("कखगाी", k=4000))), (3, "ab" * 5000), (4, "short")]
    assert got(aligning.align(docs_of(rows))) == plain(rows)


@pytest.mark.parametrize("large", [0, 1, 3])
def test_groups_above_any_bound_of_links(large, monkeypatch):
    monkeypatch.setattr(aligning, "LARGE", large)
    pair = aligning.load(aligning.BYTES, aligning.PIECES)
    for text in ODD:
        x = aligning.Aligned(pair, ["first one", text, "last"])
        want = [Counter((p, q) for left, right in grouped(*tokens(t)) for p in left for q in right) for t in ("first one", text, "last")]
        for k in range(3):
            mine = slice(x.first[k], x.first[k + 1])
            assert {divmod(int(p), 1 << 16): int(n) for p, n in zip(x.pairs[x.at[mine]], x.times[mine])} == want[k]


def test_block_size_does_not_matter_nor_do_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(aligning.op13_token_alignment(spark, sf)) == want
    named = docs.withColumns({"N_A": F.lit(1), "a.b": F.lit(2), "block": F.lit(3)}).repartition(5)
    assert got(aligning.align(named, size=9000)) == want


def test_empty_table(spark, docs_of):
    assert got(aligning.align(docs_of([]))) == Counter()
