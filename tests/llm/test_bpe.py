import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvidex.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


ODD = ["", " ", "\x1ca\x1f b", "a b\x85c", "İSTANBUL ΣΑΣ ς", "é é", "日本語 \U0001f600🏽", "x<|endoftext|>y <|startoftext|>", "it's I'LL 'd ''s", "aaaaaaaaa" * 50, "#" * 99, "½ ² ٣ १२", "a\x00b\x7f", "​﻿x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_match_the_library(library, text):
    ids = bpe.load().encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.load().decode_bytes(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=60) | st.text(alphabet="abehinorst '<|>!#$\n", max_size=80))
def test_any_text_matches_the_library(text):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)) if not hasattr(bpe, "_kept") else bpe._kept
    bpe._kept = library
    assert bpe.load().encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_matches_the_library(spark, sf, library):
    rows = {r["doc_id"]: r for r in bpe.op1_bpe(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[doc_id]["n_tokens"] == len(ids)
        assert rows[doc_id]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_extra_columns(spark, docs_of):
    docs = docs_of([(1, None), (None, "a b"), (1, None), (2, "")]).selectExpr("*", "1 AS n_tokens", "text AS ids")
    rows = sorted(bpe.encode_decode(docs, with_ids=True).collect(), key=str)
    assert [r["n_tokens"] for r in rows] == [0, 0, 0, 2]
    assert rows[-1]["decoded"] == "a</w> b</w>"
    assert bpe.encode_decode(docs.where("false")).count() == 0


@pytest.mark.parametrize("text", ["the cat sat, " * 60_000, "thandingblend" * 3_000, "日本語" * 4_000, "=-" * 8_000, "x" * 20_001 + " " * 100_000 + "y"], ids=["words", "one word", "no spaces", "signs", "blanks"])
def test_very_long_texts(library, text):
    own = bpe.load()
    held = len(own.chunks), len(own.pieces)
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode_bytes(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)
    assert len(own.chunks) <= held[0] + 3 and max(map(len, own.pieces)) <= bpe.LONGEST and max(map(len, own.chunks)) <= bpe.LONGEST


def test_small_caches_take_back_what_occurs_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "CACHED", 20)
    own = bpe.WordBpe(bpe.resolve(bpe.VOCABULARY))
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda units: merged.append(units) or merge(units))
    text = " ".join(f"again, {'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}x" for i in range(100))
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    # "," occurs in a chunk that is itself kept; the words in between are new each time.
    assert max(merged.count(x) for x in set(merged)) == 1
    assert len(own.pieces) <= 20 and len(own.older) <= 20 and len(own.pairs) <= 40
    own.encode("again again, again; again. again! again? again: " * 3)
    assert merged.count(merged[0]) <= 2
