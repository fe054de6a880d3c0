import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvidex.llm import rangecoder as r


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 70_000), st.integers(0, 9), st.booleans())
def test_round_trip(n, high, seed, repeats):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, high, n).astype(np.uint32)
    if repeats:
        ids = np.tile(ids[: max(1, n // 7)], 8)
    assert (r.decompress(len(ids), *r.compress(ids)) == ids).all()


def test_repetition_is_learned():
    ids = np.tile(np.arange(40, dtype=np.uint32) * 7, 100)
    assert sum(map(len, r.compress(ids))) < 0.5 * len(ids)


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 5000).astype(np.uint32)
    table, blocks, words = r.compress(ids)
    with pytest.raises(ValueError, match="damaged"):
        r.decompress(len(ids), table, blocks, words[:900] + bytes([words[900] ^ 8]) + words[901:])


def test_query_matches_the_library(spark, sf, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {x["doc_id"]: x for x in r.op7_token_files(spark, sf).collect()}
    at = 0
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (rows[doc_id]["start"], rows[doc_id]["n_tokens"]) == (at, len(ids))
        assert rows[doc_id]["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        at += len(ids)


def test_nulls_repeats_and_groups(spark, docs_of, tmp_path, monkeypatch):
    docs = docs_of([(3, "b c"), (None, "x"), (3, "b c"), (1, None), (2, "")]).selectExpr("*", "1 AS raw").coalesce(1)
    r.write(docs, str(tmp_path / "t"))
    got = sorted(r.read(spark, str(tmp_path / "t")).collect(), key=lambda x: (x["file"], x["group"], x["doc_no"]))
    assert [(x["doc_id"], x["n_tokens"]) for x in got] == [(None, 2), (1, 1), (2, 1), (3, 3), (3, 3)]
    r.write(docs.where("false"), str(tmp_path / "e"))
    assert r.read(spark, str(tmp_path / "e")).count() == 0
    first = r.pack([1, None], [2, 1], np.array([5, 2, 2], np.uint32))
    groups = list(r.unpack(memoryview(first + b"\n" + first + b"\n")))
    assert len(groups) == 2 and groups[1][0] == [1, None] and groups[1][2].tolist() == [5, 2, 2]


def test_files_in_number_order_long_texts_and_clashing_columns(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(r, "GROUP", 500)
    monkeypatch.setattr(r, "table", lambda *_: docs_of([(i, f"w{i} the end") for i in range(40)] + [(50, "the cat sat " * 20_000), (51, None)]).selectExpr("*", "1 AS start", "2 AS file", "3 AS raw"))
    rows = sorted(r.op7_token_files(spark, "").collect(), key=lambda x: x["doc_id"])
    at = 0
    for x in rows:
        assert x["start"] == at
        at += x["n_tokens"]
    assert rows[-2]["n_tokens"] == 60_001 and rows[-1]["n_tokens"] == 1


def test_real_ids_take_less_than_their_order_0_entropy():
    from corvidex.llm.bpe import load

    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    ids = np.concatenate([np.append(load().encode(t), 2) for t in texts]).astype(np.uint32)
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(n * np.log2(n)).sum()
    assert 8 * sum(map(len, r.compress(ids))) / len(ids) < 0.98 * entropy
def test_real_ids_take_less_than_order_0(sf):
    from corvidex.llm.lockstep import load_lockstep

    texts = [x or "" for (x,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()]
    _, ids = load_lockstep().texts(texts, 2)
    n = np.unique(ids, return_counts=True)[1]
    entropy = -(n / len(ids) * np.log2(n / len(ids))).sum() * len(ids) / 8
    table, blocks, words = r.compress(ids)
    # Without the group's table, which is a third of so small a group.
    assert len(blocks) + len(words) < 0.97 * entropy
    assert (r.decompress(len(ids), table, blocks, words) == ids).all()


def test_groups_of_a_file(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text number {i} " * (i % 5)) for i in range(60)] + [(99, "a long text of its own group " * 50)]).coalesce(1)
    got, groups = {}, {}
    for size in (1 << 24, 200):
        r.write(docs, str(tmp_path / str(size)), group=size)
        rows = r.read(spark, str(tmp_path / str(size))).collect()
        got[size] = sorted((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in rows)
        groups[size] = len({(x["file"], x["group"]) for x in rows})
    assert got[200] == got[1 << 24] and len(got[200]) == 61
    assert groups[200] > groups[1 << 24]


def test_several_files_a_partition(spark, sf, monkeypatch):
    want = {tuple(x) for x in r.op7_token_files(spark, sf).collect()}
    write = r.write
    monkeypatch.setattr(r, "write", lambda docs, path: write(docs, path, group=3000, groups=2))
    assert {tuple(x) for x in r.op7_token_files(spark, sf).collect()} == want
