import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corvidex.llm import tokenfiles
from corvidex.llm.bpe import load


def test_query_matches_the_library(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    rows = tokenfiles.op2_token_counts(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r["file"], []).append((r["doc_no"], r["start"], r["n_tokens"]))
    for own in by.values():
        at = 0
        for k, (doc_no, start, n) in enumerate(sorted(own)):
            assert (doc_no, start) == (k, at)
            at += n + 1


@pytest.mark.parametrize("block", [2, 6, 10, 4096])
def test_any_block_size_gives_the_same_counts(spark, tmp_path, block):
    docs = [[], [1, 2, 3], [], [5] * 20, [7], []]
    ids = [x for d in docs for x in [*d, tokenfiles.END]]
    (tmp_path / "part-00000.txt").write_bytes(np.asarray(ids, "<u2").tobytes())
    (tmp_path / "part-00001.txt").write_bytes(b"")
    rows = sorted(tokenfiles.count(spark, str(tmp_path), block=block).collect(), key=lambda r: r["doc_no"])
    assert [r["n_tokens"] for r in rows] == [len(d) for d in docs]
    assert [r["start"] for r in rows] == [0, 1, 5, 6, 27, 29]


def test_nulls_repeats_and_specials(spark, docs_of, tmp_path):
    docs = docs_of([None, "", "a b", "a b", "x <|endoftext|> y", None]).coalesce(1)
    tokenfiles.write(docs, str(tmp_path / "t"))
    rows = sorted(tokenfiles.count(spark, str(tmp_path / "t")).collect(), key=lambda r: r["doc_no"])
    assert [r["n_tokens"] for r in rows][:4] == [0, 0, 2, 2] and len(rows) == 6 and rows[4]["n_tokens"] > 3
    tokenfiles.write(docs.where("false"), str(tmp_path / "e"))
    assert tokenfiles.count(spark, str(tmp_path / "e")).count() == 0


def test_long_texts_and_clashing_columns(spark, docs_of, tmp_path):
    docs = docs_of(["the cat sat " * 20_000, "a", None]).selectExpr("*", "1 AS file", "2 AS raw", "3 AS value", "4 AS doc_no").coalesce(1)
    tokenfiles.write(docs, str(tmp_path / "t"))
    rows = sorted(tokenfiles.count(spark, str(tmp_path / "t"), block=1000).collect(), key=lambda r: r["doc_no"])
    assert [r["n_tokens"] for r in rows] == [60_000, 1, 0]


def test_several_files_a_partition(spark, docs_of, tmp_path):
    texts = ["a " * (i % 5) for i in range(50)]
    path = str(tmp_path / "docs")
    docs_of(texts).coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    tokenfiles.write(docs, str(tmp_path / "t"), file=4)
    rows = tokenfiles.named(spark, docs, str(tmp_path / "t"), 4).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: i % 5 for i in range(50)} and len(rows) == 50
    assert len({r["file"] for r in rows}) >= 13


def test_writing_keeps_no_strings_and_groups_change_nothing(spark, docs_of, tmp_path, monkeypatch):
    texts = ["the cat", None, "x" * 300, "", "a <|endoftext|> b", " é Σ", "It's", None]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for group in (1, 100, 1 << 21):
        monkeypatch.setattr(tokenfiles, "GROUP", group)
        path = str(tmp_path / f"t{group}")
        tokenfiles.write(docs_of(texts).coalesce(1), path)
        rows = sorted(tokenfiles.count(spark, path).collect(), key=lambda r: r["doc_no"])
        assert [r["n_tokens"] for r in rows] == want
    encode = tokenfiles.encoded(tokenfiles.VOCABULARY, tokenfiles.END)
    encode(pa.RecordBatch.from_pydict({"text": [f"word{i} other{i}." for i in range(3_000)]}))
    assert not load(tokenfiles.VOCABULARY, False).chunks
