import zlib

import duckdb
from pyspark.sql import functions as F

from corvidex.llm import sharding


def jump_hash(key, n):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_match_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[x * 7919**4 - 10**15 for x in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 40, 41, 1000):
        got = {r["k"]: r["b"] for r in df.select("k", sharding.jumps(F.col("k"), n)["b"].alias("b")).collect()}
        assert got == {k: jump_hash(k, n) for k in keys}


def test_query(spark, sf):
    rows = sharding.op8_sharding(spark, sf).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    seen = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        seen.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    for own in seen.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert sorted(own) == sorted(own, key=lambda x: x[1])
    assert 0 < sum(r["grown_shard"] == 16 for r in rows) < len(rows) / 5


def test_nulls_ties_and_copies(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 3)
    docs = docs_of([(7, "é")] * 10 + [(None, None)] * 4 + [(1, ""), (1, "x"), (2, None)]).withColumn("slot", F.lit("old"))
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == 17
    assert sum(r["size"] == 3 for r in rows) == 10 and sum(r["doc_id"] is None and r["size"] == 1 and r["text_crc32"] == 0 for r in rows) == 4
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard_documents(docs.where("false")).count() == 0
