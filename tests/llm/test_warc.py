import duckdb
from pyspark.sql import functions as F

from corvidex.llm import warc

SCHEMA = "record_id bigint, url string, ts bigint, status int, headers array<struct<name:string,value:string>>, body string"


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(warc.ORACLES["op4_revisits"]).fetchall())
    got = sorted(tuple(r) for r in warc.op4_revisits(spark, sf).collect())
    assert got == want and len({r[3] for r in got}) > 1


def test_url_key(spark):
    urls = ["HTTP://WWW.Ex.org:80/a/?b=2&utm_source=x&a=1#f", "https://ex.org/a?a=1&b=2", "//ex.org/a/?a=1&&b=2", "ex.org/a", "https://ex.org", ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["ex.org/a?a=1&b=2"] * 3 + ["ex.org/a", "ex.org", ""]


def test_as_of_validators_and_headers(spark):
    u = "http://x.org/a"
    full = lambda i, ts, etag, url=u: (i, url, ts, 200, [("ETag", etag), ("Content-Length", "9"), ("Vary", "a"), ("vary", "b")], "body")
    rows = [full(1, 10, '"a"'), full(2, 20, 'W/"b"'), full(3, 20, '"c"'), full(9, 5, '"z"', "http://y.org")]
    seen = lambda i, ts, h, url=u: (i, url, ts, 304, h, None)
    rows += [seen(11, 10, [("ETag", '"a"')]), seen(12, 11, [("etag", 'W/"a"'), ("Vary", "n"), ("Content-Length", "0")]), seen(13, 21, [("ETag", '"b"')]), seen(14, 30, [("ETag", '"c"')]), seen(14, 30, [("ETag", '"c"')]), seen(15, 30, None), seen(16, None, [("ETag", '"c"')]), seen(17, 30, [("ETag", '"c"')], None), (18, u, 1, 404, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS url_key")
    got = sorted(((r["record_id"], r["base_record_id"], r["outcome"], None if r["headers"] is None else sorted(tuple(h) for h in r["headers"])) for r in warc.resolve(df).collect()), key=str)
    a = [("content-length", "9"), ("etag", 'W/"a"'), ("vary", "n")]
    c = [("content-length", "9"), ("etag", '"c"'), ("vary", "a"), ("vary", "b")]
    assert got == [(11, None, "no_base", None), (12, 1, "resolved", a), (13, 3, "mismatch", None), (14, 3, "resolved", c), (14, 3, "resolved", c), (15, 3, "unvalidated", None), (16, None, "no_base", None), (17, None, "no_base", None)]
    assert warc.resolve(df.where("false")).count() == 0


def test_a_hot_url_over_many_ranges(spark):
    n = 400
    rows = [(i, "http://h.org/", i, 200 if i % 10 == 0 else 304, [("ETag", f'"{i // 10}"')], None) for i in range(n)]
    got = {r["record_id"]: (r["base_record_id"], r["outcome"]) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (i - i % 10, "resolved") for i in range(n) if i % 10}
