"""Batch search by blocks of queries, against plain Python."""

from corvidex.operators import retrieval
from corvidex.plans import QUERIES


def test_blocks_of_queries_give_all_of_them(spark):
    vectors = {i: [((i * 7 + j * 3) % 11) / 11 - 0.5 for j in range(4)] for i in range(57)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    queries = spark.createDataFrame([(i, vectors[i]) for i in range(0, 57, 8)], "query_id long, query array<double>")
    want = set()
    for i in range(0, 57, 8):
        best = sorted((-round(sum(a * b for a, b in zip(vectors[i], v)), 9), j) for j, v in vectors.items())[:3]
        want |= {(i, j, k) for k, (_, j) in enumerate(best, 1)}
    for block in (1, 3, 4, 8, 100):
        assert {(r["query_id"], r["id"], r["k"]) for r in retrieval.batch_top(df, queries, "id", "v", 3, block).collect()} == want
    assert retrieval.batch_top(df, queries.where("false"), "id", "v", 3).count() == 0


def test_every_fiftieth_vector_is_a_query(spark, sf):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    got = QUERIES["vector_batch_topk"](spark, sf).collect()
    assert {r["query_id"] for r in got} == ids and len(got) == 5 * len(ids)
