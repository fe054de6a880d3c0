import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corvidex.llm import decontaminate, langid, minhash
from corvidex.llm.common import DOCUMENT_COLUMNS, materialize
from tests.llm.test_decontaminate import brute
from tests.llm.test_minhash import brute_classes
from tests.llm.test_quality import brute as brute_quality


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {i: q for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), "test")
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != "bpe":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    assert not any(brute_quality(r["text"])[-1] for r in after)
    lost = [r for r in before if labels.get(r["doc_id"]) == 1 and r["doc_id"] not in kept and not brute_quality(r["text"])[-1]]
    assert not lost
    before, after = seen["language"]
    assert len(after) == len(before)
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after} == set(brute_classes([(r["doc_id"], r["text"]) for r in before]).values())
    before, after = seen["decontamination"]
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    bad = [x[4] for x in brute([r["text"] for r in before], items)]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, x in zip(before, bad) if not x} and any(bad)
    before, after = seen["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in after} == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in before}


def test_nulls_ties_repeats_long_texts_clashing_columns_and_empty_tables(spark, docs_of, sf):
    prose = duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE lang = 'en' AND n_chars BETWEEN 1500 AND 9000 ORDER BY doc_id LIMIT 12").fetchall()
    texts = [t for (t,) in prose]
    rows = [(None, None), (1, None), (2, ""), (3, "short"), (None, texts[0]), *[(10 + i, t) for i, t in enumerate(texts)], (10, texts[0]), (10, texts[0]), (40, " ".join(texts * 20))]
    docs = docs_of(rows).selectExpr("*", "1 AS __quality", "2 AS __words", "3 AS __node", "4 AS __spans", "5 AS quality", "6 AS spans")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "test")
        assert stage(spark, docs.where("false"), sf).count() == 0
        if name == "bpe":
            break
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert {tuple(r)[5:] for r in out.collect()} <= {(1, 2, 3, 4, 5, 6)}
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in out.collect()]
            assert len(ids) == len(set(ids))
        docs = out
    assert docs.count() >= 5


def test_columns_with_dots_and_names_of_the_operators(spark, docs_of, sf):
    [(text,)] = duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE lang = 'en' AND n_chars > 1500 ORDER BY doc_id LIMIT 1").fetchall()
    names = ["a.b", "N_HIT", "Score", "Text_", "lang_PRED", "Contaminated", "x`y", "node"]
    docs = docs_of([(1, text), (2, text), (2, text)]).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "test")
        if name != "bpe":
            assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(names)))}
    assert {"n_hit", "contaminated"} <= set(decontaminate.mark(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit = 0").columns)
    assert langid.identify(docs, langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))).where("score >= 0").count() == 3


def test_which_of_repeated_rows_stays(spark, docs_of):
    docs = docs_of([(1, "a b c d e f g")] * 3).withColumn("source", F.element_at(F.array(F.lit("z"), F.lit("a"), F.lit("k")), (F.monotonically_increasing_id() % 3 + 1).cast("int")))
    docs = docs.coalesce(1)
    want = min(r["source"] for r in docs.collect())
    assert [r["source"] for r in minhash.keep_one(docs).collect()] == [want]
