import zlib

import numpy as np
from pyspark.sql import functions as F

from corvidex.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_filter_holds_every_member_and_corrects_false_hits():
    gram = np.arange(5000, dtype=np.uint32) * 7919
    model = langid.Model.build(["a", "b"], [("a", gram), ("b", gram[:10])], "a")
    at = langid.slots(gram)
    hit = model.masks[at[0], 0] & model.masks[at[1], 0] & model.masks[at[2], 0]
    assert (hit & np.uint64(1)).all()
    assert (hit[:10] == 3).all() and (hit >> np.uint64(1)).sum() < 15


def test_more_than_64_languages():
    names = [f"l{i:03}" for i in range(70)]
    word = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 4
    grams = {x: langid.grams([word(i).encode()])[0] for i, x in enumerate(names)}
    model = langid.Model.build(names, list(grams.items()), names[0])
    assert model.predict([word(69)])[0] == ["l069"]


def test_nulls_letters_and_extra_columns(spark, docs_of):
    docs = docs_of([None, "", "12 %", "hello there general", "hello there general", "日本"]).withColumn("score", F.lit("old"))
    got = langid.identify(docs, langid.learn(docs)).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", "en"]
    assert got[3]["score"] == 1.0 and got[5]["score"] == 0.0
    none = langid.learn(docs.where("false"))
    assert [r["lang_pred"] for r in langid.identify(docs, none).collect()] == ["und"] * 6
    kept = langid.identify(docs, langid.learn(docs), keep=True, least=0.1)
    assert kept.columns == docs.columns and kept.count() == 2
    assert langid.identify(docs.where("false"), none).count() == 0


def test_counts_scores_and_verdicts_against_exact_sets(spark):
    """What the filters say, against plain sets of n-grams on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    model = langid.learn(docs)
    texts = [r["text"] for r in docs.select("text").collect()] + ["le chat " * 60_000, "die der das und the of and " * 3]
    every = np.unique(np.concatenate([langid.grams([langid._folded(t)])[0] for t in texts]))
    sets = {}
    for i, name in enumerate(model.languages):  # a filter's members, found gram by gram
        sets[name] = {int(g) for g in every if all(int(model.masks[s[0], i // 64]) >> i % 64 & 1 for s in langid.slots(np.array([g], np.uint32)))}
    names, scores, known = model.read(texts)
    for text, name, score, share in zip(texts, names, scores, known):
        raw = langid._folded(text)
        own = langid.grams([raw])[0].tolist()
        counts = {}
        for i, lang in enumerate(model.languages):
            hits = sum(g in sets[lang] for g in own)
            counts[lang] = max(0.0, (hits - len(own) * model.false[i]) / (1 - model.false[i]))
        total = sum(counts.values())
        if total:
            best = max(model.languages, key=lambda x: counts[x])
            assert name == best and abs(score - counts[best] / total) < 1e-9 and abs(share - counts[best] / len(own)) < 1e-9
    padded = b" " + langid._folded("ab cd") + b" "
    assert sorted(langid.grams([langid._folded("ab cd")])[0].tolist()) == sorted(int.from_bytes(x, "little") for x in (b" ab ", b" cd "))
    assert padded == b" ab cd "


def test_other_languages_and_noise_are_dropped(spark, docs_of):
    """The pipeline's stage: documents that it must drop."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    planted = docs_of([(-1, "Minulla on koira ja kissa, jotka asuvat talossa meren rannalla. " * 5), (-2, "xq zvk qjj wxz kqv zzx " * 20), (-3, "12 34 %% !!"), (-4, None)]).withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.union(planted), None).collect()}
    assert not kept & {-1, -2, -3, -4} and len(kept) > 0.95 * docs.count()


def test_every_labelled_row_is_learned_from(spark):
    """2,500 rows of a language, each with a word of its own, twice: all of their n-grams are counted."""
    word = lambda i: "q" + chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26)
    rows = spark.createDataFrame([(f"{word(i)} {word(i)}", "aa") for i in range(2500)] + [("zzzz zzzz", "bb")], "text string, lang string")
    for model in (langid.learn(rows), langid.learn_with_floor(rows)[0]):
        names, scores = model.predict([word(i) for i in range(2500)])
        assert set(names) == {"aa"} and min(scores) > 0
