"""The pipeline's language stage on texts of no learned language."""

import random

import corpus_pipeline

FOREIGN = [
    "minä olen syntynyt pienessä kylässä ja asun nyt suuressa kaupungissa jossa työskentelen opettajana ja luen paljon kirjoja",
    "dzisiaj rano poszedłem do sklepu kupić chleb mleko oraz ser a potem wróciłem do domu żeby przygotować śniadanie dla rodziny",
    "bugün sabah erken kalktım ve markete gidip ekmek süt ve peynir aldım sonra eve dönüp kahvaltı hazırladım",
]


def test_other_languages_and_letter_noise_go(spark, sf):
    draw = random.Random(3)
    noise = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(n)) for n in (20, 60, 300)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL AND length(text) > 40").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(-1 - i, x, None, "web", len(x)) for i, x in enumerate(FOREIGN + noise)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.union(odd), sf).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
