"""Porter's stems against the algorithm's published examples and a plain state machine; search and phrases over stems."""

import random
import re

from pyspark.sql import functions as F

from corvidex.functions.porter import STEP2, STEP3, STEP4, stem, stems
from corvidex.operators import fts
from corvidex.plans import QUERIES

#: Examples of the paper, each through all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def vowels(word):
    """Which letters are vowels, one after the other."""
    out = []
    for i, c in enumerate(word):
        out.append(c in "aeiou" or (c == "y" and i > 0 and not out[-1]))
    return out


def measure(word):
    return len(re.findall("v+c+", "".join("v" if v else "c" for v in vowels(word))))


def short(word):
    return len(word) > 2 and vowels(word)[-3:] == [False, True, False] and word[-1] not in "wxy"


def twin(word):
    return len(word) > 1 and word[-1] == word[-2] and not vowels(word)[-1]


def plain(w):
    if not 3 <= len(w) <= 64:
        return w
    if w[-1] == "s":
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if any(vowels(w[: -len(end)])):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and short(w)):
                        w += "e"
                    elif twin(w) and w[-1] not in "lsz":
                        w = w[:-1]
                break
    if w.endswith("y") and any(vowels(w[:-1])):
        w = w[:-1] + "i"
    for table, least in ((STEP2, 1), (STEP3, 1), (dict.fromkeys(STEP4, ""), 2)):
        end = max((e for e in table if w.endswith(e)), key=len, default="")
        bare = w[: len(w) - len(end)]
        if end and measure(bare) >= least and (end != "ion" or bare.endswith(("s", "t"))):
            w = bare + table[end]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def test_published_examples(spark):
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    got = spark.createDataFrame(pairs, "w string, s string").select("w", "s", stem(F.col("w")).alias("got")).collect()
    assert [(r["w"], r["got"]) for r in got if r["got"] != r["s"]] == []


def test_random_words_match_a_plain_state_machine(spark):
    draw = random.Random(11)
    ends = [*STEP2, *STEP3, *STEP4, "ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "lled", "yy", ""]
    words = ["".join(draw.choice("aeioybstlzrwx") for _ in range(draw.randrange(0, 7))) + draw.choice(ends) + draw.choice(["", "", "s", "ed", "ly"]) for _ in range(6000)] + ["yyyyy", "ayyya", "a" * 70 + "ing", "", "a1s", "2003s"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w")).alias("s")).first()["s"]
    assert [(w, g, plain(w)) for w, g in zip(words, got) if g != plain(w)] == []


def test_nulls(spark):
    rows = spark.createDataFrame([(None, None), (["running", None], "x")], "w array<string>, y string").select(stems(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == [None, ["run", None]]


TEXTS = [(1, "Licensed permissions", "The licenses of running engines, running"), (2, "license", "engine runs of the run"), (3, None, "nothing here"), (4, "running the engine", None), (5, "Running", "engines"), (6, None, None), (7, "", "run the engine run the engines")]


def test_search_meets_other_forms_of_a_word(spark):
    docs = spark.createDataFrame(TEXTS, "id int, title string, body string")
    index = fts.build(docs, "id", {"title": 4.0, "body": 1.0}, stemmed=True)
    assert {r["id"] for r in fts.search(index, "licensing", "id").collect()} == {1, 2}
    tf = {(r["key"], r["tf"]) for r in fts.matches(index, "runner runs").where("prefix = 'run'").selectExpr("id AS key", "tf").collect()}
    assert tf == {(1, 2.0), (2, 2.0), (4, 4.0), (5, 4.0), (7, 2.0)}
    assert fts.search(index, "", "id").count() == 0
    empty = fts.build(docs.where("false"), "id", {"title": 1.0}, stemmed=True)
    assert fts.search(empty, "run", "id").count() == 0


def test_phrases_by_places(spark):
    docs = spark.createDataFrame(TEXTS, "id int, title string, body string").repartition(3)
    places = fts.places(docs, "id", ["title", "body"], stemmed=True)
    ids = lambda q: sorted(r["id"] for r in fts.in_a_row(places, "id", q, stemmed=True).collect())
    assert ids("running engine") == [1]  # of 5 the words lie in two columns
    assert ids("run the engine") == [4, 7] and ids("Run the engines run the engine") == [7]
    assert ids("the run") == [2] and ids("engine of") == [] and ids("") == [] and ids("licensing") == [1, 2]
    exact = fts.places(docs, "id", ["title", "body"])
    assert sorted(r["id"] for r in fts.in_a_row(exact, "id", "run the engines").collect()) == [7]


def test_queries_on_whole_tables(spark, sf):
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in re.findall("[a-z0-9]+", (r["text"] or "").lower())}
    got = {r["term"]: r["stem"] for r in QUERIES["porter_stems"](spark, sf).collect()}
    assert got == {w: plain(w) for w in words}
