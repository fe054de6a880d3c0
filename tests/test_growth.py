"""Steps whose work must grow with their rows and not with pairs of rows: how many rows any node of the plan gives, and results
against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvidex.operators import chunks, fts, graph, linking, memory, relational, resolution
from corvidex.sources import tables


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return nodes(plan.plan())
    made, children = plan.metrics().get("numOutputRows"), plan.children()
    return ([made.get().value()] if made.isDefined() else []) + [n for i in range(children.size()) for n in nodes(children.apply(i))]


def most_rows(df):
    df.collect()
    return max(nodes(df._jdf.queryExecution().executedPlan()))


def test_reconcile_makes_no_pairs_of_copies(spark):
    old = spark.range(2000).select("id", F.lit("k").alias("k"), F.concat(F.lit("red bolt "), F.col("id") % 3).alias("text"))
    new = spark.range(2000).select("id", F.lit("k").alias("k"), F.concat(F.lit("bolt red "), F.col("id") % 4).alias("text"))
    out = memory.reconcile(old, new, "k")
    got = {r["id"]: (r["event"], r["old_id"]) for r in out.collect()}
    assert got == {i: ("NONE", i % 4) if i % 4 < 3 else ("UPDATE", 0) for i in range(2000)}
    assert most_rows(out) <= 4000


def folder(path):
    return path.rpartition("/")[0]


def test_nearest_against_brute_force_without_pairs(spark):
    draw = random.Random(5)
    paths = [f"{a}{b}f{i % 4}" for a in ("", "a/", "a/b/", "c/") for b in ("", "x/", "x/y/") for i in range(4)]
    calls = [(i, draw.choice(paths), "n") for i in range(900)]
    declared = [(i, draw.choice(paths), "n") for i in range(9)] + [(100 + i, f"q{i}/z/f", "n") for i in range(900)]
    want = {}
    for call, at, _ in calls:
        def tier(there):
            a, b = folder(at), folder(there)
            if at == there:
                return 1_000_001
            if a == b:
                return 1_000_000
            same = 0
            for x, y in zip(a.split("/"), b.split("/")) if a and b else ():
                if x != y:
                    break
                same += 1
            return same
        best = max(tier(p) for _, p, _ in declared)
        found = [i for i, p, _ in declared if tier(p) == best]
        if best > 0 and len(found) == 1:
            want[call] = found[0]
    out = linking.nearest(spark.createDataFrame(calls, "call long, file string, name string"), spark.createDataFrame(declared, "id long, file string, name string"))
    assert want and {r["call"]: r["id"] for r in out.collect()} == want
    assert most_rows(out) <= 9000


def test_across_repositories_without_pairs(spark):
    calls = spark.range(1500).select(F.col("id").alias("call"), (F.col("id") % 3).alias("repo"), F.lit("n").alias("name"))
    declared = spark.range(1500).select(F.lit(0).cast("long").alias("repo"), F.col("id"), F.lit("n").alias("name")).union(spark.createDataFrame([(1, 7, "n")], "repo long, id long, name string"))
    out = linking.across(calls, declared, ["name"])
    assert {(r["repo"], r["call"], r["id"]) for r in out.collect()} == {(0, c, 7) for c in range(0, 1500, 3)}
    assert most_rows(out) <= 3000


def test_sum_in_order_does_not_depend_on_partitions(spark):
    rows = [(1, i, v) for i, v in enumerate([1e16, 1.0, -1e16, 1.0, 0.3, None])] + [(2, 1, None)]
    want, df = ((1e16 + 1.0) - 1e16) + 1.0 + 0.3, spark.createDataFrame(rows, "k long, o long, v double")
    for dealt in (df.coalesce(1), df.repartition(5), df.orderBy(F.desc("o"))):
        assert {r["k"]: r["s"] for r in dealt.groupBy("k").agg(relational.sum_in_order("v", "o").alias("s")).collect()} == {1: want, 2: None}


def test_alike_names_against_brute_force(spark):
    draw = random.Random(3)
    names = ["".join(draw.choice("abcde") for _ in range(n)) for n in [*range(3, 60, 3)] * 3]
    names += [x[:-1] for x in names] + [x + "z" for x in names] + [x[:20] + "qq" + x[20:] for x in names]
    grams = {i: {x[k : k + 3] for k in range(max(1, len(x) - 2))} for i, x in enumerate(names)}
    df = spark.createDataFrame([(i, sorted(g)) for i, g in grams.items()], "id long, grams array<string>")
    best = {}
    for i, a in grams.items():
        alike = [(len(a & b) / len(a | b), -k) for k, b in grams.items() if k % 2 and len(a & b) / len(a | b) >= 0.9]
        if alike:
            best[i] = max(alike)
    rows = resolution.candidates(df, df.where("id % 2 = 1")).groupBy("id").agg(F.max(F.struct("jaccard", (-F.col("known_id")).alias("k"))).alias("m")).collect()
    assert {r["id"]: (r["m"]["jaccard"], r["m"]["k"]) for r in rows} == best


def test_alike_names_of_one_template_meet_few_others(spark):
    rows = spark.range(3000).select("id", resolution.grams(F.concat(F.lit("large ring economy brand "), F.col("id") * 331 + 100_000)).alias("grams"))
    marks = resolution._marks(rows, "id").groupBy("mark").agg(F.count("*").alias("n"))
    assert marks.agg(F.sum(F.col("n") * F.col("n"))).first()[0] < 3000 * 3000 / 4


def test_general_labels_link_where_none_are_left_out(spark):
    texts = spark.createDataFrame([(1, "total time of the parser")], "k long, t string")
    labels = spark.createDataFrame([("time", 1), ("parser", 2)], "label string, id long")
    links = lambda **more: sorted(r["label"] for r in linking.mention_links(texts, labels, "k", "t", **more).collect())
    assert links() == ["parser"] and links(general=()) == ["parser", "time"]


def test_postings_of_one_folder_are_written_by_several_tasks(spark):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[F.concat(F.lit("aa"), F.xxhash64("id", F.lit(i))) for i in range(20)]).alias("text"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100kb")
    try:
        postings = fts.build(docs, "id", {"text": 1.0}, expand=False).postings
    finally:
        spark.conf.set(size, before)
    one = postings.where(postings["term"].startswith("aa"))
    assert one.select("folder").distinct().count() == 1
    assert one.select(F.input_file_name()).distinct().count() > 2


def test_invalidation_scores_blocks_and_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolution, "FACTS_AT_ONCE", 50)
    monkeypatch.setattr(resolution, "NEW_AT_ONCE", 7)
    draw = random.Random(8)
    vectors = [[float(draw.randint(-2, 2)) for _ in range(3)] for _ in range(20)] + [[0.0, 0.0, 0.0], None]
    rows = [(i, draw.choice([1, 1, 1, 2, None]), draw.choice([1, 3, 4]), draw.choice(vectors)) for i in range(400)]
    facts = spark.createDataFrame(rows, "id long, src int, dst int, v array<double>")

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    want = []
    for i, s, d, v in rows[::5]:
        mine = [(-cosine(v, w), j) for j, a, b, w in rows if v and w and j != i and {s, d} & {a, b} - {None}]
        want += [(i, j, -c) for c, j in sorted(mine)[:3] if -c > 0.1]
    out = resolution.invalidation_candidates(facts.where("id % 5 = 0"), facts, "v", 0.1, 3)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert most_rows(out) <= 400 * 2 * 12  # blocks of new facts, not new facts


def test_large_inputs_are_dealt_into_more_parts_with_the_same_results(spark, monkeypatch):
    draw = random.Random(4)
    rows = spark.createDataFrame([(draw.randrange(20), 100 + draw.randrange(30), draw.choice("RN")) for _ in range(300)], "src long, dst long, r string")
    edges = rows.select("src", "dst", F.when(F.col("r") == "R", "AMBIGUOUS").alias("confidence"))
    groups = spark.range(130).select("id", (F.col("id") % 7).alias("community"))
    queries = (lambda: graph.label_propagation(edges, 3), lambda: graph.open_questions(groups.select("id"), edges, groups), lambda: relational.cooccurrence(rows, "src", "dst"))
    few = [sorted(map(tuple, q().collect())) for q in queries]
    monkeypatch.setattr(tables, "ROWS_A_TASK", 20)
    assert [sorted(map(tuple, q().collect())) for q in queries] == few
    assert tables.dealt(edges, 300, "src").rdd.getNumPartitions() == 15


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_places_are_gathered_within_rows_and_shuffled_once(spark, monkeypatch):
    draw, seen = random.Random(6), []
    monkeypatch.setattr(fts, "written", lambda df, label, by=(): seen.append(df) or tables.written(df, label, by))
    texts = [(i, " ".join(draw.choice(["Run", "running", "runs", "a", "the", "ties", "x" * 70]) for _ in range(draw.randrange(60)))) for i in range(40)] + [(40, None), (41, " . ")]
    docs = spark.createDataFrame(texts, "id long, text string")
    stem = {"running": "run", "runs": "run", "ties": "ti"}
    for stemmed in (False, True):
        want = {}
        for i, t in texts:
            for at, w in enumerate(w.lower() for w in (t or "").split() if w != "."):
                want.setdefault((stem.get(w, w) if stemmed else w, i), []).append(at)
        out = fts.places(docs, "id", ["text"], stemmed=stemmed)
        assert {(r["term"], r["id"]): r["at"] for r in out.collect()} == want
        assert out.count() == len(want)
    assert [exchanges(df) for df in seen] == [1, 1]
    assert not any("Aggregate" in df._jdf.queryExecution().executedPlan().toString() for df in seen)


def test_imports_do_not_meet_the_symbols_of_a_module_one_by_one(spark):
    draw = random.Random(9)
    calls = [(i % 40, draw.choice("ab")) for i in range(60)] + [(None, "a")]
    imports = [(i, n, draw.randrange(6)) for i in range(40) for n in "abc" for _ in range(4)] + [(None, "a", 1), (3, "a", None)]
    symbols = [(m, "a", draw.choice([7, None]) if m < 3 else i) for m in range(5) for i in range(500)] + [(2, "b", 1), (4, "b", 1), (5, "b", None), (None, "a", 2)]
    want = {}
    for f, n in set(calls):
        ids = {i for g, k, m in imports if (g, k) == (f, n) and None not in (f, m) for o, x, i in symbols if (o, x) == (m, n)} - {None}
        if len(ids) == 1:
            want[f, n] = ids.pop()
    out = linking.imported(spark.createDataFrame(calls, "file long, name string"), spark.createDataFrame(imports, "file long, name string, module long"), spark.createDataFrame(symbols, "module long, name string, id long"))
    got = [(r["file"], r["name"], r["id"]) for r in out.collect()]
    assert want and len(got) == len(want) and {(f, n): i for f, n, i in got} == want
    assert most_rows(out) <= len(symbols)


def test_texts_embedded_together_equal_each_alone(spark):
    rng = random.Random(3)
    texts = ["", " .", "processPayment x_y", "KKaB İstanbul aB", "Σas ÉcoleB 9A a9B AAa", "a", "é\n", "A" * 4_000, "runs running runs"]
    texts += ["".join(rng.choices("aAbB9 _.éKKİ\n#s", k=rng.randrange(60))) for _ in range(400)]
    want = [chunks.embed(x) for x in texts]
    assert (chunks.embed_all(texts) == want).all() and len(chunks.embed_all([])) == 0
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, t string")
    got = {r["k"]: r["embedding"] for r in chunks.hash_embed(docs, "k", "t").collect()}
    assert got.pop(-1) == chunks.embed("").tolist() and len(got) == len(texts)
    assert all((np.float32(got[i]) == x.astype(np.float32)).all() for i, x in enumerate(want))
