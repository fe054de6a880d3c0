"""Operators against plain Python: what SQL twins can't show."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvidex.extend import Registry, Types, in_order
from corvidex.functions import text as X
from corvidex.operators import catalog, chunks, filters, graph, linking, memory, relational, resolution, vectors
from corvidex.operators import queue as work
from corvidex.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("ca", "abc"), ("abcd", "badc")] + [tuple("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in "xy") for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["d"] for r in rows.select("i", X.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: osa(a, b) for i, (a, b) in enumerate(pairs)}


def test_name_resolution_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india"]
    known = [(i, " ".join(rng.sample(words, 4)) + f" {i}") for i in range(60)] + [(100, "Same Name"), (101, "same  name"), (102, "aaaa")]
    new = [(1000 + i, name.upper() if i % 3 == 0 else name + "!" if i % 3 == 1 else name[:-1] + "x") for i, name in known[:60]] + [(2000, "same name"), (2001, "aaab"), (2002, "")]

    def grams(name):
        bare = "".join(c if c.isalnum() and c.isascii() or c == "'" else " " for c in " ".join(name.lower().split())).replace(" ", "")
        return {bare[i : i + 3] for i in range(len(bare) - 2)} or {bare}

    keys = {}
    for i, name in known:
        keys.setdefault(" ".join(name.lower().split()), []).append(i)
    want = {}
    for i, name in new:
        equal = keys.get(" ".join(name.lower().split()), [])
        if equal:
            want[i] = (equal[0], "exact") if len(equal) == 1 else (None, "ambiguous")
            continue
        scored = sorted((-len(grams(name) & grams(k)) / len(grams(name) | grams(k)), j) for j, k in known)
        want[i] = (scored[0][1], "fuzzy") if -scored[0][0] >= 0.9 and len(name) > 5 else (None, "unresolved")
    rows = resolution.resolve_names(spark.createDataFrame(new, "id long, name string"), spark.createDataFrame(known, "id long, name string")).collect()
    assert {r["id"]: (r["known_id"], r["how"]) for r in rows} == want
    assert {"exact", "ambiguous", "fuzzy", "unresolved"} == {r["how"] for r in rows}


def test_alias_map_follows_chains_and_leaves_circles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]]
    got = {r["alias"]: r["canonical"] for r in resolution.alias_map(spark.createDataFrame(pairs, "alias string, canonical string")).collect()}
    assert [got[k] for k in "abc"] == ["d"] * 3 and got["n00"] == got["n39"] == "n40"
    assert got["x"] == "x" and got["y"] == "y" and "s" not in got


def test_chains_and_history(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, None), (5, 6), (6, 5)]
    m = spark.createDataFrame(rows, "id long, superseded_by long")
    assert {r["id"]: (r["head"], r["steps"]) for r in memory.chains(m).collect()} == {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (4, 0), 5: (None, None), 6: (None, None)}
    assert [r["id"] for r in memory.history(m, 2).orderBy("place").collect()] == [3, 2, 1]


def test_scopes_and_expiry(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u2", "a")], "user_id string, k string")
    assert memory.scoped(rows, {"user_id": "u2"}, user_id=" u1 ").count() == 1  # a scope can't be overridden
    for bad in ({}, {"user_id": " "}, {"user_id": "a b"}, {"other": "x"}):
        with pytest.raises(ValueError):
            memory.scoped(rows, **bad)
    dates = spark.createDataFrame([("2020-01-01",), ("2999-01-01",), (None,), ("soon",), ("2020-13-45",)], "d string")
    assert [r["x"] for r in dates.select(memory.unexpired(F.col("d"), F.lit("2024-01-01").cast("date")).alias("x")).collect()] == [False, True, True, True, True]


def test_forget_and_queue(spark):
    m = spark.createDataFrame([(1, 0), (2, 0)], "id long, forgotten int")
    links = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "memory_id long, x string")
    flagged, left = memory.forget(m, m.where("id = 2"), links)
    assert {tuple(r) for r in flagged.collect()} == {(1, 0), (2, 1)} and left.count() == 1
    q = spark.createDataFrame([(1, 7, "pending", None, 0), (2, 7, "pending", None, 0), (3, 7, "processing", 5.0, 2), (4, 8, "processing", None, 0)], "id long, session long, status string, claimed_at double, retries int")
    step = work.claim(q, 100.0)
    assert {r["id"]: r["status"] for r in step.collect()} == {1: "processing", 2: "pending", 3: "processing", 4: "processing"}
    step = work.retry(step, step.where("id IN (1, 3)"))
    assert {r["id"]: (r["status"], r["retries"]) for r in step.where("id IN (1, 3)").collect()} == {1: ("pending", 1), 3: ("failed", 3)}
    assert {r["id"]: r["status"] for r in work.reset_stale(q, 1000.0).collect()} == {1: "pending", 2: "pending", 3: "pending", 4: "pending"}
    assert work.confirm(q, q.where("id < 3")).count() == 2


def test_corrections(spark):
    said = [
        ("No, that's wrong", 2, True), ("no wonder it works", 1, False), ("Please add a page", 3, False), ("it is still broken", 2, False), ("You  broke the build", 2, True), ("x" * 590 + " wrong file", 2, False),
        ("x " * 250 + " wrong file", 2, True), ("No problem, go on", 2, False), ("no, that's fine", 2, False), ("Don't forget the docs", 5, False), ("don't do that", 5, True), ("nobody knows", 2, False), ("  -- Undo it", 2, True),
        ("that isn\u2019t it", 2, False), ("Stop by later", 2, False), ("I told you not to", 9, True), (None, 2, False), ("", 2, False), ("no", None, False),
    ]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(said)], "i int, t string, n int")
    assert [r["x"] for r in rows.orderBy("i").select(work.is_correction(F.col("t"), F.col("n")).alias("x")).collect()] == [w for *_, w in said]


def test_greedy_pack_against_a_walk(spark):
    rng = random.Random(4)
    items = [(i, i % 3, rng.choice("abc"), rng.random(), rng.choice([0, 1, 2, 3, 7, 50])) for i in range(300)]
    got = {r["id"] for r in relational.greedy_pack(spark.createDataFrame(items, "id int, pack int, section string, score double, cost int"), "pack", "section", "score", "cost", "id", 40).collect()}
    want = set()
    for pack in range(3):
        own = [x for x in items if x[1] == pack]
        firsts = {x[0] for s in "abc" for x in sorted((y for y in own if y[2] == s), key=lambda y: (-y[3], y[0]))[:2]}
        left = 40
        for x in sorted(own, key=lambda y: (y[0] not in firsts, -y[3], y[0])):
            if x[4] <= left:
                want.add(x[0])
                left -= x[4]
    assert got == want


def test_community_remap_against_a_greedy_walk(spark):
    rng = random.Random(5)
    now, before = [(i, rng.randrange(6)) for i in range(400)], [(i, 10 + rng.randrange(5)) for i in range(400)]
    got = {r["community"]: r["previous"] for r in graph.remap(spark.createDataFrame(now, "id int, community int"), spark.createDataFrame(before, "id int, community int")).collect()}
    counts = {}
    for (_, a), (_, b) in zip(now, before):
        counts[a, b] = counts.get((a, b), 0) + 1
    want = {}
    for (a, b), _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if a not in want and b not in want.values():
            want[a] = b
    assert got == want


def test_traversals(spark):
    star = [("h", f"x{i}", "c") for i in range(60)] + [("s", "h", "c"), ("s", "y", "d"), ("y", "z", "c"), ("z", "z", "c")]
    edges = spark.createDataFrame(star, "src string, dst string, context string")
    seeds = spark.createDataFrame([("s",)], "id string")
    assert graph.hub_bound(edges) == 61
    nodes, inside = graph.around_seeds(edges, seeds, 3, least=50)
    assert {r["id"] for r in nodes.collect()} == {"s", "h", "y", "z"} and inside.count() == 3
    nodes, _ = graph.around_seeds(edges, spark.createDataFrame([("h",)], "id string"), 1, ["c"])
    assert nodes.count() == 62
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "c")], "src string, dst string")
    assert {r["id"]: r["layer"] for r in graph.condensed_layers(ring).collect()} == {"d": 0, "c": 1, "a": 2, "b": 2, "e": 2}
    groups = spark.createDataFrame([("g1", "a", "b"), ("g1", "b", "c"), ("g1", "a", "c"), ("g2", "a", "z")], "g string, src string, dst string")
    labels = {(r["g"], r["id"]): r["label"] for r in graph.propagate_by_group(groups, "g").collect()}
    assert len({v for (g, _), v in labels.items() if g == "g1"}) == 1 and ("g2", "b") not in labels


def test_nearest_and_mentions(spark):
    calls = spark.createDataFrame([(1, "a/b/x.py", "f"), (2, "a/b/x.py", "g"), (3, "q.py", "f")], "call int, file string, name string")
    declared = spark.createDataFrame([("f", 10, "a/b/y.py"), ("f", 11, "a/c/z.py"), ("g", 12, "a/b/y.py"), ("g", 13, "a/b/z.py")], "name string, id int, file string")
    assert {r["call"]: r["id"] for r in linking.nearest(calls, declared).collect()} == {1: 10}
    labels = spark.createDataFrame([("Parser", 1), ("main", 2), ("abc", 3), *[("common", i) for i in range(4, 9)]], "label string, id int")
    texts = spark.createDataFrame([(1, "the parser, main and common abc; PARSER")], "k int, t string")
    assert [tuple(r) for r in linking.mention_links(texts, labels, "k", "t").collect()] == [(1, "parser", 1)]
    assert one(spark, linking.route_key(F.lit("/Users/{id}/posts/12/?q=1"))) == "/users/{}/posts/{}"


def test_slices_and_messages(spark):
    rng = random.Random(6)
    for _ in range(50):
        text = "".join(rng.choice("ab\n# ") for _ in range(rng.randrange(200)))
        cut = chunks.slices(text, 20)
        assert "".join(text[a:b] for a, b in cut) == text and all(b - a <= 20 for a, b in cut)
    rows = spark.createDataFrame([(1, 0, "a" * 400), (1, 1, "b" * 400), (1, 2, "c" * 900), (1, 3, None), (1, 4, "d" * 100)], "conv int, turn int, text string")
    got = sorted((r["chunk"], r["turns"], r["chars"]) for r in chunks.messages(rows, "conv", "turn", "text", 500).collect())
    assert got == [(0, 1, 400), (1, 1, 400), (2, 2, 900), (3, 1, 100)] or got == [(0, 1, 400), (1, 1, 400), (2, 1, 900), (3, 2, 100)]
    assert all(c <= 500 or n <= 2 for _, n, c in got)


def test_embedder(spark):
    assert abs((chunks.embed("running runs") ** 2).sum() - 1) < 1e-9
    assert (chunks.embed("processPayment") == chunks.embed("process_payment")).all()
    assert chunks.light_stem("parsers") == "pars" and chunks.light_stem("ring") == "ring"


def test_vector_store(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>, op string, seq long")
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, vector array<double>")
    j = vectors.delete(vectors.add(vectors.clear(vectors.add(empty, rows, 1), 2), rows, 3), rows.where("id = 2"), 4)
    assert [(r["id"], r["vector"]) for r in vectors.state(j).collect()] == [(1, [0.6, 0.8])]
    assert vectors.state(vectors.clear(j, 5)).count() == 0


def test_manifests_and_definitions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "app"\nversion = "1.0"\ndependencies = ["numpy>=1", "requests[socks]"]\n')
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "crate"\nversion = "0.1"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ntokio = "1"\n')
    (tmp_path / "go.mod").write_text("module example.org/m\nrequire (\n\tgolang.org/x/y v1.2.3\n)\nrequire example.org/z v0.1.0\n")
    (tmp_path / "pom.xml").write_text('<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>svc</artifactId><version>2</version><dependencies><dependency><artifactId>junit</artifactId></dependency></dependencies></project>')
    (tmp_path / "a" / "package.json").write_text('{"name": "web", "version": "3", "dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}')
    (tmp_path / "a" / "apm.yml").write_text("name: kit\nversion: 1\ndependencies:\n  - base\n")
    (tmp_path / "a" / "other.toml").write_text("x = 1")
    got = {r["ecosystem"]: (r["package"], r["version"], r["depends_on"]) for r in files.manifests(spark, str(tmp_path)).collect()}
    assert got == {"python": ("app", "1.0", ["numpy", "requests"]), "cargo": ("crate", "0.1", ["serde", "tokio"]), "go": ("example.org/m", None, ["golang.org/x/y", "example.org/z"]), "maven": ("svc", "2", ["junit"]), "node": ("web", "3", ["react", "vite"]), "apm": ("kit", "1", ["base"])}
    (tmp_path / "a" / "package.json").write_text("{")
    assert [r["error"] is not None for r in files.manifests(spark, str(tmp_path)).where("ecosystem = 'node'").collect()] == [True]
    (tmp_path / "s.sql").write_text('-- a comment;\nCREATE TABLE IF NOT EXISTS "Users" (id int primary key, name text, price decimal(10, 2));\ncreate table orders (id int, user_id int references users(id), item int,\n foreign key (item) references items (id));\nselect 1;')
    tables, refs = files.table_definitions(spark, str(tmp_path / "s.sql"))
    assert {r["table"]: r["columns"] for r in tables.collect()} == {"users": ["id", "name", "price"], "orders": ["id", "user_id", "item"]}
    assert {tuple(r) for r in refs.collect()} == {("orders", "user_id", "users"), ("orders", "item", "items")}


def test_office_texts(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for name, parts in {"a.docx": {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'}, "b.xlsx": {"xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'}}.items():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(out.getvalue())
    (tmp_path / "c.docx").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.office_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "one\ntwo", "b.xlsx": "x\t5", "c.docx": None}


def test_graph_sink_guards_and_bundles(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    path = str(tmp_path / "g")
    files.write_graph(nodes, edges, path)
    with pytest.raises(files.Shrinks):
        files.write_graph(nodes.limit(1), edges, path)
    files.write_graph(nodes.limit(1), edges, path, force=True)
    assert spark.read.json(path + "/nodes").count() == 1
    groups = nodes.select("id", F.lit(1).alias("community"))
    body = files.articles(nodes, groups, graph.degree(edges)).first()["body"]
    assert body.startswith("# A\n\n2 members") and "- B (1)" in body
    rows = spark.createDataFrame([("s1", 1, "x"), ("s2", 2, "y")], "session string, id int, t string")
    files.export_bundle({"notes": rows}, rows.where("session = 's1'").select("session"), str(tmp_path / "b"))
    held = files.import_bundle({"notes": rows.where("session = 's2'")}, str(tmp_path / "b"), {"notes": ["session", "id"]})
    assert {tuple(r) for r in held["notes"].select("session", "id", "t").collect()} == {("s1", 1, "x"), ("s2", 2, "y")}
    again = files.import_bundle({"notes": rows}, str(tmp_path / "b"), {"notes": ["session", "id"]})
    assert again["notes"].count() == 2


def test_seeds_commits_and_stores(spark, tmp_path):
    (tmp_path / "docs" / "adr").mkdir(parents=True)
    (tmp_path / "docs" / "adr" / "1.md").write_text("# Use one store\n\n- some item that is long enough to count\n")
    (tmp_path / "AGENTS.md").write_text("# Rules\n\n- always run the tests before a commit\n- short\n")
    got = {(r["kind"], r["text"]) for r in files.memory_seeds(spark, str(tmp_path)).collect()}
    assert got == {("decision", "Use one store"), ("convention", "always run the tests before a commit")}
    log = spark.createDataFrame([("a",), ("b",), ("b",)], "sha string")
    assert [r["sha"] for r in files.new_commits(log, log.where("sha = 'a'")).collect()] == ["b"]
    both = files.cross_stores({"x": log, "y": spark.range(1).withColumnRenamed("id", "n")})
    assert both.columns == ["sha", "store", "n"] and both.count() == 4
    assert [r["x"] for r in spark.createDataFrame([("a/b.py",), ("a/keep.py",), ("c.md",)], "p string").select(files.ignored(F.col("p"), (r"\.py$", "!keep")).alias("x")).collect()] == [True, False, False]


def test_plug_ins_types_and_jobs(spark):
    r = Registry()
    calls, symbols = spark.createDataFrame([("f",)], "call string"), spark.createDataFrame([("f", 1)], "call string, id int")
    r.add("resolver", "a", lambda c, s: c.join(s, "call"))
    r.add("resolver", "b", lambda c, s: c.join(s, "call"))
    assert [tuple(x) for x in r.resolve(calls, symbols).collect()] == [("f", 1, "a")]
    with pytest.raises(KeyError):
        r.get("embedder", "none")
    with pytest.raises(ValueError):
        r.add("thing", "x", 1)
    types = Types({"person": {"age": "int"}}, {"knows": ("person", "person")})
    nodes = spark.createDataFrame([("a", "person", '{"age": 3}'), ("b", "place", "{}")], "id string, kind string, properties string")
    assert {x["id"]: x["person"] and x["person"]["age"] for x in types.typed(nodes, "kind").collect()} == {"a": 3, "b": None}
    edges = spark.createDataFrame([("a", "a", "knows"), ("a", "b", "knows")], "src string, dst string, relation string")
    assert types.allowed(edges, nodes).count() == 1
    done = in_order(spark, [{"x": lambda: spark.range(5).count(), "y": lambda: 1 / 0}, {"z": lambda: 2}])
    assert done["x"] == ("done", 5) and done["y"][0] == "failed" and done["z"] == ("done", 2)


def test_workflow_predicates_and_filters(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y [a]"), (3, None)], "a int, s string")
    count = lambda text: rows.where(filters.workflow_predicate(text)).count()
    assert count('{{ a == 1 and not (s == "z") }}') == 1
    assert count("{{ a in [1, 2] or s == 'q' }}") == 2
    assert count('{{ s == "y [a]" }}') == 1 and count("{{ a != 1 }}") == 2
    assert catalog.session_filter(rows, types=("s", ["x"]), since=("a", 1), until=("a", 2)).count() == 1
    arrays = spark.createDataFrame([(1, ["src/a.py"]), (2, None)], "id int, files array<string>")
    assert [r["id"] for r in catalog.session_filter(arrays, files=("files", ["a.py", "zz"])).collect()] == [1]


def test_scalars(spark):
    assert one(spark, X.plain_letters(F.lit("Éçñ žŁ"))) == "Ecn zL"
    assert one(spark, X.category(F.lit("a/b.PY"))) == "code" and one(spark, X.category(F.lit("x.png"))) == "image" and one(spark, X.category(F.lit("x"))) == "other"
    assert one(spark, X.longest_prefix(F.lit("model-a-1"), {"model": 1, "model-a": 2})) == 2.0
    best = one(spark, X.densest_window(F.lit("a" * 50 + "key key" + "b" * 50), ["key"], 10))
    assert best["hits"] == 2 and best["at"] <= 50
    assert one(spark, X.lemmas(F.lit("theParsers are running"))) == ["pars", "runn"]


def test_risk_tags(spark):
    said = [
        ("fix typo in docs", None, []), ("add a prefix", None, []), ("Fix login", "", ["fix"]), ("Hot-fix: crash", "CVE-2024-12", ["crash", "cve", "hot"]), ("style: fixed leak", "bug", ["leak"]), ("docs", "fixes a bug", []),
        ("Reverts the change", None, ["revert", "reverts"]), ("reverting", None, ["revert"]), ("roll back", "Data Loss", ["data_loss", "roll_back"]), (None, "deadlock", ["deadlock"]), (None, None, []), ("hotfix HOTFIX", None, ["hotfix"]),
    ]
    rows = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(said)], "i int, s string, b string")
    assert [r["x"] for r in rows.orderBy("i").select(X.risk_tags(F.col("s"), F.col("b")).alias("x")).collect()] == [w for *_, w in said]
