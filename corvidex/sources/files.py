"""Text, JSON and office sources: node-link graphs, commit logs, package manifests, symbol indexes, markdown notes, table
definitions, file scans; and the sinks for graphs, articles and bundles."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.sources.tables import insert_new

#: Fixed formats: the separators that a commit log is printed with, one record for each commit.
RECORD, FIELD = "\x1e", "\x1f"
GRAPH = "nodes array<map<string,string>>, links array<map<string,string>>, edges array<map<string,string>>"


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, source_file, community) and edges (src, dst, relation, confidence) of node-link JSON."""
    doc = spark.read.schema(GRAPH).json(path, multiLine=True)
    n = doc.select(F.explode("nodes").alias("n"))
    nodes = n.select(*[F.col("n")[c].alias(c) for c in ("id", "label", "source_file", "community")])
    e = doc.select(F.explode(F.coalesce("links", "edges")).alias("e"))
    first = lambda *names: F.coalesce(*[F.col("e")[x] for x in names])
    return nodes, e.select(first("source", "from").alias("src"), first("target", "to").alias("dst"), first("relation", "type").alias("relation"), F.col("e")["confidence"].alias("confidence"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a printed log: sha, ts, author, subject, files (added, deleted, path). Renames give the new path."""
    lines = spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "")
    head = F.split("value", FIELD)
    stat = F.filter(F.split(F.get(head, F.lit(4)), "\n"), lambda x: x.rlike("^[0-9-]+\t[0-9-]+\t"))
    moved = lambda p: F.regexp_replace(F.regexp_replace(p, r"\{[^{}]* => ([^{}]*)\}", "$1"), "^.* => ", "")
    files = F.transform(stat, lambda x: F.struct(F.try_to_number(F.split(x, "\t")[0], F.lit("999999999")).cast("bigint").alias("added"), F.try_to_number(F.split(x, "\t")[1], F.lit("999999999")).cast("bigint").alias("deleted"), F.regexp_replace(moved(F.split(x, "\t")[2]), "//", "/").alias("path")))
    return lines.select(F.trim(head[0]).alias("sha"), F.timestamp_seconds(head[1].cast("bigint")).alias("ts"), head[2].alias("author"), head[3].alias("subject"), files.alias("files"))


def package_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(package, depends_on) from package.json-like manifests."""
    doc = spark.read.schema("name string, dependencies map<string,string>, devDependencies map<string,string>").json(path, multiLine=True)
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys("dependencies"), F.array()), F.coalesce(F.map_keys("devDependencies"), F.array())))
    return doc.select(F.col("name").alias("package"), F.explode(names).alias("depends_on"))


def symbol_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols (file, symbol) and references (file, symbol, line) of a symbol-index JSON."""
    doc = spark.read.schema("documents array<struct<relative_path:string,symbols:array<struct<symbol:string>>,occurrences:array<struct<symbol:string,range:array<int>>>>>").json(path, multiLine=True)
    d = doc.select(F.explode("documents").alias("d"))
    symbols = d.select(F.col("d.relative_path").alias("file"), F.explode("d.symbols.symbol").alias("symbol"))
    uses = d.select(F.col("d.relative_path").alias("file"), F.explode("d.occurrences").alias("o"))
    return symbols, uses.select("file", "o.symbol", (F.get("o.range", F.lit(0)) + 1).alias("line"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes with a front matter: path, fields, body."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"^---\n((?s:.*?))\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    return raw.select("path", fields.alias("fields"), F.regexp_replace("value", r"^---\n(?s:.*?)\n---\n", "").alias("body"))


def corpus_scan(spark: SparkSession, path: str, glob: str = "*", ignore: tuple[str, ...] = (), max_bytes: int = 1 << 24) -> DataFrame:
    """path, bytes, modified, sha256 of the files of a folder; ``ignore``: patterns of paths that aren't shown, see ``ignored``.
    Files above ``max_bytes`` are listed as too_large, without a hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    files = files.where(~ignored(F.col("path"), ignore))
    whole = F.col("length") <= max_bytes
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.when(whole, F.sha2("content", 256)).alias("sha256"), (~whole).alias("too_large"))


def ignored(path, patterns: tuple[str, ...]):
    """Whether the last pattern that fits a path ignores it; one that begins with ! takes a path back in."""
    out = F.lit(False)
    for pattern in patterns:
        back = pattern.startswith("!")
        out = F.when(path.rlike(pattern[1:] if back else pattern), not back).otherwise(out)
    return out


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from the manifest (path, sha256)."""
    return now.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def cypher_lines(edges: DataFrame) -> DataFrame:
    """One MERGE statement a row, for text sinks."""
    q = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), "'", r"\\\\'")
    return edges.select(F.format_string("MERGE (a {id:'%s'}) MERGE (b {id:'%s'}) MERGE (a)-[:%s]->(b);", q(F.col("src")), q(F.col("dst")), F.regexp_replace(F.upper("relation"), "[^A-Z0-9_]", "_")).alias("value"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements, one a row; the caller frames them."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    n = nodes.select(F.format_string('<node id="%s"><data key="label">%s</data></node>', esc(F.col("id")), esc(F.col("label"))).alias("value"))
    return n.union(edges.select(F.format_string('<edge source="%s" target="%s"/>', esc(F.col("src")), esc(F.col("dst"))).alias("value")))


def _toml(text: str, kind: str) -> tuple:
    doc = tomllib.loads(text)
    if kind == "cargo":
        head = doc.get("package", {})
        return head.get("name"), head.get("version"), [k for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in doc.get(part, {})]
    head = doc.get("project") or doc.get("tool", {}).get("poetry", {})
    listed = head.get("dependencies", [])
    names = list(listed) if isinstance(listed, dict) else [re.split(r"[\s<>=!~;\[(]", x, maxsplit=1)[0] for x in listed]
    return head.get("name"), head.get("version"), [x for x in names if x.lower() != "python"]


def _go(text: str) -> tuple:
    name = re.search(r"^module\s+(\S+)", text, re.M)
    block = "\n".join(re.findall(r"^require\s*\(([^)]*)\)", text, re.M))
    single = re.findall(r"^require\s+([^\s(]+)\s+v", text, re.M)
    return name and name[1], None, [*re.findall(r"^\s*([^\s/][^\s]*)\s+v", block, re.M), *single]


def _maven(text: str) -> tuple:
    if "<!ENTITY" in text:
        raise ValueError("entities aren't read")
    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root.findtext("artifactId"), root.findtext("version"), [d.findtext("artifactId") for d in root.iter("dependency") if d.findtext("artifactId")]


def _node(text: str) -> tuple:
    doc = json.loads(text)
    return doc.get("name"), doc.get("version"), [*doc.get("dependencies", {}), *doc.get("devDependencies", {})]


def _plain(value: str) -> str | None:
    """A scalar of one line: without quotes, and without the remark after it."""
    value = value.strip()
    if value[:1] in ("'", '"'):
        return value[1:].partition(value[0])[0]
    return value.split(" #")[0].strip() or None


def _apm(text: str) -> tuple:
    """The part of YAML such manifests use: keys at the margin, below a key a list or a mapping, or one of these in brackets."""
    top: dict[str, tuple[str, list[tuple[int, str]]]] = {}
    below: list[tuple[int, str]] = []
    for raw in text.expandtabs().splitlines():
        line = raw.strip()
        depth = len(raw) - len(raw.lstrip())
        if not line or line[0] == "#":
            continue
        if depth or line.startswith("- "):
            below.append((depth, line))
        else:
            key, _, value = line.partition(":")
            below = []
            top[key.strip()] = (value.strip(), below)
    value, entries = top.get("dependencies", ("", []))
    if value[:1] in ("[", "{"):
        entries = [(0, part.strip()) for part in value[1:].rstrip("]}").split(",")]
    margin = min((depth for depth, _ in entries), default=0)
    # What lies deeper belongs to an entry, as the range of versions under its name does.
    named = [_plain(line.removeprefix("-").strip().split(": ")[0].removesuffix(":")) for depth, line in entries if depth == margin]
    return *(_plain(top[k][0]) if k in top else None for k in ("name", "version")), named


#: Manifests by name.
MANIFESTS = {"pyproject.toml": "python", "cargo.toml": "cargo", "go.mod": "go", "pom.xml": "maven", "package.json": "node", "apm.yml": "apm", "apm.yaml": "apm"}
_READERS = {"python": lambda x: _toml(x, "python"), "cargo": lambda x: _toml(x, "cargo"), "go": _go, "maven": _maven, "node": _node, "apm": _apm}


def manifests(spark: SparkSession, path: str, max_bytes: int = 2_000_000) -> DataFrame:
    """path, ecosystem, package, version, depends_on (array), error of the package manifests below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") <= max_bytes) & F.lower(F.substring_index("path", "/", -1)).isin(*MANIFESTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                kind, found, error = MANIFESTS[p.rsplit("/", 1)[1].lower()], (None, None, []), None
                try:
                    found = _READERS[kind](bytes(content).decode("utf-8", "replace"))
                except Exception as e:  # one odd file doesn't end a scan
                    error = f"{type(e).__name__}: {e}"[:200]
                name, version, deps = found
                rows.append((p, kind, name, version if isinstance(version, str) else None, [d for d in dict.fromkeys(deps) if d and d != name], error))
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "package", "version", "depends_on", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, ecosystem string, package string, version string, depends_on array<string>, error string")


def office_texts(spark: SparkSession, path: str, max_bytes: int = 1 << 26) -> DataFrame:
    """path, text of DOCX and XLSX files: paragraphs, or rows of cells with tabs between; null where a file can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx}").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)

    def parts(content: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                tree = lambda name: ElementTree.fromstring(z.read(name))
                tag = lambda e: e.tag.rsplit("}", 1)[-1]
                words = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t")
                if "word/document.xml" in z.namelist():
                    return "\n".join(words(p) for p in tree("word/document.xml").iter() if tag(p) == "p")
                shared = [words(x) for x in tree("xl/sharedStrings.xml") if tag(x) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
                lines = []
                for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                    for row in (r for r in tree(name).iter() if tag(r) == "row"):
                        cells = []
                        for c in (c for c in row if tag(c) == "c"):
                            value = next((v.text or "" for v in c if tag(v) == "v"), "")
                            cells.append(shared[int(value)] if c.get("t") == "s" and value else value or words(c))
                        lines.append("\t".join(cells))
                return "\n".join(lines)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [parts(bytes(c)) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def table_definitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables (path, table, columns) and references (table, column, target) of SQL files with CREATE TABLE statements."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "--[^\n]*", ""), "(?s)/\\*.*?\\*/", "").alias("sql"))
    each = raw.select("path", F.explode(F.split("sql", ";")).alias("s")).where(F.col("s").rlike("(?is)^\\s*create\\s+(or\\s+replace\\s+)?(temp(orary)?\\s+)?table\\b"))
    plain = lambda c: F.lower(F.regexp_replace(c, "[\"`\\[\\]]", ""))
    table = plain(F.regexp_extract("s", "(?is)table\\s+(?:if\\s+not\\s+exists\\s+)?([^\\s(]+)", 1))
    body = F.regexp_extract("s", "(?s)\\((.*)\\)", 1)
    # Commas within brackets, as in decimal(10, 2), don't part columns.
    lines = F.transform(F.split(F.regexp_replace(body, "\\([^()]*\\)", "()"), ","), lambda x: F.trim(x))
    columns = F.filter(F.transform(lines, lambda x: plain(F.regexp_extract(x, "^([^\\s]+)\\s", 1))), lambda c: (c != "") & ~c.isin("primary", "foreign", "unique", "constraint", "check", "key", "index", "exclude"))
    tables = each.select("path", table.alias("table"), columns.alias("columns"))
    inline = F.regexp_extract_all(body, F.lit("(?is)(?:^|,)\\s*([^\\s,()]+)\\s[^,]*?\\breferences\\s+([^\\s(,]+)"), F.lit(0))
    keyed = F.regexp_extract_all(body, F.lit("(?is)foreign\\s+key\\s*\\(\\s*[^)]+\\)\\s*references\\s+[^\\s(,]+"), F.lit(0))
    ref = each.select(table.alias("table"), F.explode(F.concat(keyed, F.filter(inline, lambda x: ~x.rlike("(?i)foreign\\s+key")))).alias("r"))
    column = F.when(F.col("r").rlike("(?i)foreign\\s+key"), F.regexp_extract("r", "(?is)key\\s*\\(\\s*([^)]+?)\\s*\\)", 1)).otherwise(F.regexp_extract("r", "(?is)^,?\\s*([^\\s]+)", 1))
    return tables, ref.select("table", plain(column).alias("column"), plain(F.regexp_extract("r", "(?is)references\\s+([^\\s(,]+)", 1)).alias("target")).distinct()


def catalog_graph(columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a database catalog. ``columns``: table_schema, table_name, column_name, as the standard's view has
    them (read with ``spark.read.jdbc``); ``keys``: table_schema, table_name, foreign_schema, foreign_name."""
    name = lambda a, b: F.concat_ws(".", a, b)
    tables = columns.groupBy(name("table_schema", "table_name").alias("id")).agg(F.sort_array(F.collect_set("column_name")).alias("columns")).withColumn("label", F.substring_index("id", ".", -1))
    return tables, keys.select(name("table_schema", "table_name").alias("src"), name("foreign_schema", "foreign_name").alias("dst"), F.lit("references").alias("relation")).distinct()


def new_commits(log: DataFrame, known: DataFrame) -> DataFrame:
    """The commits of a log that aren't known by sha yet: what an incremental run adds up."""
    return log.dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti")


def memory_seeds(spark: SparkSession, path: str, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """id, kind, text, source of what a repository's documents say already: a decision record gives its title, any other
    file its list items and paragraphs of some length. ``kinds``: kind by a pattern of the path."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    kind = F.lit("fact")
    for pattern, name in (kinds or {"(?i)/adrs?/": "decision", "(?i)(agents|contributing|conventions)\\.md$": "convention"}).items():
        kind = F.when(F.col("source").rlike(pattern), name).otherwise(kind)
    title = F.array(F.regexp_extract("value", "(?m)^#\\s+(.+)$", 1))
    items = F.transform(F.regexp_extract_all("value", F.lit("(?m)^\\s*[-*]\\s+(.{20,400})$"), F.lit(1)), lambda x: F.trim(x))
    rows = raw.select("source", kind.alias("kind"), F.explode(F.when(kind == "decision", title).otherwise(items)).alias("text")).where("text <> ''")
    return rows.select(F.left(F.sha2(F.concat_ws("|", "kind", "text"), 256), F.lit(10)).alias("id"), "kind", "text", "source").dropDuplicates(["id"])


def cross_stores(stores: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of several stores, read only, with the store's name; columns that one lacks are null."""
    out = None
    for name, rows in stores.items():
        named = rows.withColumn("store", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


class Shrinks(ValueError):
    """A graph has fewer nodes than the one that it would replace."""


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """Write nodes and edges as JSON lines, in two folders; a graph with fewer nodes than the one there isn't written over it
    unless ``force``. What is there and can't be read counts as larger."""
    spark = nodes.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if not force and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        before, now = spark.read.text(f"{path}/nodes").count(), nodes.count()
        if now < before:
            raise Shrinks(f"{now} nodes where there are {before}; force to write them all the same")
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def articles(nodes: DataFrame, groups: DataFrame, degrees: DataFrame, most: int = 50) -> DataFrame:
    """community, body: a markdown article for each community, its best connected members first, at most ``most`` listed."""
    every = groups.join(nodes.select("id", "label"), "id").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    first = every.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))).where(F.col("k") <= most)
    lines = first.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "label", "degree"))), lambda x: F.format_string("- %s (%d)", x["label"], x["degree"])).alias("lines"), F.max(F.when(F.col("k") == 1, F.col("label"))).alias("name"))
    size = every.groupBy("community").agg(F.count("*").alias("n"))
    return lines.join(size, "community").select("community", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" members\n\n"), F.array_join("lines", "\n")).alias("body"))


def export_bundle(tables: Mapping[str, DataFrame], sessions: DataFrame, path: str) -> None:
    """The rows of each table that belong to ``sessions`` (session), one folder of JSON lines each."""
    for name, rows in tables.items():
        rows.join(sessions.select("session").distinct(), "session", "left_semi").write.mode("overwrite").json(f"{path}/{name}")


def import_bundle(tables: Mapping[str, DataFrame], path: str, keys: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """Each table with the rows of a bundle that it doesn't hold yet by its keys."""
    return {name: insert_new(rows, rows.sparkSession.read.schema(rows.schema).json(f"{path}/{name}"), keys[name]) for name, rows in tables.items()}
