"""Full text, vector and hybrid queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions import porter
from corvidex.functions import text as X
from corvidex.operators import facts, fts
from corvidex.operators import retrieval as R
from corvidex.operators import sessions
from corvidex.operators import vectors as V
from corvidex.plans.base import ORACLES, Tables, query

QUESTION = "thing ention license"
#: A fixed query vector, written out as the same arithmetic in SQL.
VECTOR = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT unnest(['thing', 'ention', 'license']) AS term),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
f AS (SELECT doc_id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM w CROSS JOIN t),
d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY 1),
b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f JOIN d USING (term) CROSS JOIN s WHERE tf > 0 GROUP BY 1)"""
_COS = f"list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, VECTOR))}]::DOUBLE[])"


@query(f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_documents(t: Tables) -> DataFrame:
    return R.top(R.bm25(t.documents, "doc_id", "text", QUESTION), "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_BM25} SELECT doc_id, round(1 / (1 + exp(-0.7 * (score - 5.0))), 6) AS score FROM b")
def bm25_sigmoid(t: Tables) -> DataFrame:
    rows = R.bm25(t.documents, "doc_id", "text", QUESTION)
    return rows.select("doc_id", F.round(R.sigmoid(F.col("score"), 3), 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(t: Tables) -> DataFrame:
    return R.top(R.similar(t.embeddings, "vec_id", "embedding", VECTOR), "score", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) AND {_COS} > 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(t: Tables) -> DataFrame:
    rows = R.similar(t.embeddings.where(F.col("label").isin(1, 3, 5)), "vec_id", "embedding", VECTOR, 0.05)
    return R.top(rows, "score", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], query) AS score FROM embeddings CROSS JOIN q)
SELECT query_id, vec_id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM s) WHERE k <= 5""")
def vector_batch_topk(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.batch_top(t.embeddings, q, "vec_id", "embedding", 5).select("query_id", "vec_id", F.col("k").cast("long").alias("k"))


@query(f"""{_BM25}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 40)),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 40)
SELECT doc_id, round(sum(1.0 / (r + 60)), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY 1""")
def rrf_two_lists(t: Tables) -> DataFrame:
    lexical = R.top(R.bm25(t.documents, "doc_id", "text", QUESTION), "score", "doc_id", 40)
    near = R.top(R.similar(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", VECTOR), "score", "doc_id", 40)
    return R.rrf([R.ranked(lexical, "score", "doc_id"), R.ranked(near, "score", "doc_id")], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM c),
m AS (SELECT a.vec_id, coalesce(max(list_inner_product(a.v, b.v)), 0) AS m, any_value(a.v) AS v FROM u a LEFT JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, round(0.5 * list_inner_product(v, [{', '.join(map(str, VECTOR))}]::DOUBLE[]) - 0.5 * greatest(m, 0), 6) AS score FROM m""")
def mmr_oneshot(t: Tables) -> DataFrame:
    best = R.top(R.similar(t.embeddings, "vec_id", "embedding", VECTOR), "score", "vec_id", 20)
    return R.mmr(t.embeddings.join(best.select("vec_id"), "vec_id", "left_semi"), "vec_id", "embedding", VECTOR).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""{_BM25}, sem AS (SELECT vec_id AS doc_id, {_COS} AS s FROM embeddings WHERE {_COS} >= 0.02),
l AS (SELECT doc_id, 1 / (1 + exp(-0.7 * (score - 5.0))) AS l FROM b), o AS (SELECT doc_id, 0.25 * quality AS b FROM labels),
j AS (SELECT sem.doc_id, s, coalesce(l, 0) AS l, coalesce(o.b, 0) AS b FROM sem LEFT JOIN l ON sem.doc_id = l.doc_id LEFT JOIN o ON sem.doc_id = o.doc_id),
p AS (SELECT 1.0 + CASE WHEN max(l) > 0 THEN 1.0 ELSE 0 END + CASE WHEN max(b) > 0 THEN 0.5 ELSE 0 END AS top FROM j)
SELECT doc_id, round(least((s + l + b) / top, 1.0), 6) AS score FROM j CROSS JOIN p""")
def hybrid_additive(t: Tables) -> DataFrame:
    semantic = R.similar(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", VECTOR)
    lexical = R.bm25(t.documents, "doc_id", "text", QUESTION).select("doc_id", R.sigmoid(F.col("score"), 3).alias("score"))
    boosts = t.labels.select("doc_id", (0.25 * F.col("quality")).alias("score"))
    return R.hybrid(semantic, lexical, boosts, "doc_id", 0.02).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (contains(lower(p_name), 'cold')) AS d0, count(*) FILTER (contains(lower(p_name), 'bolt')) AS d1 FROM part),
x AS (SELECT p_partkey, lower(p_name) AS l FROM part)
SELECT p_partkey, round((CASE WHEN l = 'cold' THEN 1000.0 WHEN starts_with(l, 'cold') THEN 100.0 WHEN contains(l, 'cold') THEN 1.0 ELSE 0 END * ln(1 + n / (1 + d0))
+ CASE WHEN l = 'bolt' THEN 1000.0 WHEN starts_with(l, 'bolt') THEN 100.0 WHEN contains(l, 'bolt') THEN 1.0 ELSE 0 END * ln(1 + n / (1 + d1)))
* power((CAST(contains(l, 'cold') AS INT) + CAST(contains(l, 'bolt') AS INT)) / 2.0, 2), 6) AS score FROM x CROSS JOIN s WHERE contains(l, 'cold') OR contains(l, 'bolt')""")
def idf_label_score(t: Tables) -> DataFrame:
    return R.label_score(t.part, "p_partkey", "p_name", "cold bolt").select("p_partkey", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid') AND contains(lower(p_name), 'idg') AND contains(lower(p_name), 'dge') AND contains(lower(p_name), 'get')""")
def trigram_candidates(t: Tables) -> DataFrame:
    return R.trigram_candidates(t.part, "p_partkey", "p_name", "widget")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(line) AS line_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE contains(lower(line), 'thing') AND contains(lower(line), 'of')) WHERE k <= 3""")
def line_grep(t: Tables) -> DataFrame:
    return R.grep(t.documents, "doc_id", "text", "thing of").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_FTS = f"""a AS (SELECT p_partkey, unnest({_TOKENS.format('p_name')}) AS term, 4.0 AS w FROM part UNION ALL SELECT p_partkey, unnest({_TOKENS.format("p_type || ' ' || p_brand")}), 1.0 FROM part),
l AS (SELECT p_partkey, count(*) AS n FROM a GROUP BY 1), s AS (SELECT (SELECT count(*) FROM part) AS docs, (SELECT count(*) FROM a) / (SELECT count(*) FROM part) AS average),
q AS (SELECT unnest(['col', 'bolt', 'brand']) AS prefix), f AS (SELECT prefix, p_partkey, sum(w) AS tf FROM a JOIN q ON starts_with(term, prefix) GROUP BY 1, 2), d AS (SELECT prefix, count(*) AS df FROM f GROUP BY 1)"""


def part_index(t: Tables) -> fts.Index:
    return fts.build(t.part.select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("body")), "p_partkey", {"title": 4.0, "body": 1.0})


@query(f"""WITH {_FTS} SELECT p_partkey, round(sum(greatest(1e-6, CASE WHEN docs > df THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))), 6) AS score
FROM f JOIN d USING (prefix) JOIN l USING (p_partkey) CROSS JOIN s GROUP BY 1""")
def fts_two_columns(t: Tables) -> DataFrame:
    """Titles count four times; prefixes of col, bolt and brand."""
    return fts.search(part_index(t), "col Bolt brand", "p_partkey").select("p_partkey", F.round("score", 6).alias("score"))


@query(f"""WITH w AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS x FROM documents)
SELECT 'phrase' AS how, count(*) AS n FROM w WHERE contains(x, ' of the ') UNION ALL SELECT 'loose', count(*) FROM w WHERE contains(x, ' licens') OR contains(x, ' permiss')""")
def fts_phrase_loose(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    index = fts.build(docs, "doc_id", {"text": 1.0}, expand=False)
    exact = fts.phrase(index, docs, "doc_id", "text", "Of the").agg(F.lit("phrase").alias("how"), F.count("*").alias("n"))
    return exact.union(fts.loose(index, "licens permiss", "doc_id").agg(F.lit("loose"), F.count("*")))


_SOME, _MORE, _SHORT = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]", "^[^aeiouy]+[aeiouy][^aeiouywxY]$"


def _changed(table: dict[str, str], least: str) -> str:
    """SQL over x: the longest of a table's endings changed."""
    cases = " ".join(f"WHEN ends_with(x, '{e}') THEN CASE WHEN regexp_matches(x[:-{len(e) + 1}], '{least}') THEN x[:-{len(e) + 1}] || '{v}' ELSE x END" for e, v in sorted(table.items(), key=lambda i: -len(i[0])))
    return f"CASE WHEN length(w) NOT BETWEEN 3 AND 64 THEN x {cases} ELSE x END"


def _porter(words: str) -> str:
    """SQL: p(w, stem) of the words of a table with a column w, a step a table."""
    steps = [
        "CASE WHEN ends_with(x, 'sses') OR ends_with(x, 'ies') THEN x[:-3] WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN x[:-2] ELSE x END",
        f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN regexp_matches(x[:-4], '{_SOME}') THEN x[:-2] ELSE x END WHEN ends_with(x, 'ed') AND regexp_matches(x[:-3], '[aeiouy]') THEN x[:-3] || '|' WHEN ends_with(x, 'ing') AND regexp_matches(x[:-4], '[aeiouy]') THEN x[:-4] || '|' ELSE x END",
        f"CASE WHEN NOT ends_with(x, '|') THEN x WHEN regexp_matches(x[:-2], '(at|bl|iz)$') OR regexp_matches(x[:-2], '{_SHORT}') THEN x[:-2] || 'e' WHEN lower(x[-2]) = lower(x[-3]) AND NOT regexp_matches(x[-2], '[aeiouylsz]') THEN x[:-3] ELSE x[:-2] END",
        "CASE WHEN lower(x[-1]) = 'y' AND regexp_matches(x[:-2], '[aeiouy]') THEN x[:-2] || 'i' ELSE x END",
        _changed(porter.STEP2, _SOME),
        _changed(porter.STEP3, _SOME),
        f"CASE WHEN regexp_matches(x, '[^st]ion$') THEN x ELSE {_changed(dict.fromkeys(porter.STEP4, ''), _MORE)} END",
        f"CASE WHEN ends_with(x, 'e') AND (regexp_matches(x[:-2], '{_MORE}') OR (regexp_matches(x[:-2], '{_SOME}') AND NOT regexp_matches(x[:-2], '{_SHORT}'))) THEN x[:-2] ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND regexp_matches(x, '{_MORE}') THEN x[:-2] ELSE x END",
    ]
    tables = [f"p0 AS (SELECT w, regexp_replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS x FROM (SELECT DISTINCT w FROM {words}))"]
    tables += [f"p{i} AS (SELECT w, CASE WHEN length(w) BETWEEN 3 AND 64 THEN {step} ELSE x END AS x FROM p{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join([*tables, f"p AS (SELECT w, lower(x) AS stem FROM p{len(steps)})"])


_PLACES = f"""t AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS pos FROM documents), {_porter('t')}"""


@query(f"WITH {_PLACES} SELECT w AS term, stem FROM p")
def porter_stems(t: Tables) -> DataFrame:
    """The stem of every different word of the documents."""
    words = t.documents.select(F.explode(X.words(F.col("text"))).alias("term")).distinct()
    return words.select("term", porter.stem(F.col("term")).alias("stem"))


@query(f"""WITH {_PLACES}, l AS (SELECT doc_id, len({_WORDS}) AS n FROM documents), s AS (SELECT count(*) AS docs, avg(coalesce(n, 0)) AS average FROM l), q AS (SELECT unnest(['licens', 'permiss', 'train']) AS prefix),
f AS (SELECT prefix, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM t JOIN p USING (w) JOIN q ON starts_with(stem, prefix) GROUP BY 1, 2), d AS (SELECT prefix, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(greatest(1e-6, CASE WHEN docs > df THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))), 6) AS score
FROM f JOIN d USING (prefix) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1""")
def porter_search(t: Tables) -> DataFrame:
    """Documents that hold any form of three words, all of them scored."""
    index = fts.build(t.documents, "doc_id", {"text": 1.0}, expand=False, stemmed=True)
    return fts.search(index, "licensing permissions trained", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_PLACES}, s AS (SELECT doc_id, pos, stem FROM t JOIN p USING (w) WHERE stem IN ('attion', 'to'))
SELECT DISTINCT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.stem = 'attion' AND b.stem = 'to'""")
def porter_phrase(t: Tables) -> DataFrame:
    """Documents with any form of the words of a phrase in a row, by places alone."""
    return fts.in_a_row(fts.places(t.documents, "doc_id", ["text"], stemmed=True), "doc_id", "Attions to", stemmed=True)


_LISTS = f"""a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 40), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 40),
f AS (SELECT id, sum(1.0 / (r + 1)) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)"""


def two_lists(t: Tables) -> list[DataFrame]:
    near = R.top(R.similar(t.embeddings.withColumnRenamed("vec_id", "id"), "id", "embedding", VECTOR), "score", "id", 40)
    named = R.top(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score")), "score", "id", 40)
    return [R.ranked(near, "score", "id"), R.ranked(named, "score", "id")]


@query(f"WITH {_LISTS} SELECT id, round(fused, 6) AS score FROM f ORDER BY fused DESC, id LIMIT 20")
def hybrid_node_search(t: Tables) -> DataFrame:
    return R.hybrid_search(two_lists(t), "id", 20).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_LISTS}, n AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_partkey = 7 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)
SELECT id, CASE WHEN id = 7 THEN 10.0 WHEN id IN (SELECT id FROM n) THEN 1.0 ELSE 0.0 END AS score FROM f ORDER BY score DESC, fused DESC, id LIMIT 20""")
def node_distance_rerank(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return R.hybrid_search(two_lists(t), "id", 20, "node_distance", edges=edges, centre=7)


@query(f"""WITH {_LISTS}, m AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) SELECT id, coalesce(n, 0) AS score FROM f LEFT JOIN m USING (id) ORDER BY score DESC, fused DESC, id LIMIT 20""")
def mention_rerank(t: Tables) -> DataFrame:
    return R.hybrid_search(two_lists(t), "id", 20, "mentions", mentioned=t.events.select(F.col("user_id").alias("id")))


@query("""WITH m AS (SELECT p_brand AS entity, 0.4 + max(p_size) / 100.0 AS similarity FROM part GROUP BY 1), n AS (SELECT p_brand AS entity, count(*) AS n FROM part GROUP BY 1)
SELECT p_type AS memory, round(max(similarity * 0.5 / (1 + 0.001 * power(n - 1, 2))), 8) AS boost FROM part JOIN m ON entity = p_brand JOIN n USING (entity) WHERE similarity >= 0.5 GROUP BY 1""")
def entity_boost(t: Tables) -> DataFrame:
    matches = t.part.groupBy(F.col("p_brand").alias("entity")).agg((0.4 + F.max("p_size") / 100.0).alias("similarity"))
    return R.entity_boost(matches, t.part.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("memory"))).select("memory", F.round("boost", 8).alias("boost"))


@query(f"""WITH {_LISTS} SELECT 'nodes' AS kind, CAST(id AS VARCHAR) AS id, round(fused, 6) AS score FROM (SELECT * FROM f ORDER BY fused DESC, id LIMIT 10)
UNION ALL SELECT 'facts', CAST(id AS VARCHAR), round(s, 6) AS s FROM (SELECT vec_id AS id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10)""")
def four_way_search(t: Tables) -> DataFrame:
    facts = R.top(R.similar(t.embeddings.withColumnRenamed("vec_id", "id"), "id", "embedding", VECTOR), "score", "id", 10)
    return R.search_all({"nodes": R.hybrid_search(two_lists(t), "id", 10), "facts": facts}, "id").withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT page_id, lower(html) AS x, length(html) AS n FROM pages), w AS (SELECT page_id, x, unnest(range(0, 1 + greatest(0, n - 400), greatest(1, (n - 400) // 40))) AS pos FROM p),
h AS (SELECT page_id, pos, len(string_split(substr(x, pos + 1, 400), 'href')) - 1 + len(string_split(substr(x, pos + 1, 400), 'class')) - 1 AS hits FROM w)
SELECT page_id, arg_min(pos, (-hits, pos)) AS start_at, max(hits) AS hits FROM h GROUP BY 1""")
def keyword_window(t: Tables) -> DataFrame:
    best = X.densest_window(F.col("html"), ["href", "class"], 400)
    return t.pages.select("page_id", best.alias("b")).select("page_id", F.col("b.at").cast("long").alias("start_at"), F.col("b.hits").cast("long").alias("hits"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_name), 'bolt')")
def trigram_postings(t: Tables) -> DataFrame:
    return R.by_trigrams(R.trigram_postings(t.part, "p_partkey", "p_name"), t.part, "p_partkey", "p_name", ["widget", "bolt"])


@query("SELECT c_custkey FROM customer WHERE contains(c_name, '00123') OR contains(c_name, '0101') OR contains(c_name, '77')")
def trigram_rare(t: Tables) -> DataFrame:
    """Needles whose trigrams others have too, and one shorter than a trigram."""
    return R.by_trigrams(R.trigram_postings(t.customer, "c_custkey", "c_name"), t.customer, "c_custkey", "c_name", ["00123", "0101", "77"])


@query("""WITH s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings) SELECT id, round(list_sum(list_transform(v, lambda x: abs(x))), 5) AS size FROM (SELECT id, CASE WHEN label = 3 THEN list_transform(e, lambda x: -x / sqrt(list_inner_product(e, e))) ELSE list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) END AS v FROM s WHERE label NOT IN (5, 7))""")
def vector_store(t: Tables) -> DataFrame:
    """Everything is added, cleared and added again; label 3 is replaced, labels 5 and 7 are deleted."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    journal = t.spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, op string, seq long")
    journal = V.add(V.clear(V.add(journal, rows.withColumn("id", F.col("id") + 1_000_000), 1), 2), rows, 3)
    journal = V.add(journal, rows.where("label = 3").withColumn("vector", F.transform("vector", lambda x: -x)), 4)
    journal = V.delete(journal, rows.where("label IN (5, 7)"), 5)
    return V.state(journal).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("size"))


_FACTS = """CAST(doc_id AS BIGINT) AS id, source AS src, lang AS dst, lang AS name, DATE '2020-01-01' + CAST(doc_id % 1000 AS INT) AS valid_at, CASE WHEN doc_id % 3 = 0 THEN DATE '2020-01-01' + CAST(doc_id % 1000 + 100 AS INT) END AS invalid_at"""


def _fused(where: str) -> str:
    return f"""{_BM25}, k AS (SELECT * FROM (SELECT {_FACTS} FROM documents) WHERE {where}), x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM b WHERE doc_id IN (SELECT id FROM k) QUALIFY r < 20),
y AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS r FROM embeddings WHERE vec_id IN (SELECT id FROM k) QUALIFY r < 20)"""


def facts_of(t: Tables) -> tuple[DataFrame, list[DataFrame]]:
    """Documents as facts, with a lexical and a vector search over all of them."""
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    held = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("lang").alias("dst"), F.col("lang").alias("name"), day(F.col("doc_id") % 1000).alias("valid_at"), F.when(F.col("doc_id") % 3 == 0, day(F.col("doc_id") % 1000 + 100)).alias("invalid_at"))
    lexical = R.bm25(t.documents, "doc_id", "text", QUESTION).withColumnRenamed("doc_id", "id")
    return held, [lexical, R.similar(t.embeddings.withColumnRenamed("vec_id", "id"), "id", "embedding", VECTOR)]


@query(f"""{_fused("valid_at <= DATE '2021-01-01' AND (invalid_at IS NULL OR invalid_at > DATE '2021-01-01')")}
SELECT id, src, round(score, 6) AS score FROM (SELECT id, sum(1.0 / (r + 1)) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1) JOIN k USING (id) ORDER BY score DESC, id LIMIT 10""")
def facts_as_of(t: Tables) -> DataFrame:
    """The best facts that were true on a day."""
    held, lists = facts_of(t)
    return facts.search_facts(held, lists, facts.validity(at=datetime.date(2021, 1, 1)), 10).select("id", "src", F.round("score", 6).alias("score"))


@query(f"""{_fused("invalid_at IS NULL AND name IN ('en', 'de') AND valid_at >= DATE '2020-02-01'")}, z AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM k WHERE src = 'src2' OR dst = 'src2' OR dst IN (SELECT dst FROM k WHERE src = 'src2') QUALIFY r < 20)
SELECT id, src, CASE WHEN src = 'src2' THEN 10.0 ELSE 0.0 END AS score FROM (SELECT id, sum(1.0 / (r + 1)) AS fused FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z) GROUP BY 1) JOIN k USING (id) ORDER BY score DESC, fused DESC, id LIMIT 10""")
def fact_search(t: Tables) -> DataFrame:
    """Facts of two kinds that still hold, from a day on, ranked around a source."""
    held, lists = facts_of(t)
    where = facts.validity(names=["en", "de"], valid_after=datetime.date(2020, 2, 1), current_only=True)
    return facts.search_facts(held, lists, where, 10, centre="src2")


@query(f"""WITH z AS ({ORACLES["porter_search"].replace("), 6) AS score", "), 3) AS score")}), k AS (SELECT {_FACTS} FROM documents)
SELECT id, score, valid_at, invalid_at FROM (SELECT * FROM z ORDER BY score DESC, doc_id LIMIT 5) JOIN k ON id = doc_id""")
def facts_by_words(t: Tables) -> DataFrame:
    """The facts that some words find, with their validity."""
    held, _ = facts_of(t)
    index = fts.build(t.documents.select(F.col("doc_id").alias("id"), "text"), "id", {"text": 1.0}, expand=False, stemmed=True)
    return facts.by_words(held, index, ["licensing", "permissions", "trained"], 5)


@query(f"""{_BM25}, a AS (SELECT doc_id, source FROM b JOIN documents USING (doc_id) JOIN (SELECT doc_id, count(*) FILTER (tf > 0) = 3 AS every FROM f GROUP BY 1) USING (doc_id) ORDER BY every DESC, score DESC, doc_id LIMIT 1),
r AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id % 97, d.doc_id) AS k FROM documents d JOIN a USING (source))
SELECT r.doc_id, k - (SELECT k FROM r JOIN a USING (doc_id)) AS pos FROM r WHERE pos BETWEEN -5 AND 8""")
def timeline_by_query(t: Tables) -> DataFrame:
    """What lies around the best answer in its source."""
    rows = t.documents.select("doc_id", "text", "source", (F.col("doc_id") % 97).alias("ts"))
    return sessions.timeline(rows, "doc_id", "ts", "text", QUESTION, 5, 8, "source").select("doc_id", "pos")
