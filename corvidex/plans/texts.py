"""Scalar text functions, chunking and exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.operators import chunks, dedup
from corvidex.plans.base import Tables, query
from corvidex.sources.tables import spread


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(p_name, ' ', '_') || 'Widget' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')) AS parts FROM part""")
def identifier_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.trim(X.split_identifiers(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Widget"), F.col("p_type")))).alias("parts"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
'(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_html(F.col("html"))).alias("text_md5"))


@query("""SELECT host, count(*) AS n, count(*) FILTER (contains(url, '?')) AS with_query FROM (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages) GROUP BY 1""")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("url", X.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("url").contains("?")).alias("with_query"))


@query("""SELECT doc_id, round(1000 * len(regexp_extract_all(text, '(^|[ \\n])[A-Z]')) / greatest(1, length(text) // 4), 6) AS density FROM documents""")
def text_density(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.density(F.col("text")), 6).alias("density"))


_SUBJECT = """CASE event_id % 8 WHEN 0 THEN 'Fix typo in docs' WHEN 1 THEN 'add a prefix to ' || event_type WHEN 2 THEN 'Hot-fix for a crash in ' || event_type WHEN 3 THEN 'Reverts the rollback of ' || event_type
WHEN 4 THEN 'CVE-2024-1 and a race condition' WHEN 5 THEN 'fixes bug ' || event_id WHEN 6 THEN 'style: fixed data loss' ELSE 'schema of ' || event_type END"""
_BODY = "CASE WHEN event_type = 'error' THEN 'a leak, then an outage' WHEN event_id % 3 = 0 THEN 'fix of a fix; roll back' END"


@query(f"""WITH c AS (SELECT event_id, {_SUBJECT} AS s, coalesce({_BODY}, '') AS b FROM events), f AS (SELECT event_id, s, list_transform(regexp_extract_all(s || chr(10) || b, '{X.RISK}', 1), lambda x: replace(split_part(lower(x), '-', 1), ' ', '_')) AS f FROM c)
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(f, lambda x: NOT (regexp_matches(s, '{X.COSMETIC}') AND x IN ('fix', 'fixes', 'fixed', 'bug'))), CASE WHEN regexp_matches(s, '(?i)\\brevert') THEN ['revert'] ELSE [] END))), ',') AS tags FROM f""")
def risk_tags(t: Tables) -> DataFrame:
    """Events told as changes with a subject and a body."""
    return t.events.select("event_id", F.array_join(X.risk_tags(F.expr(_SUBJECT), F.expr(_BODY)), ",").alias("tags"))


@query("""SELECT doc_id, k AS chunk, substr(text, k * 2000 + 1, 2200) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 2000.0) AS BIGINT)))) AS k FROM documents)""")
def chunk_by_size(t: Tables) -> DataFrame:
    return chunks.by_size(t.documents.select("doc_id", "text"), "text", 2200, 200).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "body")


@query("""WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k, coalesce(length(text), 0) AS n FROM conversations),
w AS (SELECT conv_id, k, n, CAST(0 AS BIGINT) AS chunk, n AS filled FROM r WHERE k = 1 UNION ALL
SELECT r.conv_id, r.k, r.n, CASE WHEN w.filled + r.n > 500 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.filled + r.n > 500 THEN r.n ELSE w.filled + r.n END FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1)
SELECT conv_id, chunk, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars FROM w GROUP BY 1, 2""")
def chunk_messages(t: Tables) -> DataFrame:
    return chunks.messages(t.conversations, "conv_id", "turn", "text", 500)


@query("""SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS keep FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_dup_groups(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).where("copies > 1")


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS s FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM w a JOIN w b ON a.item_id < b.item_id)
SELECT a, b, round(i / (na + nb - i), 6) AS jaccard FROM p WHERE i / (na + nb - i) >= 0.15""")
def jaccard_pairs_exact(t: Tables) -> DataFrame:
    return dedup.jaccard_pairs(t.benchmark, "item_id", X.words(F.col("text")), 0.15)


@query("""SELECT p_partkey, round(-list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name)
* log2(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name)))), 6) AS entropy FROM part""")
def label_entropy(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(X.entropy(F.col("p_name")), 6).alias("entropy"))


@query("""SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name), p_type) AS canonical FROM part""")
def label_merge(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.min("p_partkey").over(Window.partitionBy(X.key(F.col("p_name")), "p_type")).alias("canonical"))


def entity_names(t: Tables) -> DataFrame:
    """id (a letter for the table, and the key), label: whole names."""
    named = lambda rows, kind, key, label: rows.select(F.concat(F.lit(kind), F.col(key)).alias("id"), F.col(label).alias("label"))
    return named(t.supplier, "s", "s_suppkey", "s_name").union(named(t.customer, "c", "c_custkey", "c_name")).union(named(t.part, "p", "p_partkey", "p_name"))


@query()
def entity_dedup(t: Tables) -> DataFrame:
    """Names of suppliers, customers and parts by shingle MinHash, banding and Jaro-Winkler, with guards; see the tests."""
    return dedup.entities(entity_names(t))


@query()
def hash_embed(t: Tables) -> DataFrame:
    return chunks.hash_embed(t.documents.select("doc_id", "text"), "doc_id", "text")


_STEM = """CASE WHEN ends_with(w, 'ingly') AND length(w) > 7 THEN w[:-6] WHEN ends_with(w, 'edly') AND length(w) > 6 THEN w[:-5] WHEN ends_with(w, 'ing') AND length(w) > 5 THEN w[:-4] WHEN ends_with(w, 'ers') AND length(w) > 5 THEN w[:-4] WHEN ends_with(w, 'ies') AND length(w) > 5 THEN w[:-4] WHEN ends_with(w, 'ied') AND length(w) > 5 THEN w[:-4]
WHEN ends_with(w, 'ed') AND length(w) > 4 THEN w[:-3] WHEN ends_with(w, 'es') AND length(w) > 4 THEN w[:-3] WHEN ends_with(w, 'er') AND length(w) > 4 THEN w[:-3] WHEN ends_with(w, 'ly') AND length(w) > 4 THEN w[:-3] WHEN ends_with(w, 's') AND length(w) > 3 THEN w[:-2] ELSE w END"""
_FUNCTION = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)
_LIST = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents) SELECT {_STEM} AS stem, count(*) AS n FROM w GROUP BY 1""")
def stem_counts(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(X.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(X.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_FUNCTION}))) AS w FROM documents)
SELECT doc_id, count(*) AS n, count(DISTINCT {_STEM}) AS stems FROM w GROUP BY 1""")
def lemma_counts(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(X.lemmas(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("w").alias("stems"))


@query("""SELECT doc_id, md5(strip_accents(translate(text, 'łŁßøØæÆœŒđĐħıĸŋŊŧŦþÞð', ''))) AS plain_md5 FROM documents""")
def diacritics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.plain_letters(F.translate("text", "łŁßøØæÆœŒđĐħıĸŋŊŧŦþÞð", ""))).alias("plain_md5"))


@query("""SELECT p_partkey, damerau_levenshtein(p_brand, 'Brand#' || reverse(right(p_brand, 2))) AS swapped, damerau_levenshtein(p_name, p_name || 's') AS longer, levenshtein(p_type, p_brand) AS far FROM part""")
def edit_distances(t: Tables) -> DataFrame:
    swapped = X.edit_distance(F.col("p_brand"), F.concat(F.lit("Brand#"), F.reverse(F.right("p_brand", F.lit(2)))))
    return t.part.select("p_partkey", swapped.cast("long").alias("swapped"), X.edit_distance(F.col("p_name"), F.concat("p_name", F.lit("s"))).cast("long").alias("longer"), F.levenshtein("p_type", "p_brand").cast("long").alias("far"))


@query("""WITH p AS (SELECT p_partkey, ['py', 'tsx', 'kt', 'rs', 'md', 'png', 'toml', 'zip'][1 + CAST(p_size % 8 AS INT)] AS ext FROM part)
SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'web' WHEN 'kt' THEN 'jvm' WHEN 'rs' THEN 'rust' ELSE 'other' END AS family, CASE WHEN ext IN ('py', 'tsx', 'kt', 'rs') THEN 'code' WHEN ext = 'md' THEN 'document' WHEN ext = 'png' THEN 'image' WHEN ext = 'toml' THEN 'config' ELSE 'other' END AS category, count(*) AS n FROM p GROUP BY 1, 2""")
def language_families(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/File"), "p_partkey", F.lit("."), F.upper(F.element_at(F.array(*[F.lit(x) for x in ("py", "tsx", "kt", "rs", "md", "png", "toml", "zip")]), (1 + F.col("p_size") % 8).cast("int"))))
    return t.part.groupBy(X.family(path).alias("family"), X.category(path).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, CASE WHEN starts_with(p_brand, 'Brand#22') THEN 9.0 WHEN starts_with(p_brand, 'Brand#2') THEN 2.5 WHEN starts_with(p_brand, 'Brand#1') THEN 1.5 END AS price, count(*) AS n FROM part GROUP BY 1""")
def price_lookup(t: Tables) -> DataFrame:
    price = X.longest_prefix(F.col("p_brand"), {"Brand#1": 1.5, "Brand#2": 2.5, "Brand#22": 9.0})
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", price.alias("price"), "n")


@query(f"""WITH w AS (SELECT p_partkey, {_LIST.format("p_name || ' of the ' || p_type")} AS a, {_LIST.format("p_type || ' and ' || p_brand")} AS b, p_name || ' of the ' || p_type AS x, p_type || ' and ' || p_brand AS y FROM part),
c AS (SELECT *, list_filter(a, lambda x: x NOT IN ({_FUNCTION})) AS ca, list_filter(b, lambda x: x NOT IN ({_FUNCTION})) AS cb FROM w)
SELECT p_partkey, round(len(list_intersect(ca, cb)) / least(len(ca), len(cb)), 6) AS overlap, lower(x) = lower(y) OR len(list_intersect(a, b)) / len(list_distinct(a || b)) >= 0.6 AS same FROM c""")
def content_overlap(t: Tables) -> DataFrame:
    x, y = F.concat("p_name", F.lit(" of the "), "p_type"), F.concat("p_type", F.lit(" and "), "p_brand")
    return t.part.select("p_partkey", F.round(X.overlap(X.content(X.words(x)), X.content(X.words(y))), 6).alias("overlap"), X.same_fact(x, y).alias("same"))


@query("""SELECT count(*) FILTER (t >= 1000 AND 1000 * d / greatest(1, length(text) // 4) >= 100) AS dense, count(*) AS n FROM (SELECT text, greatest(1, length(text) // 4) AS t, len(regexp_extract_all(text, '(^|[ \\n])[A-Z]')) AS d FROM documents)""")
def chunk_gate(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_if(chunks.worth_chunking(F.col("text"))).alias("dense"), F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) || '_' || f AS id, p_partkey, f AS field, x AS text FROM (SELECT p_partkey, unnest(['p_name', 'p_type', 'p_size']) AS f, unnest([p_name, p_type, CAST(p_size AS VARCHAR)]) AS x FROM part) WHERE x <> ''""")
def doc_fan_out(t: Tables) -> DataFrame:
    return chunks.fields(t.part, "p_partkey", ["p_name", "p_type", "p_size"])


@query()
def file_slices(t: Tables) -> DataFrame:
    """Documents cut near line ends; the tests put the slices together again."""
    return chunks.by_lines(t.documents, "doc_id", "text", 2000)


@query("""SELECT source, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS words FROM documents GROUP BY 1""")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+"))).cast("long").alias("words"))
