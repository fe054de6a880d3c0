"""Not-modified revisit resolution for web captures (operator 4).

A revisit with status 304 has no body; its content is that of the latest earlier full response of the same canonical
URL. The as-of join is a running maximum in (url key, time) order. So that no hot URL meets in one task, the narrow
records are dealt out by range of that order and written; each range runs on its own, and the last response of the
ranges before it, one row for each key and range, is carried in.

Then validators decide: an ETag of the revisit must equal the response's, weakly compared; without an ETag,
Last-Modified must be equal. A resolved record has the response's headers, updated by those of the 304 that may
update a stored response (``NEVER`` lists those that may not).

Captures: record_id, url, ts, status, headers (array of name, value; names in any case, repeats allowed). Outcomes:
``resolved``, ``mismatch`` (validators differ), ``unvalidated`` (a 304 without validators), ``no_base``. Null url or ts:
``no_base``; null headers: none. "Earlier" is strict; of responses at one time the greatest record_id counts. Repeated
rows give repeated rows. Statuses other than 200 and 304 are ignored. No captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.common import materialize, table

#: Header fields that a 304 doesn't update, as they belong to the message or the stored body.
NEVER = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Query fields that name a visit and not a page.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"

_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)"
_PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)"


def url_key(url: Column) -> Column:
    """Canonical form: no scheme, fragment, default port, www., last slash or tracking fields; fields sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, _HOST, 1)), ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, _PATH, 1), "/+$", "")
    fields = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    query = F.array_join(F.sort_array(F.filter(fields, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host == "", bare).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _field(headers: str, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def resolve(captures: DataFrame) -> DataFrame:
    """record_id, url_key, base_record_id, outcome and merged headers of each revisit."""
    headers = F.transform(F.coalesce("headers", F.expr("array()").cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    rows = captures.where("status IN (200, 304)").select("record_id", url_key(F.col("url")).alias("url_key"), "ts", (F.col("status") == 200).cast("int").alias("full"), headers.alias("headers"))
    # A revisit comes before a response of the same time, so that it doesn't see it.
    order = ["url_key", "ts", "full", "record_id"]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "captures")
    response = F.when((F.col("full") == 1) & F.col("ts").isNotNull(), F.struct("ts", "record_id", "headers"))
    own = Window.partitionBy("url_key", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = ranged.groupBy("url_key", "part").agg(F.max_by(response, F.when(response.isNotNull(), F.struct("ts", "record_id"))).alias("__last"))
    carried = by_part.select("url_key", "part", F.last("__last", True).over(before).alias("carried")).where("carried IS NOT NULL")
    found = ranged.withColumn("__near", F.last(response, True).over(own)).where("full = 0").join(carried, ["url_key", "part"], "left")
    base = F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("__near", "carried"))
    found = found.withColumn("base", base).withColumn("stored", F.col("base.headers"))
    etag, modified = _field("headers", "etag"), _field("headers", "last-modified")
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    good = F.when(etag.isNotNull(), weak(etag) == weak(_field("stored", "etag"))).otherwise(modified == _field("stored", "last-modified"))
    outcome = F.when(F.col("base").isNull(), "no_base").when(etag.isNull() & modified.isNull(), "unvalidated").when(F.coalesce(good, F.lit(False)), "resolved").otherwise("mismatch")
    update = F.filter("headers", lambda h: ~h["name"].isin(*NEVER))
    names = F.transform("update", lambda h: h["name"])
    merged = F.concat(F.filter("stored", lambda h: ~F.array_contains("names", h["name"])), F.col("update"))
    found = found.withColumn("outcome", outcome).withColumn("update", update).withColumn("names", names)
    resolved = F.col("outcome") == "resolved"
    return found.select("record_id", "url_key", F.col("base.record_id").alias("base_record_id"), "outcome", F.when(resolved, merged).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log of the pages table: of each page a full response, and later a revisit that answered 304.

    Times and validators follow from page_id, so that some revisits meet another page's response, a stale or weak ETag,
    only a date, or no validator.
    """
    p = F.col("page_id")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    dated = field("Last-Modified", F.concat(F.lit("day "), p))
    response = F.array(field("Content-Length", F.octet_length(F.coalesce("html", F.lit("")))), field("Content-Type", F.lit("text/html")), field("ETag", etag), dated, field("Server", F.concat(F.lit("s"), p % 3)))
    sent = F.when(p % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.when(p % 3 == 0, "W/").otherwise(""), etag))
    always = F.array(field("cache-control", F.concat(F.lit("max-age="), p)), field("content-length", F.lit("0")), field("X-Cache", F.lit("hit")))
    validators = F.when(p % 13 == 0, F.slice(always, 1, 0)).when(p % 11 == 0, F.array(dated)).otherwise(F.array(field("ETag", sent)))
    full = pages.select((2 * p).alias("record_id"), "url", (10 * p).alias("ts"), F.lit(200).alias("status"), response.alias("headers"))
    revisit = pages.select((2 * p + 1).alias("record_id"), "url", (10 * p + 10 * (p % 7) + 5).alias("ts"), F.lit(304).alias("status"), F.concat(always, validators).alias("headers"))
    return full.unionByName(revisit)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.sort_array(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), "\n")
    return got.select("record_id", "url_key", "base_record_id", "outcome", F.when(F.col("headers").isNotNull(), F.sha2(lines, 256)).alias("headers_sha256"))


_ORACLE = """
WITH bare AS (
  SELECT page_id AS p, regexp_replace(trim(url), '#.*$', '') AS u, '"' || md5(coalesce(html, '')) || '"' AS etag,
         strlen(coalesce(html, '')) AS n FROM pages),
parsed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
         regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS query FROM bare),
keyed AS (
  SELECT p, etag, n, CASE WHEN host = '' THEN u ELSE host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key FROM parsed),
revisits AS (
  SELECT *, 10 * p + 10 * (p % 7) + 5 AS ts,
         CASE WHEN p % 13 = 0 OR p % 11 = 0 THEN NULL WHEN p % 5 = 0 THEN '"stale"' WHEN p % 3 = 0 THEN 'W/' || etag ELSE etag END AS sent,
         CASE WHEN p % 13 <> 0 AND p % 11 = 0 THEN 'day ' || p END AS dated FROM keyed),
ranked AS (
  SELECT r.*, b.p AS bp, b.etag AS betag, b.n AS bn, row_number() OVER (PARTITION BY r.p ORDER BY b.p DESC) AS k
  FROM revisits r LEFT JOIN keyed b ON r.url_key = b.url_key AND 10 * b.p < r.ts),
judged AS (
  SELECT *, CASE WHEN bp IS NULL THEN 'no_base' WHEN sent IS NULL AND dated IS NULL THEN 'unvalidated'
    WHEN sent IS NOT NULL AND regexp_replace(sent, '^W/', '') = betag THEN 'resolved'
    WHEN sent IS NULL AND dated = 'day ' || bp THEN 'resolved' ELSE 'mismatch' END AS outcome FROM ranked WHERE k = 1)
SELECT 2 * p + 1 AS record_id, url_key, 2 * bp AS base_record_id, outcome,
  CASE WHEN outcome = 'resolved' THEN sha256(array_to_string(list_sort([
    'cache-control: max-age=' || p, 'content-length: ' || bn, 'content-type: text/html', 'etag: ' || coalesce(sent, betag),
    'last-modified: ' || coalesce(dated, 'day ' || bp), 'server: s' || (bp % 3), 'x-cache: hit']), chr(10))) END AS headers_sha256
FROM judged
"""

QUERIES = {"op4_revisits": op4_revisits}
ORACLES = {"op4_revisits": _ORACLE}
