"""Masking of credentials over whole tables, and counts of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions import secrets as S
from corvidex.operators import nested as nested_values
from corvidex.plans.base import Tables, query
from corvidex.sources.tables import spread

# The shapes as the SQL engine's regular expressions have them: it knows no lookaround, so that what stands beside a match is
# taken along and put back.
_START, _BARE = "(^|[^A-Za-z0-9_])", "(?:^|[^A-Za-z0-9/+=_.-])([A-Za-z0-9/+]{40})(?:[^A-Za-z0-9/+=_.-]|$)"
_SHAPES = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|\z)", "***"),
    (r"(://)[^\s/:@''\"<>]+:[^\s/''\"<>]*(@[^@\s/''\"<>]+(?:[/:?#\s''\"<>]|$))", r"\1***\2"),
    (r"(?i)(authorization\s*[:=]\s*[''\"]?(?:basic|digest)\s+)[A-Za-z0-9+/=_-]{8,}", r"\1***"),
    (r"(?i)(aws[_-]?secret[_-]?(?:access[_-]?)?key[\"'']?\s*[:=]\s*[\"'']?)[A-Za-z0-9/+=]{40}([^A-Za-z0-9/+=]|$)", r"\1***\2"),
    (r"https://hooks\.slack\.com/(?:services|workflows|triggers)/[A-Za-z0-9/_-]{16,}", "***"),
    (_START + r"hf_[A-Za-z0-9]{34,}", r"\1***"),
    (_START + r"(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{50,255})", r"\1***"),
    (_START + r"glpat-[A-Za-z0-9_-]{20,}", r"\1***"),
    (_START + r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16}([^A-Za-z0-9]|$)", r"\1***\2"),
    (_START + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\1***"),
    (_START + r"(?:xox[abposr]-[A-Za-z0-9-]{10,}|xapp-\d-[A-Za-z0-9-]{10,})", r"\1***"),
    (_START + r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"\1***"),
    (_START + r"sk-ant-[A-Za-z0-9_-]{20,}", r"\1***"),
    (_START + r"sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}", r"\1***"),
    (_START + r"npm_[A-Za-z0-9]{36}([^A-Za-z0-9]|$)", r"\1***\2"),
    (_START + r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{20,}", r"\1***"),
    (_START + r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"\1***"),
    (_START + r"AIza[0-9A-Za-z_-]{35}([^A-Za-z0-9_-]|$)", r"\1***\2"),
    (r"(AccountKey=)[A-Za-z0-9+/]{60,}={0,2}", r"\1***"),
)


def _shapes(text: str) -> str:
    for k, (pattern, shown) in enumerate(_SHAPES):
        text = f"regexp_replace({text}, '{pattern}', '{shown}', 'g')"
        if k == 3:
            text = f"list_reduce(list_prepend({text}, list_filter(regexp_extract_all({text}, '{_BARE}', 1), lambda s: regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]'))), lambda a, s: replace(a, s, '***'))"
    return text


_NAMED = r"[\w-]*(?:token|secret|password|passwd|api[_-]?key|private[_-]?key|credential)[\w-]*"
_PAIR = rf"(?i)\b{_NAMED}[\"'']?\s*[=:]\s*(?:\"[^\s''\"]+\"|''[^\s''\"]+''|[^\s''\"]+)"
_GROUPS = rf"(?i)^({_NAMED}[\"'']?\s*[=:]\s*)(\"|''|)([^\s''\"]+)[\"'']?$"


def _secret(value: str, tight: str) -> str:
    none = f"({value} = '' OR lower({value}) IN ('true', 'false', 'none', 'null', 'nil', 'undefined', 'str', 'string', 'int', 'bool') OR regexp_matches({value}, '^[0-9]+$') OR regexp_matches({value}, '(?i)^(?:\\$|<|\\{{\\{{|\\*{{3}}|\\[redacted\\]|%\\w)'))"
    code = f"(regexp_matches({value}, '[()]') OR regexp_matches({value}, '^[A-Za-z_]+(?:\\.[A-Za-z_]+)+$'))"
    dense = f"(length({value}) >= 8 AND regexp_matches({value}, '[0-9]|[^\\pL\\pN_-]') AND regexp_matches({value}, '\\pL'))"
    return f"(NOT {none} AND NOT {code} AND ({tight} OR {dense}))"


@query(f"""SELECT doc_id, r <> text AS masked, md5(r) AS redacted_md5 FROM (SELECT doc_id, text, {_shapes('text')} AS r FROM documents)""")
def redact_secrets(t: Tables) -> DataFrame:
    """All shapes of credentials in all documents."""
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", "text", S.redact_shapes(F.col("text")).alias("r"))
    return rows.select("doc_id", (F.col("r") != F.col("text")).alias("masked"), F.md5("r").alias("redacted_md5"))


@query(f"""WITH x AS (SELECT doc_id, text, string_split_regex(text, '{_PAIR}') AS p, list_transform(regexp_extract_all(text, '{_PAIR}'), lambda m: {{'m': m, 'head': regexp_extract(m, '{_GROUPS}', 1), 'quote': regexp_extract(m, '{_GROUPS}', 2), 'value': regexp_extract(m, '{_GROUPS}', 3)}}) AS m FROM documents),
y AS (SELECT doc_id, p, list_transform(m, lambda g: CASE WHEN {_secret('g.value', "(NOT regexp_matches(g.head, '\\s') OR g.quote <> '')")} THEN g.head || g.quote || '***' || g.quote ELSE g.m END) AS m, len(list_filter(m, lambda g: {_secret('g.value', "(NOT regexp_matches(g.head, '\\s') OR g.quote <> '')")})) AS masked FROM x)
SELECT doc_id, masked, md5(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(m[i], '')), '')) AS redacted_md5 FROM y""")
def redact_named_values(t: Tables) -> DataFrame:
    """Values of credential-looking names in all documents, and how many are masked."""
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", S.redact_pairs(F.col("text")).alias("r"), (F.size(F.split("text", S.PAIR, -1)) - 1).alias("pairs"), F.regexp_extract_all("text", F.lit(S.PAIR), F.lit(0)).alias("before"))
    masked = F.size(F.filter(F.zip_with("before", F.regexp_extract_all("r", F.lit(S.PAIR), F.lit(0)), lambda x, y: (x != y) & F.endswith(F.regexp_replace(y, "[\"']$", ""), F.lit(S.MASK))), lambda x: x))
    return rows.select("doc_id", masked.cast("long").alias("masked"), F.md5("r").alias("redacted_md5"))


@query(f"""WITH e AS (SELECT event_id, event_type AS a, event_type || '-' || event_id AS b, props FROM events)
SELECT event_id, CASE WHEN {_secret('a', 'TRUE')} THEN '***' ELSE a END AS named, CASE WHEN {_secret('b', 'TRUE')} THEN '***' ELSE b END AS listed, a AS plain, 'token=***' AS inner_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e""")
def redact_nested(t: Tables) -> DataFrame:
    """Each event as a nested value: a string under a name, strings of a list under a name, a plain one, a pair in a text."""
    a = F.col("event_type")
    b = F.concat(a, F.lit("-"), F.col("event_id").cast("string"))
    text = F.concat(F.lit("token="), F.regexp_replace(b, "[0-9]", "x"))
    nested = F.struct(F.from_json("props", "k bigint").alias("props"), F.array(F.struct(a.alias("Api_Key"), a.alias("kind")), F.struct(F.lit("none").alias("Api_Key"), text.alias("kind"))).alias("calls"), F.struct(F.array(F.lit("true"), b).alias("password")).alias("env"))
    out = nested_values.redact(t.events.select("event_id", F.to_json(nested).alias("v")), "event_id", "v").select("event_id", F.parse_json("v").alias("v"))
    at = lambda path, kind, name: F.variant_get("v", path, kind).alias(name)
    return out.select("event_id", at("$.calls[0].Api_Key", "string", "named"), at("$.env.password[1]", "string", "listed"), at("$.calls[0].kind", "string", "plain"), at("$.calls[1].kind", "string", "inner_text"), at("$.props.k", "bigint", "k"))


@query(f"""WITH t AS (SELECT 'documents' AS place, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations),
h AS (SELECT place, list_filter(['key-value', 'aws-secret-key-bare', 'url-credentials'], lambda s: text IS NOT NULL AND CASE s
WHEN 'key-value' THEN len(list_filter(regexp_extract_all(text, '{_PAIR}'), lambda m: {_secret(f"regexp_extract(m, '{_GROUPS}', 3)", f"(NOT regexp_matches(regexp_extract(m, '{_GROUPS}', 1), '\\s') OR regexp_extract(m, '{_GROUPS}', 2) <> '')")})) > 0
WHEN 'aws-secret-key-bare' THEN len(list_filter(regexp_extract_all(text, '{_BARE}', 1), lambda s: regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]'))) > 0
ELSE regexp_matches(text, '{_SHAPES[1][0]}') END) AS hits FROM t)
SELECT place, shape, count(*) AS n FROM (SELECT place, unnest(list_append(hits, 'scanned')) AS shape FROM h) GROUP BY 1, 2""")
def redaction_scan(t: Tables) -> DataFrame:
    """Rows of each table, and of those with each shape; values stay where they are. Of the shapes only these three occur."""
    texts = [rows.select(F.lit(place).alias("place"), F.col(c).alias("text")) for place, rows, c in (("documents", t.documents, "text"), ("pages", t.pages, "html"), ("conversations", t.conversations, "text"))]
    found = texts[0].union(texts[1]).union(texts[2]).select("place", F.explode(F.array_append(F.coalesce(S.hits(F.col("text")), F.array().cast("array<string>")), F.lit("scanned"))).alias("shape"))
    return found.groupBy("place", "shape").agg(F.count("*").alias("n"))
