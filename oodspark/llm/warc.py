"""WARC derivatives: metadata and conversion records linked to the responses they were made from.

Each response gives two records.  The metadata record (``application/warc-fields``) lists what the response says about
itself: title, language, outlinks, size, digest.  The conversion record (``text/plain``) is its readable text.  Both
refer to the response by WARC-Refers-To, keep the headers of the source and carry digests of the source payload and of
their own block.  Everything is built from columns of one row, so no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Entities that are resolved in titles and text, in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&copy;", "\u00a9"), ("&amp;", "&"))
#: An attribute's value: in double or single quotes, or bare; and the quotes around it.
VALUE, QUOTES = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", "^[\"']|[\"']$"
#: What would break a header or field line.
LINE_BREAKS = r"[\r\n]+"
#: What is hidden, without its "<"; as an alternation for SQL, and with one "<" and what can follow, which Java finds faster.
UNSEEN = (r"!--.*?-->", r"script\b.*?</script\s*>", r"style\b.*?</style\s*>", r"head\b.*?</head\s*>")
HIDDEN = "(?is)" + "|".join("<" + x for x in UNSEEN)
HIDDEN_ONCE = "(?is)<(?=[!sh])(?:" + "|".join(UNSEEN) + ")"
BREAKS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/article|/section|/ul|/nav)\b[^>]*>"
TAG = r"<[^>]*>"
#: Runs of blanks that aren't a space already: of two or more, or a tab or return.
BLANKS = r"[ \t\r](?:[ \t\r]+|(?<! ))"


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(x, "UTF-8"), 256))


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier: reruns give the same one, and equal source rows share theirs."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolved(x: Column) -> Column:
    """x with its entities resolved, in one pass: none ends in what another begins with, and what comes of one makes no other."""

    def start(piece: Column, i: Column) -> Column:
        known = F.when(i == 0, piece)  # before the first &
        for entity, char in ENTITIES:
            known = known.when(F.startswith(piece, F.lit(entity[1:])), F.concat(F.lit(char), F.substr(piece, F.lit(len(entity)))))
        return known.otherwise(F.concat(F.lit("&"), piece))

    return F.array_join(F.transform(F.split(x, "&", -1), start), "")


def readable(html: Column) -> Column:
    """Text between the tags; scripts, styles, comments and the head are hidden, block ends break lines, blanks are collapsed and empty lines left out."""
    x = F.regexp_replace(html, HIDDEN_ONCE, " ")
    x = F.regexp_replace(F.regexp_replace(x, BREAKS, "\n"), TAG, " ")
    x = F.regexp_replace(resolved(x), BLANKS, " ")
    return F.array_join(F.filter(F.transform(F.split(x, "\n", -1), lambda line: F.trim(line)), lambda line: line != ""), "\n")


#: Date of captures that have none.
DATE = "2024-01-01T00:00:00Z"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, headers (name, value) and payload of captured pages.

    A null page body is an empty payload; a page without a URL has no WARC-Target-URI header.
    """
    html = F.coalesce("html", F.lit(""))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rid = record_id("response", F.col("page_id"), F.col("url"), F.md5(html))
    headers = F.array(pair("WARC-Type", F.lit("response")), pair("WARC-Record-ID", rid), pair("WARC-Target-URI", F.col("url")), pair("WARC-Date", F.lit(date)), pair("WARC-Payload-Digest", digest(html)), pair("Content-Type", F.lit("text/html; charset=utf-8")))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"), html.alias("payload"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response of found (columns page_id, record_id, target_uri, headers, payload; others play no part).

    Columns: page_id, record_type, record_id, refers_to, target_uri, content_type, source_digest, block_digest,
    content_length (bytes), headers (name, value; those of the record, then those of the source as WARC-Source-*),
    block.  A derived record has the date of its source, or DATE, so that reruns agree; line breaks in header values, links
    and languages become spaces.  Repeated responses give repeated records with equal identifiers.  An empty payload gives an empty
    conversion.  Very long payloads are converted whole.
    """
    p = F.col("payload")
    title = F.regexp_replace(resolved(F.regexp_extract(p, r"(?is)<title\b[^>]*>(.*?)</title", 1)), r"\s+", " ")
    value = lambda x: F.regexp_replace(F.regexp_replace(x, QUOTES, ""), LINE_BREAKS, " ")
    lang = value(F.regexp_extract(p, r"(?i)<html\b[^>]*?\blang=" + VALUE, 1))
    links = F.transform(F.regexp_extract_all(p, F.lit(r"(?i)<a\b[^>]*?\bhref=" + VALUE), F.lit(1)), value)
    base = found.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", F.col("headers").alias("source"), digest(p).alias("source_digest"), F.octet_length(p).alias("bytes"), readable(p).alias("text"), F.trim(title).alias("title"), lang.alias("lang"), links.alias("links"))
    lines = [F.concat(F.lit("sourceLength: "), F.col("bytes").cast("string")), F.concat(F.lit("sourceDigest: "), F.col("source_digest")), F.concat(F.lit("textLength: "), F.octet_length("text").cast("string")), F.when(F.col("title") != "", F.concat(F.lit("title: "), F.col("title"))), F.when(F.col("lang") != "", F.concat(F.lit("languages-html: "), F.col("lang")))]
    fields = F.concat_ws(CRLF, *lines, F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)), F.lit(""))
    one = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), record_id(kind, F.col("refers_to")).alias("record_id"), F.lit(mime).alias("content_type"), block.alias("block"))
    base = base.withColumn("r", F.explode(F.array(one("metadata", "application/warc-fields", fields), one("conversion", "text/plain", F.col("text"))))).select("page_id", "refers_to", "target_uri", "source", "source_digest", "r.*")
    base = base.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    date = F.get(F.filter("source", lambda h: h["name"] == "WARC-Date"), F.lit(0))["value"]
    own = F.array(pair("WARC-Type", F.col("record_type")), pair("WARC-Record-ID", F.col("record_id")), pair("WARC-Date", F.coalesce(date, F.lit(DATE))), pair("WARC-Refers-To", F.col("refers_to")), pair("WARC-Refers-To-Target-URI", F.col("target_uri")), pair("WARC-Target-URI", F.col("target_uri")), pair("WARC-Block-Digest", F.col("block_digest")), pair("Content-Type", F.col("content_type")), pair("Content-Length", F.col("content_length").cast("string")))
    kept = F.transform("source", lambda h: F.struct(F.concat(F.lit("WARC-Source-"), F.regexp_replace(h["name"], "^WARC-", "")).alias("name"), h["value"].alias("value")))
    headers = F.filter(F.concat(own, F.coalesce(kept, F.array().cast("array<struct<name:string,value:string>>"))), lambda h: h["value"].isNotNull())
    headers = F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.regexp_replace(h["value"], LINE_BREAKS, " ").alias("value")))
    return base.withColumn("headers", headers).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest", "content_length", "headers", "block")


def serialised(records: DataFrame, version: str = "WARC/1.1") -> DataFrame:
    """page_id, record_type and record: each record of derivatives() as the text of a WARC file."""
    lines = F.concat_ws(CRLF, F.lit(version), F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])))
    return records.select("page_id", "record_type", F.concat(lines, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)).alias("record"))


def op1_warc_derivatives(spark, sf_dir):
    records = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return records.withColumn("headers", lines)


def _oracle() -> str:
    ident = lambda kind, x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5('{kind}|' || {x}) AS h))"

    def entities(x: str) -> str:
        for entity, char in ENTITIES:
            x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
        return x

    flags = lambda pattern: pattern.replace("(?is)", "(?is)").replace("'", "''")
    quoted = lambda x: x.replace("'", "''")
    value = lambda x: f"regexp_replace(regexp_replace({x}, '{quoted(QUOTES)}', '', 'g'), '{LINE_BREAKS}', ' ', 'g')"
    lang = value(r"regexp_extract(payload, '(?i)<html\b[^>]*?\blang=" + quoted(VALUE) + "', 1)")
    links = r"list_transform(regexp_extract_all(payload, '(?i)<a\b[^>]*?\bhref=" + quoted(VALUE) + f"', 1), lambda x: {value('x')})"
    text = f"regexp_replace(payload, '{flags(HIDDEN)}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{BREAKS}', chr(10), 'g'), '{TAG}', ' ', 'g')"
    text = f"regexp_replace({entities(text)}, '[ \\t\\r]+', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = entities("regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title', 1)")
    return f"""WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, {ident('response', "coalesce(page_id::VARCHAR, '') || '|' || coalesce(target_uri, '') || '|' || md5(payload)")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest FROM r),
t AS (SELECT *, {text} AS text, trim(regexp_replace({title}, '\\s+', ' ', 'g')) AS title, {lang} AS lang,
  {links} AS links FROM s),
m AS (SELECT *, concat_ws(chr(13) || chr(10), 'sourceLength: ' || strlen(payload), 'sourceDigest: ' || source_digest, 'textLength: ' || strlen(text), CASE WHEN title <> '' THEN 'title: ' || title END,
  CASE WHEN lang <> '' THEN 'languages-html: ' || lang END, CASE WHEN len(links) > 0 THEN array_to_string(list_transform(links, lambda x: 'outlink: ' || x), chr(13) || chr(10)) END, '') AS fields FROM t),
u AS (SELECT page_id, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block, refers_to, target_uri, source_digest FROM m
  UNION ALL SELECT page_id, 'conversion', 'text/plain', text, refers_to, target_uri, source_digest FROM m),
v AS (SELECT *, CASE record_type WHEN 'metadata' THEN {ident('metadata', 'refers_to')} ELSE {ident('conversion', 'refers_to')} END AS record_id, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM u)
SELECT page_id, record_type, record_id, refers_to, target_uri, content_type, source_digest, block_digest, content_length, concat_ws(chr(10), 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id,
  'WARC-Date: {DATE}', 'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || target_uri, 'WARC-Target-URI: ' || target_uri, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length,
  'WARC-Source-Type: response', 'WARC-Source-Record-ID: ' || refers_to, 'WARC-Source-Target-URI: ' || target_uri, 'WARC-Source-Date: 2024-01-01T00:00:00Z', 'WARC-Source-Payload-Digest: ' || source_digest,
  'WARC-Source-Content-Type: text/html; charset=utf-8') AS headers, block FROM v"""


QUERIES = {"op1_warc_derivatives": op1_warc_derivatives}
ORACLES = {"op1_warc_derivatives": _oracle()}
