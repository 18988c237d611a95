"""Derived WARC records: metadata and plain text, linked to the responses they come from.

A response gives two records. Both carry the identifier, URI and date of the
response they refer to; the metadata record keeps the response's HTTP headers
and digest, the conversion record its readable text. Identifiers come from
content, so a rerun makes the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text, and those that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
BLANK = r"[\x09\x0B\x0C\x0D\x20\xA0]"
#: A mark of a hidden element, and one that is closed and holds no mark but its own; the bound keeps the matcher's stack short.
MARK = rf"</?(?i:{'|'.join(HIDDEN)})\b"
PLAIN = rf"<((?i:{'|'.join(HIDDEN)}))\b[^<>]*>[^<]*+(?:(?!{MARK})<[^<]*+){{0,64}}</(?i:\1)\s*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))

DATE = "2024-01-01T00:00:00Z"
#: Columns of the derived records.
MADE = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", "block")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def identifier(*parts: Column) -> Column:
    """A urn:uuid from the hash of the parts, null ones as empty."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plain_text(df: DataFrame, html: str, name: str) -> DataFrame:
    """df with `name`, the text of the page in another column, `html`.

    Hidden elements, to the page's end where they aren't closed, and comments
    go, blocks end lines, entities are resolved (the named ones of ENTITIES and
    decimal ones of up to six digits), blanks are joined and empty lines
    dropped. Hidden elements that hold no mark of another and are closed go in
    one pass; only where a mark is left, all go kind by kind. What is tested is
    made in a projection of its own, so that it isn't made twice.
    """
    df = df.withColumn(name, F.regexp_replace(html, PLAIN, " "))
    text = F.col(html)
    for element in HIDDEN:
        text = F.regexp_replace(text, rf"(?s)<(?i:{element})\b[^>]*>.*?(?:</(?i:{element})\s*>|\z)", " ")
    text = F.when(F.col(name).rlike(MARK), text).otherwise(F.col(name))
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, rf"</?(?i:{BLOCKS})\b[^>]*>", "\n")
    df = df.withColumn(name, F.regexp_replace(text, r"<[^>]*>", ""))

    def resolved(part: Column, at: Column) -> Column:
        digits = F.regexp_extract(part, r"^([0-9]{1,6});", 1)
        letter = F.decode(F.unhex(F.lpad(F.hex(digits.cast("long")), 8, "0")), "UTF-32")
        good = (at > 0) & (digits != "")
        code = F.when(good, digits.cast("int"))
        return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.concat(letter, F.regexp_replace(part, r"^[0-9]+;", ""))).otherwise(F.concat(F.when(at > 0, F.lit("&#")).otherwise(F.lit("")), part))

    numbered = F.array_join(F.transform(F.split(F.col(name), "&#", -1), resolved), "")
    text = F.when(F.contains(F.col(name), F.lit("&#")), numbered).otherwise(F.col(name))
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    text = F.regexp_replace(text, rf"{BLANK}+", " ")
    text = F.regexp_replace(F.replace(text, F.lit(" \n"), F.lit("\n")), r"\n[\n ]+", "\n")
    return df.withColumn(name, F.trim(text, F.lit("\n ")))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers and payload of crawled pages."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(payload).cast("string"))
    return pages.select("page_id", identifier(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), payload).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response (record_id, target_uri, date, http_headers, payload).

    Returns the other columns of source first (those named like one of the
    record's are left out), then record_type, record_id,
    refers_to, target_uri, date, content_type, content_length, block_digest,
    source_digest and block. A null payload counts as empty; a null URI stays
    null and its line is left out of the metadata; header lines come in the
    order of their names. Repeated responses give repeated records. One pass,
    no shuffle.
    """
    own = ("record_id", "target_uri", "date", "http_headers", "payload")
    kept = [c for c in source.columns if c.lower() not in own + MADE]
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)
    texts = source.select(*kept, *own[:4], F.coalesce("payload", F.lit("")).alias("payload"))
    texts = texts.withColumns({"block_heading": title, "source_digest": digest(F.col("payload"))})
    texts = plain_text(plain_text(texts, "block_heading", "block_title"), "payload", "block_text")
    lines = F.concat(
        F.array(
            F.concat(F.lit("via: "), F.col("target_uri")),
            F.concat(F.lit("title: "), F.replace("block_title", F.lit("\n"), F.lit(" "))),
            F.concat(F.lit("language: "), F.nullif(F.regexp_extract("payload", r"(?i)<html[^>]*\blang=\"?([a-zA-Z-]+)", 1), F.lit(""))),
            F.concat(F.lit("outlinks: "), F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href=")).cast("string")),
            F.concat(F.lit("source-digest: "), F.col("source_digest")),
        ),
        F.transform(F.array_sort(F.map_entries("http_headers")), lambda e: F.concat(F.lit("http-header-"), F.lower(e["key"]), F.lit(": "), e["value"])),
    )
    metadata = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))
    blocks = texts.withColumn("block_metadata", metadata)
    made = blocks.select(
        *kept,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "source_digest",
        F.explode(F.array(F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("mime"), F.col("block_metadata").alias("block")), F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("mime"), F.col("block_text").alias("block")))).alias("r"),
    )
    return made.select(*kept, F.col("r.kind").alias("record_type"), identifier(F.col("r.kind"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", F.col("r.mime").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", F.col("r.block").alias("block"))


def serialised(records: DataFrame) -> DataFrame:
    """records with `record`: headers and block as a WARC 1.1 file holds them."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.array(F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")))
    return records.withColumn("record", F.concat(F.array_join(head, "\r\n"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def _oracle() -> str:
    """DuckDB's rendering of derive(responses(pages))."""

    def text(x: str) -> str:
        for name in HIDDEN:
            x = f"regexp_replace({x}, '<{name}\\b[^>]*>.*?(?:</{name}\\s*>|\\z)', ' ', 'gis')"
        x = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
        x = f"regexp_replace({x}, '</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'gi')"
        x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
        part = "p[1]"
        digits = f"regexp_extract({part}, '^([0-9]{{1,6}});', 1)"
        code = f"try_cast({digits} AS INT)"
        x = (
            f"array_to_string(list_transform(list_zip(string_split({x}, '&#'), range(len(string_split({x}, '&#')))), lambda p: CASE WHEN p[2] > 0 AND ({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
            f" THEN chr({code}) || regexp_replace({part}, '^[0-9]+;', '') ELSE (CASE WHEN p[2] > 0 THEN '&#' ELSE '' END) || {part} END), '')"
        )
        for name, letter in ENTITIES:
            x = f"replace({x}, '{name}', '{letter.replace(chr(39), chr(39) * 2)}')"
        x = f"regexp_replace({x}, '[\\x09\\x0B-\\x0D\\x20\\x{{A0}}]+', ' ', 'g')"
        return f"trim(regexp_replace(regexp_replace({x}, ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10) || ' ')"

    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    return f"""
WITH source AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
    sha256(concat_ws(chr(31), 'response', coalesce(page_id::VARCHAR, ''), coalesce(url, ''), coalesce(html, ''))) AS h FROM pages),
titled AS (SELECT *, regexp_extract(payload, '<title[^>]*>(.*?)</title', 1, 'is') AS title, {uuid("h")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest FROM source),
texts AS (SELECT *, {text("payload")} AS body, {text("title")} AS heading FROM titled),
made AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'conversion' AS record_type, 'text/plain' AS content_type, body AS block FROM texts
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata', 'application/warc-fields',
    concat_ws(chr(13) || chr(10), 'via: ' || target_uri, 'title: ' || replace(heading, chr(10), ' '),
      'language: ' || nullif(regexp_extract(payload, '<html[^>]*\\blang="?([a-zA-Z-]+)', 1, 'i'), ''),
      'outlinks: ' || len(regexp_extract_all(payload, '<a\\s[^>]*href=', 0, 'i')), 'source-digest: ' || source_digest,
      'http-header-content-length: ' || strlen(payload), 'http-header-content-type: text/html; charset=utf-8') || chr(13) || chr(10)
  FROM texts),
named AS (SELECT *, sha256(record_type || chr(31) || refers_to) AS h FROM made)
SELECT page_id, record_type, {uuid("h")} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type,
  strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM named
"""


ORACLE = _oracle()
