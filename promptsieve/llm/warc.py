"""WARC derivatives: linked metadata and plain-text conversion records for response records.

A response gives one metadata record, JSON with its HTTP headers, title, description and links, and one conversion record,
its plain text. Both refer to the response by ``WARC-Refers-To`` and keep its target, date, headers' content type and digests; the
conversion's own digest covers its text. Record ids are name-based, so reruns and retried tasks give the same ids.

Everything is a projection of the response row: no shuffle. ``write`` stores records in WARC/1.1 form, as many files as
partitions, through Spark's writer, so that failed tasks leave nothing behind; ``read`` parses such files again.

Edge cases: a null or empty page gives a response with an empty payload, an empty text and no links; a null url is an
empty target; rows that repeat an id and a payload give the same record ids; an empty table gives no records; extra columns
are ignored. Digests are SHA-1 in hexadecimal.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOFTWARE = "promptsieve"
DATE = "2024-01-01T00:00:00Z"   # of pages that come without one
CRLF = "\r\n"

# Entities that plain text decodes, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HIDDEN = "(?is)<!--.*?-->" + "".join(f"|<{e}\\b[^>]*>.*?</{e}\\s*>" for e in ("script", "style", "noscript", "template"))
LINK = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"
TITLE = "(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = "(?is)<meta\\s[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)"
BLOCKS = ("(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav"
          "|ol|p|pre|section|table|td|th|title|tr|ul)\\b[^>]*>")


def _sha1(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(text, "UTF-8")))


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _decoded(text: Column) -> Column:
    for name, plain in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def plain_text(html: Column) -> Column:
    """Visible text: hidden elements and tags out, blocks on lines of their own, entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, "\\s+", " "), BLOCKS, "\n")
    text = _decoded(F.regexp_replace(text, "(?s)<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\n[ \n]*", "\n")
    return F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")


def links(html: Column) -> Column:
    """Targets of anchors' href, as written, in order."""
    found = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "),
                                 F.lit(LINK), F.lit(1))
    return F.transform(found, _decoded)


def responses(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Response records of (key, url, html): record_id, target_uri, date, http_status, http_headers and payload."""
    payload, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.array(F.lit("Content-Type: text/html; charset=utf-8"),
                      F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")))
    return pages.select(F.col(key).cast("bigint").alias("key"),
                        _uuid("response", url, F.col(key).cast("string"), F.md5(payload)).alias("record_id"),
                        url.alias("target_uri"), F.lit(DATE).alias("date"), F.lit("HTTP/1.1 200 OK").alias("http_status"),
                        headers.alias("http_headers"), payload.alias("payload"))


def derived(found: DataFrame) -> DataFrame:
    """Records (key, type, record_id, refers_to, target_uri, date, content_type, payload_digest, block_digest, n_links,
    block): of each response itself, its metadata and its conversion."""
    rows = found.withColumns({"_text": plain_text(F.col("payload")), "_links": links(F.col("payload")),
                              "_digest": _sha1(F.col("payload"))})
    title = _decoded(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "\\s+", " "))
    description = F.regexp_extract("payload", DESCRIPTION, 1)
    meta = F.to_json(F.struct(
        F.col("target_uri").alias("uri"), F.col("http_status").alias("status"), F.col("http_headers").alias("headers"),
        F.trim(title).alias("title"), description.alias("description"), F.col("_links").alias("links"),
        F.col("_digest").alias("payload_digest")))
    head = F.concat("http_status", F.lit(CRLF), F.array_join("http_headers", CRLF), F.lit(CRLF + CRLF))
    none = F.lit(None).cast("string")

    def record(kind: str, record_id: Column, refers_to: Column, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), record_id.alias("record_id"), refers_to.alias("refers_to"),
                        F.lit(content_type).alias("content_type"), block.alias("block"))
    source = F.col("record_id")
    three = F.array(record("response", source, none, "application/http; msgtype=response", F.concat(head, "payload")),
                    record("metadata", _uuid("metadata", source), source, "application/json", meta),
                    record("conversion", _uuid("conversion", source), source, "text/plain", F.col("_text")))
    rows = rows.select("key", "target_uri", "date", F.col("_digest").alias("payload_digest"),
                       F.size("_links").cast("bigint").alias("n_links"), F.explode(three).alias("_r"))
    return rows.select("key", "_r.type", "_r.record_id", "_r.refers_to", "target_uri", "date", "_r.content_type",
                       "payload_digest", _sha1(F.col("_r.block")).alias("block_digest"), "n_links", "_r.block")


def digest(records: DataFrame) -> DataFrame:
    """The records with their block's length in bytes in place of the block."""
    return records.select(F.col("key").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "content_type",
                          "payload_digest", "block_digest", "n_links",
                          F.octet_length("block").cast("bigint").alias("n_bytes"))


def serialized(records: DataFrame) -> DataFrame:
    """One string per record, without the two line ends that close it."""
    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value)      # null without a value: left out
    fields = [F.lit("WARC/1.1"), field("WARC-Type", F.col("type")), field("WARC-Record-ID", F.col("record_id")),
              field("WARC-Refers-To", F.col("refers_to")), field("WARC-Target-URI", F.col("target_uri")),
              field("WARC-Date", F.col("date")), field("WARC-Payload-Digest", F.when(F.col("type") == "response",
                                                                                     F.col("payload_digest"))),
              field("WARC-Block-Digest", F.col("block_digest")), field("Content-Type", F.col("content_type")),
              field("Content-Length", F.octet_length("block").cast("string"))]
    return records.select(F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF), "block").alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files below ``path``, one per partition."""
    serialized(records).write.option("lineSep", CRLF + CRLF).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers as a map, block) of every record below ``path``; a block is as long as its header says."""
    def run(batches):
        for batch in batches:
            for value in batch.column("content"):
                data, at = value.as_buffer(), 0
                data = bytes(data)
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    lines = data[at:end].decode().split("\r\n")[1:]
                    headers = dict(line.split(": ", 1) for line in lines)
                    size = int(headers["Content-Length"])
                    block = data[end + 4:end + 4 + size].decode()
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(headers)]), pa.array([block])],
                                                     names=["headers", "block"])
                    at = end + 4 + size + 4
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(run, "headers string, block string")
    return rows.select(F.from_json("headers", "map<string,string>").alias("headers"), "block")
