"""WARC derivatives: from each response a metadata and a plain-text conversion record that refer to it.

A page is read once, in one Arrow function, by patterns whose openings end at their close or at the end of the page: each
match takes all it has looked at, so time grows with the page and not with its unclosed tags. The rest is DataFrame expressions, without a
shuffle, so pages of one host or of any size spread as the input does. Ids are made from the source's id, so a rerun gives the same records.
"""

from __future__ import annotations

import html as html_
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no text, what ends a line of text, what else is a tag, and what may be a character reference. An
# opening without a close reaches to the end of the page, as in browsers; < before anything but a letter, / ! or ? is text.
# END stands for that end, which regular expression libraries write differently.
END = r"\Z"
HIDDEN = r"<!--.*?(?:-->|END)|<(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)\s*>|END)"
BREAKING = (
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|"
    r"pre|section|table|title|tr|ul)\b[^>]*(?:>|END)"
)
TAG = r"<[A-Za-z/!?][^>]*(?:>|END)"
TITLE = r"<title\b[^>]*(?:>|END)(.*?)(?:</title|END)"
ROOT = r"<html\b[^>]*"
LANGUAGE = r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
SPACES = r"[\x09\x0B\x0C\x0D\x20]+"
# An anchor's attributes: quoted values may hold >. Then one attribute: its name and its value.
ANCHOR = r"<a(\s(?:[^>\"']|\"[^\"]*(?:\"|END)|'[^']*(?:'|END))*)"
ATTRIBUTE = r"([^\s=\"'/]+)\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s]*))?|[\s=\"'/]+"
CRLF = "\r\n"
PAGE = "struct<title: string, language: string, outlinks: array<string>, text: string>"
PAGE_TYPE = pa.struct([("title", pa.string()), ("language", pa.string()), ("outlinks", pa.list_(pa.string())), ("text", pa.string())])


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("END", END), re.ASCII | re.IGNORECASE | re.DOTALL)


def decode_references(text: str) -> str:
    """All named and numeric references of HTML, in one pass; references to a no-break space give a space."""
    if "&" not in text:
        return text
    return _compiled(REFERENCE).sub(lambda m: html_.unescape(m.group()).replace("\xa0", " "), text)


def decode_attribute(value: str) -> str:
    """As in text, but a name without ``;`` before ``=``, a letter or a digit is none (``?a=1&copy=2``)."""

    def one(m: re.Match) -> str:
        whole = m.group()
        name = whole[1:]
        if name[0] != "#" and name not in html5:
            n = next((n for n in range(len(name) - 1, 1, -1) if name[:n] in html5), 0)
            if n and re.match("[=A-Za-z0-9]", name[n:]):
                return whole
        return html_.unescape(whole)

    return _compiled(REFERENCE).sub(one, value) if "&" in value else value


def page_text(html: str) -> str:
    """The text of a page: a line for each block, without comments, scripts, styles and tags; runs of space as one."""
    text = _compiled(HIDDEN).sub(" ", html)
    text = _compiled(BREAKING).sub("\n", text)
    text = decode_references(_compiled(TAG).sub("", text))
    text = re.sub(SPACES, " ", text)
    return re.sub(" ?\n[ \n]*", "\n", text).strip(" \n")


def page_links(html: str) -> list[str]:
    """The targets of a page's anchors in their order, decoded; control characters are left out as browsers do."""
    links = []
    for anchor in _compiled(ANCHOR).finditer(html):
        for attribute in _compiled(ATTRIBUTE).finditer(anchor.group(1)):
            if (attribute.group(1) or "").lower() == "href" and attribute.group(2) is not None:
                value = re.sub(r"[\x00-\x1F]", "", attribute.group(2))
                if value[:1] in ("'", '"'):
                    value = value[1:].removesuffix(value[0])
                links.append(re.sub(r"[\x00-\x1F]", "", decode_attribute(value)).strip(" "))
                break
    return links


def read_page(html: str) -> dict:
    """A page's title, language, outgoing links and text."""
    title, root = _compiled(TITLE).search(html), _compiled(ROOT).search(html)
    language = _compiled(LANGUAGE).search(root.group()) if root else None
    return {
        "title": re.sub(r"[ \t\n\v\f\r]+", " ", decode_references(title.group(1))) if title else "",
        "language": language.group(1) if language else "",
        "outlinks": page_links(html),
        "text": page_text(html),
    }


def page_parts(html: Column) -> Column:
    """``read_page`` of a column as a struct; a null page is an empty one."""

    def read(pages: pa.Array) -> pa.Array:
        return pa.array([read_page(p or "") for p in pages.to_pylist()], PAGE_TYPE)

    return F.arrow_udf(read, PAGE)(html)


def record_id(*parts: Column) -> Column:
    """A name-based record id from the parts (null parts count as such)."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    pieces = [F.substring(digest, first, n) for first, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages as response records: page_id, record_id, target_uri, date, http_headers, payload, payload_digest."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def http_header(headers: Column, name: str) -> Column:
    """A header's value, or null."""
    found = F.regexp_extract(headers, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(found, F.lit(""))


def header_lines(headers: Column) -> Column:
    """All lines of a response's header as they are, the status line too, without the empty line that ends it."""
    lines = F.split(F.coalesce(headers.cast("string"), F.lit("")), r"\r\n|\r|\n")
    return F.filter(lines, lambda x: x != "")


def derive(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Two records for each response: ``keys``, record_type, record_id, refers_to, target_uri, date, content_type,
    source_content_type, source_digest, block, block_digest, content_length and headers (the WARC header text).

    The metadata block has all lines of the source's HTTP header, each as a field source-http-line, and all outgoing
    links, each as a field outlink, in their order; links is their count.

    ``sources`` has record_id, target_uri, date, http_headers, payload and payload_digest. A missing id or digest is made
    from the record, other missing values leave their header out; a null payload is an empty text. Equal rows give equal records; other
    columns are not read. Very long and unclosed pages take time in proportion. An empty table gives an empty table.
    """
    internal = [f"_k{i}" for i in range(len(keys))]
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = sources.select(
        *[F.col(k).alias(i) for k, i in zip(keys, internal)],
        F.coalesce("record_id", record_id(F.lit("response"), F.col("target_uri"), F.col("date"), digest(payload))).alias("source"),
        "target_uri",
        "date",
        http_header(F.col("http_headers"), "content-type").alias("source_content_type"),
        F.coalesce("payload_digest", digest(payload)).alias("source_digest"),
        header_lines(F.col("http_headers")).alias("lines"),
        page_parts(payload).alias("page"),
    )
    rows = rows.select("*", "page.*").drop("page")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    each = lambda name, values: F.array_join(F.transform(values, lambda x: line(name, x)), "")
    fields = F.concat_ws(
        "",
        line("source-content-type", F.col("source_content_type")),
        line("source-payload-digest", F.col("source_digest")),
        line("title", F.nullif(F.trim("title"), F.lit(""))),
        line("language", F.nullif("language", F.lit(""))),
        line("links", F.size("outlinks")),
        line("text-digest", digest(F.col("text"))),
        each("source-http-line", F.col("lines")),
        each("outlink", F.col("outlinks")),
    )
    made = lambda kind, content, block: F.struct(
        F.lit(kind).alias("record_type"), record_id(F.lit(kind), F.col("source")).alias("record_id"), F.lit(content).alias("content_type"), block.alias("block")
    )
    both = F.array(made("metadata", "application/warc-fields", fields), made("conversion", "text/plain; charset=utf-8", F.col("text")))
    records = rows.select(*internal, "source", "target_uri", "date", "source_content_type", "source_digest", F.explode(both).alias("r"))
    length = F.octet_length("r.block").cast("long")
    headers = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("r.record_type")),
        line("WARC-Record-ID", F.col("r.record_id")),
        line("WARC-Refers-To", F.col("source")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", digest(F.col("r.block"))),
        line("Content-Type", F.col("r.content_type")),
        line("Content-Length", length),
    )
    return records.select(
        *[F.col(i).alias(k) for k, i in zip(keys, internal)],
        "r.record_type",
        "r.record_id",
        F.col("source").alias("refers_to"),
        "target_uri",
        "date",
        "r.content_type",
        "source_content_type",
        "source_digest",
        "r.block",
        digest(F.col("r.block")).alias("block_digest"),
        length.alias("content_length"),
        headers.alias("headers"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzip WARC files: header, empty line, block, and the two line ends that close a record."""
    whole = records.select(F.concat("headers", F.lit(CRLF), "block").alias("value"))
    whole.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
