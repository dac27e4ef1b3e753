"""WARC derivatives: from responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm.common import load, ship
from corrobora.session import scratch_path

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: The date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(noscript|template)\b[^>]*>.*?</\2\s*>", re.S | re.I)
#: Elements that hide what they close around, and nothing if they are not closed: their opening and closing tags.
_CLOSED = [(re.compile(rf"<{name}\b[^>]*>", re.I), re.compile(rf"</{name}\s*>", re.I)) for name in ("noscript", "template")]
_MAYBE = re.compile("<(?:noscript|template)", re.I)
_OWN = r"<title\b[^>]*>(?:.*?</title\s*>|[^<]*)|</?(?:base|basefont|bgsound|link|meta|noframes|noscript|template)\b[^>]*>"
#: A head, and as much as surely is its own.
_HEAD = re.compile(rf"<head\b[^>]*>(?:\s+|{_OWN})*", re.S | re.I)
#: What decides whether a head is closed: its closing tag (the group), or before that any tag that only a body has.
_HEAD_END = re.compile(rf"{_OWN}|(</head\s*>)|(</?[a-z][^>]*>)", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|main|blockquote|pre|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>?")


def record_id(*parts: object) -> str:
    """An id that the same parts always get."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _without_hidden(page: str) -> str:
    """The page without comments, scripts, styles, closed noscripts and templates, and its head.

    A head without a closing tag, which HTML allows, ends where text or a tag that is not its own begins.
    """
    for opened, closed in _CLOSED if _MAYBE.search(page) else ():
        last = max((m.start() for m in closed.finditer(page)), default=0)
        page = page[:last] + opened.sub(" ", page[last:])
    page = _HIDDEN.sub(" ", page)
    head = _HEAD.search(page)
    if not head:
        return page
    start = re.match(r"<head\b[^>]*>", head.group(), re.I).end() + head.start()
    mark = next((m for m in _HEAD_END.finditer(page, start) if m.lastindex), None)
    end = mark.end() if mark and mark.lastindex == 1 else head.end()
    return page[: head.start()] + " " + page[end:]


def plain_text(page: str) -> str:
    """The visible text of a page: one line per block, blanks collapsed, entities resolved."""
    shown = _TAG.sub("", _BLOCK.sub("\n", _without_hidden(page)))
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return "\n".join(filter(None, lines))


def page_facts(page: str) -> list[tuple[str, str]]:
    """Title, language and outgoing links of a page, as metadata fields in order of appearance."""
    title, lang = _TITLE.search(page), _LANG.search(page)
    facts = []
    if title and title.group(1).strip():
        facts.append(("title", " ".join(html.unescape(title.group(1)).split())))
    if lang:
        facts.append(("language", lang.group(1)))
    facts += [("outlink", " ".join(html.unescape(a or b or c).split())) for a, b, c in _LINK.findall(page)]
    return facts


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response block; one without a header is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return status, [(k.strip(), v.strip()) for k, _, v in pairs], payload


def charset_of(headers: list[tuple[str, str]], default: str = "utf-8") -> str:
    for name, value in headers:
        found = re.search(r"charset=\"?([\w.:-]+)", value, re.I) if name.lower() == "content-type" else None
        if found:
            try:
                b"".decode(found.group(1))
                return found.group(1)
            except LookupError:
                return default
    return default


RECORD = "kind string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block binary, block_digest string, payload_digest string"


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html) rows: the page under an HTTP header, one record per row.

    A null page is an empty one, a null url an empty target. The id hangs on
    page_id, url and content, so equal rows have equal ids and the tables can be joined again.
    """

    def framed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, page in zip(frame["page_id"].astype("Int64"), frame["url"], frame["html"]):
                body = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                block = head.encode() + body
                made = digest(body)
                rows.append((page_id, "response", record_id("response", page_id, url or "", made), None, url or "", NO_DATE,
                             "application/http; msgtype=response", {}, block, digest(block), made))
            names = ["page_id", *(c.split()[0] for c in RECORD.split(", "))]
            yield pd.DataFrame(rows, columns=names)

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(framed, "page_id long, " + RECORD)


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """The metadata and the conversion record of each response, with ``key`` and the response's id in ``refers_to``.

    The conversion block is the page's text; the metadata block lists status, source headers,
    title, language, outgoing links and the digests of the response. ``headers``
    keeps the source's HTTP headers (a repeated one joined by commas). Digests
    that come with the response are kept; a missing payload digest is computed. Rows
    without a block, and blocks that are not HTTP, give empty or plain pages; repeated rows
    give repeated records; an empty table none. Records of other kinds are passed over.
    """

    def derived(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                source = dict(zip(frame.columns, r))
                status, headers, payload = split_http(bytes(source["block"] or b""))
                page = payload.decode(charset_of(headers), "replace")
                kept: dict[str, str] = {}
                for name, value in headers:
                    kept[name] = f"{kept[name]}, {value}" if name in kept else value
                made = source["payload_digest"] or digest(payload)
                whole = source["block_digest"] or digest(bytes(source["block"] or b""))
                fields = [("refers-to", source["record_id"]), ("status", status)] if status else [("refers-to", source["record_id"])]
                fields += [("source-payload-digest", made), ("source-block-digest", whole)]
                fields += [(f"http-{k.lower()}", v) for k, v in kept.items()] + page_facts(page)
                blocks = (
                    ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page)),
                )
                for kind, content_type, text in blocks:
                    block = text.encode("utf-8", "replace")
                    rows.append((source[key], kind, record_id(kind, source["record_id"]), source["record_id"], source["target_uri"],
                                 source["date"] or NO_DATE, content_type, kept, block, digest(block), made))
            names = [key, *(c.split()[0] for c in RECORD.split(", "))]
            out = pd.DataFrame(rows, columns=names)
            out[key] = out[key].astype(frame[key].dtype)
            yield out

    columns = [key, *(c.split()[0] for c in RECORD.split(", "))]
    ship(responses.sparkSession)
    kind = responses.schema[key].dataType.simpleString()
    return responses.select(*columns).filter("kind = 'response'").mapInPandas(derived, f"{key} {kind}, {RECORD}")


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null or empty value; line breaks inside a value become blanks."""
    clean = F.regexp_replace(value, "[\\r\\n]+", " ")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")))


def as_text(records: DataFrame) -> DataFrame:
    """Each record whose block is UTF-8 text as one string: version, named fields, blank line, block."""
    fields = [
        ("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("WARC-Payload-Digest", F.col("payload_digest")), ("Content-Type", F.col("content_type")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    head = F.concat(F.lit(VERSION + "\r\n"), *(_line(name, value) for name, value in fields), F.lit("\r\n"))
    return records.select(F.concat(head, F.col("block").cast("string")).alias("value"))


def write_warc(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Metadata and conversion records as gzipped WARC files of at most ``per_file`` records, through Spark's committer."""
    as_text(records).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes) -> list[dict]:
    """The records of WARC bytes: their headers in lower case, ``version`` and ``block``; stops at the first that is cut off."""
    records, at = [], 0
    while at < len(data):
        split = data.find(b"\r\n\r\n", at)
        if split < 0:
            break
        version, *lines = data[at:split].decode("utf-8", "replace").split("\r\n")
        record = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        if not version.startswith("WARC/") or not record.get("content-length", "").isdigit():
            break
        end = split + 4 + int(record["content-length"])
        if end > len(data):
            break
        records.append(record | {"version": version, "block": data[split + 4 : end]})
        at = end
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
    return records


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of (gzipped) WARC files under ``path``; a task holds one file at a time."""
    import gzip

    names = [c.split()[0] for c in RECORD.split(", ")]

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows = [
                    (r.get("warc-type"), r.get("warc-record-id"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("warc-date"),
                     r.get("content-type"), {}, r["block"], r.get("warc-block-digest"), r.get("warc-payload-digest"))
                    for r in parse_warc(data)
                ]
                yield pd.DataFrame(rows, columns=names)

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parsed, RECORD)


def derivatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the ids that link its records, their digests and the text of its conversion record.

    The derived records are written as WARC files and read back; what is returned is what the files hold.
    """
    responses = responses_of_pages(load(spark, sf_dir, "pages"))
    path = scratch_path(spark, "warc")
    write_warc(derive(responses), path)
    found = read_warc(spark, path).filter("kind is not null")
    sides = found.groupBy("refers_to").agg(
        *(F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("metadata", "conversion") for c in ("record_id", "block_digest")),
        F.max("payload_digest").alias("payload_digest"),
        F.max(F.when(F.col("kind") == "conversion", F.col("block").cast("string"))).alias("text"),
        F.max(F.when(F.col("kind") == "metadata", F.col("block").cast("string"))).alias("metadata"),
    )
    return responses.select("page_id", F.col("record_id").alias("refers_to"), "target_uri").join(sides, "refers_to")
