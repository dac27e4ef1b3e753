import base64
import hashlib

from corrobora.llm import warc

PAGE = (
    "<html lang=fr><head><title>A &amp; B</title><script>var x='<p>';</script></head><body><!-- no --><nav><a href='/x?a=1&amp;b=2'>Link</a></nav>"
    "<p>One   two<br>three &eacute;</p><style>p{}</style><div>1 < 2 and <b>bold</b></div></body></html>"
)
ROWS = [(1, "http://e.org/a", PAGE), (2, None, None), (3, "http://e.org/b\r\nX: y", ""), (4, "u", "plain " * 20000), (None, "v", "<p>x"), (1, "http://e.org/a", PAGE)]
SCHEMA = "page_id long, url string, html string"


def test_text_and_facts():
    assert warc.plain_text(PAGE) == "Link\nOne two\nthree é\n1 < 2 and bold"
    assert warc.page_facts(PAGE) == [("title", "A & B"), ("language", "fr"), ("outlink", "/x?a=1&b=2")]
    assert warc.split_http(b"HTTP/1.0 404 No\r\nA: b\r\nA: c\r\n\r\nbody") == ("HTTP/1.0 404 No", [("A", "b"), ("A", "c")], b"body")
    assert warc.split_http(b"no header") == ("", [], b"no header")


def test_records_link_to_their_response(spark):
    responses = warc.responses_of_pages(spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("url", "url"))
    sources = {(r.page_id, r.record_id): r for r in responses.collect()}
    derived = warc.derive(responses).collect()
    assert len(derived) == 2 * len(ROWS)
    for r in derived:
        source = sources[r.page_id, r.refers_to]
        assert r.target_uri == source.target_uri and r.payload_digest == source.payload_digest
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
        assert r.headers["Content-Type"].startswith("text/html")
    assert len({(r.kind, r.record_id) for r in derived}) == 2 * 5
    first = next(r for r in derived if r.page_id == 1 and r.kind == "metadata")
    assert "outlink: /x?a=1&b=2\r\n" in bytes(first.block).decode() and f"refers-to: {first.refers_to}" in bytes(first.block).decode()


def test_files_round_trip(spark, tmp_path):
    records = warc.derive(warc.responses_of_pages(spark.createDataFrame(ROWS, SCHEMA)))
    path = f"file://{tmp_path}/out"
    warc.write_warc(records, path, per_file=3)
    back = warc.read_warc(spark, path).collect()
    key = lambda r: (r.kind, r.record_id, r.refers_to, bytes(r.block), r.block_digest, r.payload_digest, r.date, r.content_type)
    assert sorted(map(key, back)) == sorted(map(key, records.collect()))
    assert {r.target_uri for r in back} == {"http://e.org/a", None, "http://e.org/b X: y", "u", "v"}


def test_plain_responses_and_empty_tables(spark):
    rows = [(7, "response", "<id>", None, "t", None, None, None, None, None, None), (8, "request", "<no>", None, "t", None, None, None, b"x", None, None),
            (9, "response", "<raw>", None, "t", "2020-01-01T00:00:00Z", None, None, b"<p>\xff", None, "sha1:GIVEN")]
    frame = spark.createDataFrame(rows, "page_id int, " + warc.RECORD)
    got = {(r.page_id, r.kind): r for r in warc.derive(frame).collect()}
    assert got.keys() == {(k, kind) for k in (7, 9) for kind in ("metadata", "conversion")}
    assert bytes(got[7, "conversion"].block) == b"" and got[9, "conversion"].payload_digest == "sha1:GIVEN"
    assert bytes(got[9, "conversion"].block).decode() == "�" and got[7, "metadata"].date == warc.NO_DATE
    assert warc.derive(frame.limit(0)).collect() == []
    assert warc.responses_of_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    assert warc.parse_warc(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab") == []


def test_pages_without_closing_tags_keep_their_text(spark):
    pages = {
        "<html><head><title>A</title><body><p>Whole text</p></body></html>": "Whole text",
        "<html><head><meta charset=utf-8><title>A <p> B</title><script>x='<p>'</script><p>One<p>Two": "One\nTwo",
        "<head><title>A</title>Bare text": "Bare text",
        "<head><title>A<body><p>Text": "Text",
        "<head><link rel=x><main>Text</main></head><p>More": "Text\nMore",
        "<head><title>A</title>stray</head><body>Text": "Text",
        "<header>Top</header><p>Text": "Top\nText",
        "<p>One<noscript>two<p>three": "One two\nthree",
        "<p>One<template><p>two</template>three<template>four": "One three four",
        "<noscript>no</noscript><p>One<noscript>two": "One two",
        "<head><noscript><img src=x></noscript><style>p{}</style></head><p>Text": "Text",
        "<p>One<script>var x": "One",
    }
    assert {page: warc.plain_text(page) for page in pages} == pages
    rows = [(k, "u", page) for k, page in enumerate(pages)]
    derived = warc.derive(warc.responses_of_pages(spark.createDataFrame(rows, SCHEMA))).filter("kind = 'conversion'").collect()
    assert {r.page_id: bytes(r.block).decode() for r in derived} == dict(enumerate(pages.values()))
    many = "<head><title>" * 3000 + "<noscript><template>" * 20000 + "<p>x"
    assert warc.plain_text(many) == "x"
