import gzip
import hashlib
import time
from html.entities import html5

import pytest

from tickloom.llm import warc

SCHEMA = "page_id long, url string, html string, block string, date string, record_type int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>a</p><p>b &amp;lt; c</p>", "a\nb &lt; c"),
        ("<!-- <p>no</p> --><script>var t='<b>no</b>'</script >x<STYLE>p{}</STYLE>y", "x y"),
        ("<div>one<br>two</div>\n\n <span>th</span>ree&nbsp;four &lt;5&gt; &quot;q&#39;", "one\ntwo\nthree four <5> \"q'"),
        ("no tags\t at   all", "no tags at all"),
        ("<p>broken <a href='x'>link", "broken link"),
        ("a < b and 3 <4, <5", "a < b and 3 <4, <5"),
        ("seen<!-- to the end <p>", "seen"),
        ("seen<script>to </p> the end", "seen"),
        ("seen<p class='to the end", "seen"),
        ("seen<a href='to the end", "seen"),
    ],
)
def test_page_text(spark, html, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(warc.page_parts(F.lit(html))["text"].alias("t")).first().t == text


def test_parts_that_never_close_reach_to_the_end():
    page = warc.read_page("<html data-lang=x xml:lang='y' lang=en-GB><title>a &amp; b<p>c")
    assert page["title"] == "a & b<p>c" and page["language"] == "en-GB"
    links = warc.read_page("<a title='>' href='a>b'>1</a><a href=\"c d e>f</a><a href=g>")["outlinks"]
    assert links == ["a>b", "c d e>f</a><a href=g>"]
    assert warc.read_page("<a title=\"href='no'\" href=yes><a href><a href= ><a nohref=x>")["outlinks"] == ["yes", ""]


OPENINGS = ["<a ", "<!--", "<title ", "<title>", "<html ", "<script>", '<a href="', "<p ", '<a "', "&#", "&x", "<a href='x' ", "<", "</", "\n ", '="']


@pytest.mark.parametrize("opening", OPENINGS)
def test_openings_that_never_close_take_time_in_proportion(opening):
    def took(n):
        start = time.perf_counter()
        warc.read_page(opening * n)
        return time.perf_counter() - start

    took(1_000)
    assert took(400_000 // len(opening)) < 8 * max(took(100_000 // len(opening)), 0.02)


def test_records_refer_to_their_response(spark):
    html = '<html lang="de"><title> A\n B </title><a href="x">y</a>'
    rows = [(1, "http://a/", html), (2, None, None), (None, "u", ""), (3, "http://a/", html), (3, "http://a/", html)]
    sources = warc.responses(pages(spark, rows), "2024-01-01T00:00:00Z")
    ids = {r.page_id: r for r in sources.collect()}
    out = warc.derive(sources, ["page_id", "payload"]).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        source = ids[r.page_id]
        assert r.refers_to == source.record_id != r.record_id and r.target_uri == source.target_uri and r.date == source.date
        assert r.source_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode()) and r.source_content_type == "text/html; charset=utf-8"
    facts = next(r.block for r in out if r.page_id == 1 and r.record_type == "metadata")
    assert "title: A B\r\n" in facts and "language: de\r\n" in facts and "links: 1\r\n" in facts
    assert len({r.record_id for r in out}) == 2 * 4  # the two equal rows give equal records


def test_missing_headers_and_ids(spark):
    rows = [(None, None, None, None, None, None, 7), ("<urn:x>", "u", "d", "HTTP/1.1 200 OK\r\nContent-type:  text/plain\r\nX: y", "p", "sha1:ABC", 8)]
    schema = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, k long"
    out = warc.derive(spark.createDataFrame(rows, schema), ["k"]).collect()
    kept = [r for r in out if r.k == 8]
    assert {r.refers_to for r in kept} == {"<urn:x>"} and {r.source_digest for r in kept} == {"sha1:ABC"} and {r.source_content_type for r in kept} == {"text/plain"}
    assert all("WARC-Target-URI" not in r.headers and r.refers_to for r in out if r.k == 7)
    assert warc.derive(spark.createDataFrame([], schema), ["k"]).count() == 0


def test_files_parse_as_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>é") for i in range(5)]
    records = warc.derive(warc.responses(pages(spark, rows), "2024-01-01T00:00:00Z"), ["page_id"])
    warc.write_warc(records, str(tmp_path / "w"))
    found = []
    for file in (tmp_path / "w").glob("part-*"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], rest[:n].decode()))
            data = rest[n + 4 :]
    assert sorted(found) == sorted((r.record_id, r.block) for r in records.collect())


NAMES = sorted(n for n in html5 if n.endswith(";") and html5[n].isprintable() and not html5[n].isspace())


def test_all_references_are_decoded_once_in_text_and_title(spark):
    """The decoder here is the table of names and what is written out below."""
    odd = "&#169; &#xA9; &#XA9; &copy &#39; &#8364; &#128; &amp;copy; &amp;#169; &amp;amp; &noname; & &; AT&T R&amp;D"
    plain = "© © © © ' € € &copy; &#169; &amp; &noname; & &; AT&T R&D"
    bodies = [(" ".join(f"x&{n}y" for n in NAMES), " ".join(f"x{html5[n]}y" for n in NAMES)), (odd, plain)]
    assert len(NAMES) > 2000
    rows = [(i, "u", f"<title>{b}</title><p>{b}</p>") for i, (b, _) in enumerate(bodies)]
    got = {(r.page_id, r.record_type): r.block for r in warc.derive(warc.responses(pages(spark, rows), "d"), ["page_id"]).collect()}
    for i, (_, want) in enumerate(bodies):
        assert got[i, "conversion"] == f"{want}\n{want}"
        assert f"\r\ntitle: {want}\r\n" in got[i, "metadata"]
    spaced = [(9, "u", "<title>a&#13;&#10;links: 7&nbsp;b</title>c&#160;d&nbsp;e")]
    got = {r.record_type: r.block for r in warc.derive(warc.responses(pages(spark, spaced), "d"), ["page_id"]).collect()}
    assert "\r\ntitle: a links: 7 b\r\n" in got["metadata"] and got["conversion"].endswith("c d e")


def fields_of(block, name):
    assert block.endswith("\r\n")
    return [v for n, _, v in (x.partition(": ") for x in block.split("\r\n")[:-1]) if n == name]


def test_all_headers_and_links_are_read_back(spark):
    given = ["HTTP/1.1 203 Other", "Content-Type: text/html", "Content-Length: 9", "Last-Modified: Mon", "X: y", "X: z:  a ", " folded", "Empty:"]
    html = (
        '<a href="/a?b=1&amp;c=2&copy=3&copy;">1</a><A class=x HREF=\'d e\' data-href="no">2</A><a\nhref = f>3</a><link href="no"><a name="no">'
        '<a data-href="no" href="">4</a><a href="g&#13;&#10;links: 9\n h">5</a><a href=/a>6</a>'
    )
    rows = [(1, "\r\n".join(given) + "\r\n\r\n", html), (2, None, None), (3, "HTTP/1.0 200\nA: b\n", "<p>")]
    full = [(f"<urn:{k}>", "u", "d", h, p, None, k) for k, h, p in rows]
    schema = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, k long"
    out = warc.derive(spark.createDataFrame(full, schema), ["k"]).collect()
    got = {r.k: r.block for r in out if r.record_type == "metadata"}
    assert fields_of(got[1], "source-http-line") == given
    links = ["/a?b=1&c=2&copy=3\u00a9", "d e", "f", "", "glinks: 9 h", "/a"]
    assert fields_of(got[1], "outlink") == links and fields_of(got[1], "links") == [str(len(links))]
    assert fields_of(got[2], "source-http-line") == fields_of(got[2], "outlink") == [] and fields_of(got[2], "links") == ["0"]
    assert fields_of(got[3], "source-http-line") == ["HTTP/1.0 200", "A: b"] and fields_of(got[3], "outlink") == []
