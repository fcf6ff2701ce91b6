import base64
import gzip
import hashlib
import json
import time
import uuid
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import warc
from tests.llm.helpers import write_table

PAGE = ("<!DOCTYPE html><html><head><meta charset='utf-8'><meta name=description content=\"a &amp; b\"><title> A <b>page</b>\n here</title><style>p{}</style></head><body>"
        "<script>var t='</p>';</script><!-- no --><h1>Head</h1><p>One &lt;two&gt;<br>three <a href='/x?a=1&amp;b=2'>link <i>text</i></a></p><ul><li>é\n item</li></ul>1 < 2</body></html>")


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_metadata():
    assert warc.plain_text(PAGE) == "Head\nOne <two>\nthree link text\né item\n1 < 2"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Served-By: me\r\n\r\n" + PAGE.encode()
    source = [("WARC-Type", "response"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:KEPT"), ("X-Crawl", "7")]
    meta, text = warc.derivatives("<urn:uuid:1>", source, body)
    for r, other in ((meta, text), (text, meta)):
        by = dict(r[2])
        assert by["WARC-Refers-To"] == "<urn:uuid:1>" and by["WARC-Concurrent-To"] == other[0] and by["WARC-Record-ID"] == r[0]
        assert (by["WARC-Target-URI"], by["WARC-Date"], by["X-Crawl"], by["X-Source-Payload-Digest"]) == ("http://a/", "2020-01-01T00:00:00Z", "7", "sha1:KEPT")
        assert by["WARC-Block-Digest"] == sha1(r[3]) and by["Content-Length"] == str(len(r[3]))
    envelope = json.loads(meta[3])
    assert envelope["WARC-Header-Metadata"] == [list(x) for x in source] and ["X-Served-By", "me"] in envelope["HTTP-Response-Metadata"]["Headers"]
    assert envelope["HTTP-Response-Metadata"]["Entity-Digest"] == sha1(PAGE.encode())
    assert envelope["HTML-Metadata"] == {"Title": "A page here", "Metas": [{"charset": "utf-8"}, {"name": "description", "content": "a & b"}],
                                         "Links": [{"url": "/x?a=1&b=2", "text": "link text"}]}


def test_transfer_and_charset():
    packed = gzip.compress("<p>é</p>".encode("latin-1"))
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(packed[a:a + 7]), packed[a:a + 7]) for a in range(0, len(packed), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    assert warc.derivatives("i", [], block)[1][3] == "é".encode()
    for odd in (b"", b"plain <b>text</b>", b"HTTP/1.1 200 OK", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\nx", b"\xff\xfe<p"):
        assert len(warc.derivatives("i", [], odd)) == 2


def test_round_trip_through_files(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://h/{i}", PAGE.replace("Head", f"Head {i}")) for i in range(20)] + [(None, None, None), (3, "http://h/3", PAGE), (3, "http://h/3", PAGE)]
    made = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"), "2024-01-01T00:00:00Z")).persist()
    assert warc.write(made, str(tmp_path / "w x")) >= 1
    back = warc.read(spark, str(tmp_path / "w x"))
    key = lambda r: (r.record_id, r.type, r.headers, bytes(r.block))
    assert sorted(map(key, back.collect())) == sorted(map(key, made.collect())) and back.count() == 2 * len(pages)
    assert not [p.name for p in (tmp_path / "w x").iterdir() if not p.name.endswith((".gz", ".crc"))]


def test_what_a_failed_attempt_leaves_is_not_read(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", PAGE.replace("Head", f"Head {i}")) for i in range(6)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")).persist()

    member, folder = warc._member, tmp_path / "w"

    def torn(lines, block):
        if b"Head 4" in block:
            raise RuntimeError("executor lost")
        return member(lines, block)

    with monkeypatch.context() as m, pytest.raises(Exception, match="executor lost"):
        m.setattr(warc, "_member", torn)
        warc.write(made.coalesce(1), str(folder))
    assert [p for p in folder.iterdir() if ".warc.gz." in p.name]
    warc.write(made, str(folder))
    whole = next(p for p in folder.iterdir() if p.name.endswith(".gz")).read_bytes()
    (folder / "part-000000-0000.warc.gz.0123").write_bytes(whole[:-100])
    key = lambda r: (r.record_id, r.headers, bytes(r.block))
    assert sorted(map(key, warc.read(spark, str(folder)).collect())) == sorted(map(key, made.collect()))


def test_plain_file_and_several_records():
    lines = warc.lines_of([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("X-Odd", "a: b\nc"), ("Content-Length", "9")])
    assert warc.fields_of(lines)[2] == ("X-Odd", "a: b c")
    packed = warc._member(lines, b"\r\n\r\nab\r\n\n")
    empty = warc._member(warc.lines_of([("WARC-Type", "metadata"), ("WARC-Record-ID", "<b>"), ("Content-Length", "0")]), b"")
    want = [("<a>", lines, b"\r\n\r\nab\r\n\n"), ("<b>", None, b"")] * 3
    for data in ((packed + empty) * 3, gzip.decompress(packed + empty) * 3):
        assert [(r[0], r[2] if r[0] == "<a>" else None, r[3]) for r in warc.parsed(data)] == want


def test_other_types_pass_and_empty_tables(spark, tmp_path):
    rows = [("<1>", "request", "", b"x"), ("<2>", "response", None, None)]
    out = warc.derive(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert [r.type for r in out] == ["metadata", "conversion"]
    d = write_table(spark, tmp_path, "pages", spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.op9_warc_derivatives(spark, d).count() == 0


def test_query(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", PAGE) for i in range(5)], "page_id long, url string, html string").withColumn("type", F.lit("mine"))
    got = warc.op9_warc_derivatives(spark, write_table(spark, tmp_path, "pages", pages)).collect()
    assert sorted((r.page_id, r.warc_type) for r in got) == sorted((i, t) for i in range(5) for t in ("metadata", "conversion"))
    assert all(r.source_digest == sha1(PAGE.encode()) for r in got)


class Reader(HTMLParser):
    """Brute force: what a page says, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.metas, self.links, self.hidden, self.link, self.in_title = [""], None, [], [], None, None, False
        self.feed(page.replace("\n", " "))
        self.close()
        self.text = "\n".join(x for x in (" ".join(x.split()) for x in self.lines) if x)

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            self.metas.append(dict(attrs))
        self.in_title |= tag == "title"
        if tag in ("script", "style", "head") and not self.hidden:
            self.hidden = tag
        if tag == "a" and "href" in dict(attrs):
            self.link = [dict(attrs)["href"], ""]
        self.handle_line(tag)

    def handle_line(self, tag):
        if tag in warc._LINES and not self.hidden:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        self.in_title &= tag != "title"
        if tag == "a" and self.link:
            self.links.append({"url": self.link[0], "text": " ".join(self.link[1].split())})
            self.link = None
        self.handle_line(tag)

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.hidden:
            self.lines[-1] += data
            if self.link:
                self.link[1] += data


def test_query_equals_brute_force(spark, tmp_path):
    pages = [(i, f"http://h{i % 3}/{i}?q=ü", f"<html><head><title>T{i} &amp; é</title><meta name='n{i}' content='x y'><style>b{{}}</style></head><body><div>" + "".join(
        f"<p id=p{k}>line {k} of {i} &lt;{k * i}&gt; <b>bold</b><br>next</p><a href='/to/{k}?a=1&amp;b={i}'>go <i>{k}</i></a>" for k in range(i % 7)) + "</div></body></html>") for i in range(60)]
    pages += [(7, pages[7][1], pages[7][2]), (None, None, None), (61, "", "")]
    d = write_table(spark, tmp_path, "pages", spark.createDataFrame(pages, "page_id long, url string, html string"))
    want = []
    for i, url, page in pages:
        url, page = url or "", page or ""
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i}|{url}#response')}>"
        own = {k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{k}')}>" for k in ("metadata", "conversion")}
        read = Reader(page)
        html = {"Title": read.title, "Metas": read.metas, "Links": read.links}
        for kind, other, says in (("metadata", "conversion", html), ("conversion", "metadata", read.text)):
            want.append((i, kind, own[kind], source, own[other], url or None, sha1(page.encode()), says))
    got = []
    for r in warc.op9_warc_derivatives(spark, d).collect():
        assert r.block_digest == sha1(r.content.encode()) and r.date == "2024-01-01T00:00:00Z"
        says = json.loads(r.content)["HTML-Metadata"] if r.warc_type == "metadata" else r.content
        got.append((r.page_id, r.warc_type, r.record_id, r.refers_to, r.concurrent_to, r.target_uri, r.source_digest, says))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("piece", ["<title>", "<title", "<meta ", "<a ", "<a href=x>", "<p ", "<p", "</a", "<!-", "<script", "</title ", "a"])
def test_openings_without_an_end_take_one_scan(piece):
    page = "<p>x" + piece * (1_000_000 // len(piece))
    for text in (page, "<meta " + page[4:] + ">"):
        t = time.process_time()
        assert len(warc.derivatives("i", [], text.encode())) == 2
        assert time.process_time() - t < 5


def test_files_that_are_cut_off_or_changed(spark, tmp_path):
    def record(block, stated=None):
        return warc.lines_of([("WARC-Type", "metadata"), ("WARC-Record-ID", "<a>"), ("WARC-Block-Digest", stated or warc.digest(block)), ("Content-Length", str(len(block)))])
    block = bytes(range(256)) * 20
    packed = warc._member(record(block), block)
    assert [r[3] for r in warc.parsed(packed * 3)] == [block] * 3
    plain = gzip.decompress(packed)
    for torn in (packed + packed[:-10], packed + packed[:40], plain[:3000], plain + plain[:60], warc._member(record(block, warc.digest(b"")), block)):
        with pytest.raises(ValueError, match="cut off|digest"):
            list(warc.parsed(torn))
    (tmp_path / "t.warc.gz").write_bytes(packed[:-10])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path)).collect()
    many = gzip.compress(plain * 200)  # one member for all records
    assert sum(r[3] == block for r in warc.parsed(many)) == 200 and list(warc.parsed(b"")) == []
