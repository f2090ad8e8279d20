import base64
import gzip
import hashlib
import io
import random
import uuid
from html.parser import HTMLParser

import pytest

from quire.llm import _base, warc

SF = "/root/testdata/sf0.001"


def test_plain_text():
    page = "<html><head><title>T &amp; u</title><style>p{}</style><script>if (a<b) '</p>'</script></head><body><!-- x <p> --><p>One <b>two</b>\n three</p><div>4 &lt; 5<br/>six&nbsp;</div><ul><li>a<li>b</ul>1 < 2</body>"
    assert warc.plain_text(page) == "T & u\nOne two\nthree\n4 < 5\nsix\na\nb\n1 < 2"
    assert warc.plain_text(None) == warc.plain_text("") == warc.plain_text("<p></p><script>never closed") == ""


def test_round_trip_of_records():
    records = [warc.response(1, "http://a/\nb", "<p>é"), warc.response(2, None, None), ("warcinfo", [("X", "y")], b""), ("response", [("WARC-Record-ID", "<urn:x>"), ("WARC-Refers-To", "<urn:y>")], b"raw \r\n\r\n block")]
    raw = b"".join(warc.to_bytes(*r) for r in records)
    assert list(warc.parse(io.BytesIO(raw))) == [(k, [tuple(h) for h in hs], b) for k, hs, b in records]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(raw[:-9])))
    assert warc.derive(*records[2]) == []
    meta, text = warc.derive(*records[3])
    assert b"source-refers-to: <urn:y>" in meta[2] and ("WARC-Refers-To", "<urn:x>") in text[1]


def test_files_and_hostile_rows(spark):
    pages = [(1, "http://a.b/c", "<p>Hello</p>"), (2, None, "<p>x"), (3, "u", None), (None, "v", ""), (4, "w", "<p>" + "long " * 100_000), (4, "w", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as type", "2 as headers", "3 as block")
    found = warc.derivatives(warc.responses(df))
    files = warc.write(found, _base.new_folder(spark, "warc"))
    assert sum(r["records"] for r in files.collect()) == 2 * len(pages)
    back = warc.read(spark, [r["path"] for r in files.collect()])
    key = lambda r: (r["type"], str(r["headers"]), bytes(r["block"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, found.collect()))
    for r in back.collect():
        h = {x["name"]: x["value"] for x in r["headers"]}
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"]).digest()).decode()
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0
    one = gzip.compress(b"".join(warc.to_bytes(*warc.response(7, "z", "<b>q</b>")) for _ in range(2)))
    _base.put_file(path := f"{_base.new_folder(spark, 'warc')}/one.warc.gz", one)
    assert [bytes(r["block"]) for r in warc.derivatives(warc.read(spark, [path])).where("type = 'conversion'").collect()] == [b"q", b"q"]


class Lines(HTMLParser):
    """Another way to the visible lines of a page."""

    LINES = set("p div br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr section article header footer nav main aside blockquote pre form figure figcaption title head body html".split())
    HIDDEN = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.inside = [""], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.HIDDEN
        self.found += [""] * (tag in self.LINES)

    def handle_startendtag(self, tag, attrs):
        self.found += [""] * (tag in self.LINES)

    def handle_endtag(self, tag):
        self.inside -= tag in self.HIDDEN and self.inside > 0
        self.found += [""] * (tag in self.LINES)

    def handle_data(self, data):
        if not self.inside:
            first, *more = data.split("\n")
            self.found[-1] += first
            self.found += more

    @classmethod
    def of(cls, page):
        own = cls()
        own.feed(page)
        own.close()
        return "\n".join(x for x in (" ".join(line.split()) for line in own.found) if x)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_records(page_id, url, page):
    """What the query says of a page, by code of its own."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
    urn = lambda name: f"<urn:uuid:{uuid.uuid5(space, name)}>"
    payload, text = page.encode(), Lines.of(page).encode()
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + payload
    source = urn(f"response|{page_id}|{url}|{sha1(payload)}")
    conversion, metadata = urn(f"conversion|{source}"), urn(f"metadata|{source}")
    lines = [f"source-record-id: {source}", f"source-payload-digest: {sha1(payload)}", f"source-block-digest: {sha1(block)}", f"source-header: WARC-Record-ID: {source}", "source-header: WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"source-header: WARC-Target-URI: {url}", "source-header: Content-Type: application/http; msgtype=response", f"source-header: WARC-Payload-Digest: {sha1(payload)}", f"source-header: WARC-Block-Digest: {sha1(block)}"]
    lines += [f"http-status: {http[0]}", f"http-header: {http[1]}", f"http-header: {http[2]}", f"text-digest: {sha1(text)}", f"text-bytes: {len(text)}"]
    fields = "".join(f"{x}\r\n" for x in lines).encode()
    return [
        (page_id, "metadata", metadata, source, conversion, url, "application/warc-fields", sha1(fields), len(fields)),
        (page_id, "conversion", conversion, source, None, url, "text/plain; charset=utf-8", sha1(text), len(text)),
    ]


def test_query_equals_another_implementation(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = [x for p in pages for x in plain_records(p["page_id"], p["url"], p["html"])]
    assert sorted(map(tuple, warc.op5_warc_derivatives(spark, SF).collect()), key=str) == sorted(want, key=str)


def test_text_equals_a_parser_s():
    rng = random.Random(6)
    words = ["one", "two &amp; three", "a&nbsp;b", "x < y", "5 &gt; 4", "é", "line\nbreak", "q\t q"]
    values = ["v", "a>b", "a > 'b'", "</p>", "", "x=y"]

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(words)
        tag = rng.choice(["p", "div", "b", "i", "span", "a", "li", "h2", "td", "tr", "script", "style"])
        if tag in Lines.HIDDEN:
            return f"<{tag}>{rng.choice(['var a = 1', 'p > b {}', ''])}</{tag}>"
        own = "".join(f' {rng.choice("abc")}="{v}"' if rng.random() < 0.5 or "'" in v else f" {rng.choice('de')} = '{v}'" for v in rng.sample(values, rng.randint(0, 2)))
        return f"<{tag}{own}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + rng.choice(["<br>", "<br/>", "<!-- > note -->", ""]) + f"</{tag}>"

    for _ in range(2000):
        page = tree(4)
        assert warc.plain_text(page) == Lines.of(page), page
    assert warc.plain_text('<p title="a>b">c</p><i x=\'>\'>d</i>') == "c\nd"
    assert warc.plain_text("<a " + '="x"' * 50_000) == "<a " + '="x"' * 50_000  # no tag, and no time lost


def test_a_file_is_written_piece_by_piece(spark, monkeypatch):
    """Larger than what a task holds at a time; each record is a member of its own."""
    df = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(uuid(), 3000) as html").coalesce(1)
    files = warc.write(warc.responses(df), _base.new_folder(spark, "warc")).collect()
    assert [r["records"] for r in files] == [300]
    where, path = _base._place(files[0]["path"])
    with where.open_input_file(path) as f:
        assert f.read().count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == 300
    assert warc.read(spark, [files[0]["path"]]).count() == 300
