"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a conversion record with the plain text of its HTML and a metadata record with what the source said:
its id, digests, own refers-to, HTTP status and headers.  Both name the source in WARC-Refers-To; the metadata record
names the conversion in WARC-Concurrent-To.  Ids follow from the source's id, so a task that is run twice
writes the same records.  Digests are sha1 in base 32, as WARC files have them.

Records are rows with `type`, `headers` (array of name and value, in order) and `block`; files are
gzip members, one per record, as usual.  Null urls give no WARC-Target-URI, null and empty pages an empty text, null page_ids an
id of their own; repeated rows give equal records.  Responses whose block isn't HTTP count as
payload alone.  Records that aren't responses derive nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _base

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
DATE = "1970-01-01T00:00:00Z"
RECORD = "type string, headers array<struct<name:string,value:string>>, block binary"

#: The rest of a tag: a quoted value may hold the sign that ends it.
_REST = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>"""
_DROPPED = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b{_REST}.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:p|div|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|section|article|header|footer|nav|main|aside|blockquote|pre|form|figure|figcaption|title|head|body|html)\b{_REST}", re.I)
_TAG = re.compile(rf"</?[a-zA-Z]{_REST}|<[!?][^>]*>")
_SPACES = re.compile(r"[^\S\n]+")


def plain_text(page: str | None) -> str:
    """Lines of visible text."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("", page or "")))
    lines = [line.strip() for line in _SPACES.sub(" ", html.unescape(text)).split("\n")]
    return "\n".join([line for line in lines if line])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _named(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, parts)))}>"


def response(page_id, url: str | None, page: str | None, date: str = DATE) -> tuple:
    """(type, headers, block) of a page as a response record."""
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Record-ID", _named("response", page_id, url, digest(payload))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return "response", headers, block


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """Lines of the HTTP head, and the payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("latin-1").split("\r\n"), payload


def derive(kind: str, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and conversion records of a response."""
    if kind != "response":
        return []
    of = {name.lower(): value for name, value in headers}
    source = of.get("warc-record-id") or _named("unnamed", digest(block))
    head, payload = split_http(block)
    found = re.search(r"(?im)^content-type:.*?charset=[\"']?([\w-]+)", "\n".join(head))
    charset = found[1] if found else "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    shared = [(name, of[name.lower()]) for name in ("WARC-Date", "WARC-Target-URI") if name.lower() in of]
    conversion, metadata = _named("conversion", source), _named("metadata", source)
    fields = [("source-record-id", source), ("source-payload-digest", of.get("warc-payload-digest") or digest(payload)), ("source-block-digest", of.get("warc-block-digest") or digest(block))]
    if "warc-refers-to" in of:
        fields.append(("source-refers-to", of["warc-refers-to"]))
    fields += [("source-header", f"{name}: {value}") for name, value in headers]
    fields += [("http-status" if i == 0 else "http-header", line) for i, line in enumerate(head)]
    fields += [("text-digest", digest(text)), ("text-bytes", str(len(text)))]
    body = "".join([f"{name}: {_one_line(value)}\r\n" for name, value in fields]).encode()
    return [
        ("metadata", [("WARC-Record-ID", metadata), *shared, ("WARC-Refers-To", source), ("WARC-Concurrent-To", conversion), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(body))], body),
        ("conversion", [("WARC-Record-ID", conversion), *shared, ("WARC-Refers-To", source), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))], text),
    ]


def to_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{n}: {v}" for n, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple]:
    """(type, headers, block) of each record of an open, uncompressed file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        kind, length, headers = "", 0, []
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and headers:  # a folded header
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() == "warc-type":
                kind = value
            elif name.lower() == "content-length":
                length = int(value)
            else:
                headers.append((name, value))
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record is cut short")
        yield kind, headers, block


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and the response record of each page.  pages: page_id, url, html."""

    def run(batches) -> Iterator:
        for batch in batches:
            rows = [(i, *response(i, u, h, date)) for i, u, h in zip(batch["page_id"], batch["url"], batch["html"], strict=True)]
            yield _frame(rows)

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, f"page_id string, {RECORD}")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(i, kind, [{"name": n, "value": v} for n, v in headers], block) for i, kind, headers, block in rows], columns=["page_id", "type", "headers", "block"])


def derivatives(records: DataFrame) -> DataFrame:
    """page_id and the derived records of each response.  records: page_id (any text), type, headers, block."""

    def run(batches) -> Iterator:
        for batch in batches:
            yield _frame([(i, *new) for i, kind, headers, block in zip(batch["page_id"], batch["type"], batch["headers"], batch["block"], strict=True) for new in derive(kind, [(h["name"], h["value"]) for h in headers], block)])

    return records.select("page_id", "type", "headers", "block").mapInPandas(run, f"page_id string, {RECORD}")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes records to one .warc.gz file per task, gzip member by member; (path, records) of each."""

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        path, out, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        for batch in batches:
            for kind, headers, block in zip(batch["type"], batch["headers"], batch["block"], strict=True):
                out = out or _base.NewFile(path)
                out.put(gzip.compress(to_bytes(kind, [(h["name"], h["value"]) for h in headers], block), 6, mtime=0))
                n += 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return _base.cut(records.select("type", "headers", "block").mapInPandas(run, "path string, records long"))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """page_id (file and number of the record), type, headers, block of all records; plain or gzip files."""

    def run(batches) -> Iterator:
        for batch in batches:
            for path in batch["path"]:
                where, place = _base._place(path)
                with where.open_input_file(place) as raw:
                    zipped = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    held = []
                    for n, record in enumerate(parse(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if zipped else raw)):
                        held.append((f"{path}#{n}", *record))
                        if len(held) >= 500:
                            yield _frame(held)
                            held = []
                    yield _frame(held)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, f"page_id string, {RECORD}")


def op5_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = _base.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = derivatives(responses(pages))
    value = lambda name: F.element_at(F.filter("headers", lambda h: h["name"] == name), 1)["value"]
    optional = lambda name: F.try_element_at(F.filter("headers", lambda h: h["name"] == name), F.lit(1))["value"]
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("type").alias("warc_type"),
        value("WARC-Record-ID").alias("record_id"),
        value("WARC-Refers-To").alias("refers_to"),
        optional("WARC-Concurrent-To").alias("concurrent_to"),
        optional("WARC-Target-URI").alias("target_uri"),
        value("Content-Type").alias("content_type"),
        value("WARC-Block-Digest").alias("block_digest"),
        F.octet_length("block").cast("long").alias("block_bytes"),
    )
