"""Where page texts come from.  Recognition, layout and rendering are models of their own: they plug in as extractors.

An extractor works in a process of its own (quire.sources.reader); tasks get paths and page numbers, never contents, and a file is opened where it is read.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.reader import EmptyResult, ExtractionError, PageTimeout, Reader, Slot, packed, reader

__all__ = ["EmptyResult", "ExtractionError", "PageTimeout"]

logger = logging.getLogger(__name__)

PAGES_RAW = "doc_id string, page_id string, ord int, source string, method string, raw_text string, t_ocr double, error string, no_layout boolean"
COLUMNS = [c.split()[0] for c in PAGES_RAW.split(", ")]
ATTEMPTS = 2
#: Pages of a file that a task reads in a row.
CHUNK_PAGES = 32


class Extractor(Protocol):
    """content is None if the extractor has `opens_files`; methods that PDFs can be read by are named in `methods`."""

    method: str
    methods: tuple[str, ...]

    def pages(self, path: str, content: bytes | None) -> int:
        """Number of pages of a file."""

    def text(self, path: str, content: bytes | None, page: int, layout: bool) -> str:
        """The raw text of a page, counted from 1."""

    def native(self, path: str, content: bytes | None, page: int) -> str:
        """The text that a PDF itself holds, where it does; only asked for PDFs."""

    def docling(self, path: str, content: bytes | None, page: int) -> str:
        """The page's Markdown by a converter, if there is one."""

    def figures(self, path: str, content: bytes | None, page: int) -> list[tuple[str, bytes | None]]:
        """Name and content of a native page's figures; no content where one couldn't be cut out."""

    def raster(self, path: str, content: bytes | None, page: int, dpi: int) -> bytes:
        """The page as an image."""


class PlainText:
    """Files of text with form feeds between pages."""

    method, methods = "plain", ("text",)
    last: tuple[str, list[str]] = ("", [])

    def pages(self, path: str, content: bytes | None) -> int:
        return len(self._split(path, content))

    def text(self, path: str, content: bytes | None, page: int, layout: bool) -> str:
        return self.native(path, content, page)

    def native(self, path: str, content: bytes | None, page: int) -> str:
        return self._split(path, content)[page - 1]

    def figures(self, path: str, content: bytes | None, page: int) -> list[tuple[str, bytes | None]]:
        return []

    def raster(self, path: str, content: bytes | None, page: int, dpi: int) -> bytes:
        return f"{dpi}:{self.native(path, content, page)}".encode()

    def _split(self, path: str, content: bytes | None) -> list[str]:
        if self.last[0] != path:
            self.last = (path, (content or b"").decode("utf-8", "replace").split("\f"))
        return self.last[1]


class FakeExtractor(PlainText):
    """Words in the text make it fail on purpose, or have figures."""

    method, methods = "fake", ("text", "docling")

    def pages(self, path: str, content: bytes | None) -> int:
        if b"UNOPENABLE" in (content or b""):
            raise ExtractionError("not a file of pages")
        return super().pages(path, content)

    def text(self, path: str, content: bytes | None, page: int, layout: bool) -> str:
        text = self.native(path, content, page)
        if "TIMEOUT" in text and layout:
            raise PageTimeout("page timeout")
        if "HANG" in text and layout:
            time.sleep(3600)
        return text

    def native(self, path: str, content: bytes | None, page: int) -> str:
        text = super().native(path, content, page)
        if "BROKEN" in text:
            raise ExtractionError("broken page")
        if "CRASH" in text:
            import os

            os._exit(3)
        return text

    def docling(self, path: str, content: bytes | None, page: int) -> str:
        return f"## converted\n\n{self.native(path, content, page)}"

    def figures(self, path: str, content: bytes | None, page: int) -> list[tuple[str, bytes | None]]:
        text = self.native(path, content, page)
        if "UNCUT" in text:
            return [("figure_0.png", None)]
        return [("figure_0.png", f"png of page {page}".encode())] if "FIGURE" in text else []


def read_page(own: Reader, path: str, page: int, layout: bool = True, timeout: float = 0) -> tuple[str | None, str | None, bool]:
    """(text, error, no_layout): empty results are tried again, a timeout without layout; nothing is raised."""
    for attempt in range(ATTEMPTS):
        try:
            text = own.ask("text", path, page, layout, timeout=timeout).strip()
            if not text:
                raise EmptyResult("empty result")
            return text, None, not layout
        except PageTimeout as e:
            if not layout:
                return None, str(e), True
            return read_page(own, path, page, layout=False, timeout=timeout)
        except EmptyResult as e:
            if attempt + 1 == ATTEMPTS:
                return None, str(e), not layout
        except ExtractionError as e:
            return None, str(e), not layout
    return None, "no attempt", not layout


def read_native(own: Reader, path: str, page: int, how: str = "native", layout: bool = True, timeout: float = 0) -> tuple[str | None, list, str | None]:
    """(text with a tag for each figure, figures as {name, content}, error); a page without its figures is better than none."""
    try:
        text = own.ask(how, path, page, timeout=timeout)
    except ExtractionError as e:
        return None, [], str(e)
    try:
        found = own.ask("figures", path, page, timeout=timeout) if layout else []
    except ExtractionError as e:
        logger.warning("%s, page %d: no figures: %s", path, page, e)
        found = []
    tags = "\n".join(f'<img src="imgs/figure_{i}.png" />' for i in range(len(found)))
    files = [{"name": f"figure_{i}.png", "content": content} for i, (_, content) in enumerate(found) if content is not None]
    return (f"{text}\n\n{tags}" if tags else text), files, None


def bounded(master: str, cores: int, parallel: int):
    """A profile by which an executor runs as many extracting tasks at once as extractors are allowed; None where that can't be or needn't be said."""
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    if not parallel or parallel >= cores or master.startswith("local["):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(-(-cores // parallel))).build


def _profile(spark: SparkSession, parallel: int):
    return bounded(spark.sparkContext.master, int(spark.conf.get("spark.executor.cores", "0")), parallel)


def file_pages(files: DataFrame, make: Callable[[], Extractor], timeout: float = 0, parallel: int = 0) -> DataFrame:
    """files (doc_id, path, stem, kind, ord) with n_pages, and error where a file can't be opened."""
    own_make = packed(make)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader(own_make)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with Slot(parallel):
                        rows.append((path, own.ask("pages", path, timeout=timeout), None))
                except ExtractionError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "n_pages", "error"]).astype({"n_pages": "Int32"})

    plain = files.select("doc_id", "path", "stem", "kind", "ord")
    opened = plain.where("kind <> 'image'").select("path").distinct().mapInPandas(count, "path string, n_pages int, error string", profile=_profile(files.sparkSession, parallel))
    return plain.join(opened, "path", "left").select("doc_id", "path", "stem", "kind", "ord", F.when(F.col("kind") == "image", 1).otherwise(F.col("n_pages")).alias("n_pages"), "error")


def page_list(listed: DataFrame) -> DataFrame:
    """doc_id, path, page, page_id, ord, file_ord of the pages of files that file_pages() has opened."""
    image = F.col("kind") == "image"
    named = listed.where("n_pages > 0").withColumn("page", F.explode(F.sequence(F.lit(1), "n_pages")))
    named = named.withColumn("page_id", F.when(image, F.col("stem")).otherwise(F.format_string("%s_p%03d", "stem", "page")))
    return named.select("doc_id", "path", "page", "page_id", F.when(image, F.col("ord")).otherwise(F.col("page")).cast("int").alias("ord"), F.col("ord").alias("file_ord"))


def extract_pages(pages: DataFrame, make: Callable[[], Extractor], done: DataFrame | None = None, layout: bool = True, timeout: float = 0, parallel: int = 0, how: str = "", profile=None) -> DataFrame:
    """pages_raw, and figures (name, content) of native pages.  pages: doc_id, path, page, page_id, ord.

    done (doc_id, page_id): pages that are left out before any is read.  timeout: seconds for a page; 0 for any number.  parallel: extractors that work at once
    on an executor; 0 for one in each task.  how: native or docling for what a PDF holds; recognition else.
    """
    if done is not None:
        pages = pages.join(done.select("doc_id", "page_id").distinct(), ["doc_id", "page_id"], "left_anti")
    chunk = F.expr(f"(page - 1) div {CHUNK_PAGES}").alias("chunk")
    # a chunk's pages, CHUNK_PAGES at most, are read from a file that is opened once
    dealt = pages.groupBy("doc_id", "path", chunk).agg(F.array_sort(F.collect_list(F.struct("page", "page_id", "ord"))).alias("pages"))
    own_make = packed(make)

    def read(batches) -> Iterator:
        import pyarrow as pa

        figure = pa.struct([("name", pa.string()), ("content", pa.binary())])
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PAGES_RAW.split(", ")] + [("figures", pa.list_(figure))])
        own = reader(own_make)
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with Slot(parallel):
                    own.warm()
                    for p in r["pages"]:
                        began, figures = time.perf_counter(), []
                        if how:
                            text, figures, error = read_native(own, r["path"], p["page"], how, layout, timeout)
                            no_layout, method = False, "text" if how == "native" else how
                        else:
                            text, error, no_layout = read_page(own, r["path"], p["page"], layout, timeout)
                            method = own.method
                        rows.append(dict(zip(COLUMNS, (r["doc_id"], p["page_id"], p["ord"], r["path"], method, text, time.perf_counter() - began, error, no_layout), strict=True)) | {"figures": figures})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    plan = dealt.select("doc_id", "path", "pages")
    return plan.mapInArrow(read, f"{PAGES_RAW}, figures array<struct<name:string,content:binary>>", profile=profile or _profile(plan.sparkSession, parallel))


#: Pages sampled of a PDF, and mean words that make it a text PDF.
SAMPLED, LEAST_WORDS = 5, 20


def sample_pages(count: Column) -> Column:
    """Places from 0 of the pages to look at, evenly spread."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(SAMPLED - 1)), lambda i: F.floor(i * (count - 1) / (SAMPLED - 1)).cast("int"))
    every = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(count <= SAMPLED, every).otherwise(spread)


def classify(pages: DataFrame, *by: str) -> DataFrame:
    """by, avg_words and class (text or image) from pages (by, at, n_pages, text); at counts from 0."""
    looked = pages.where(F.array_contains(sample_pages(F.col("n_pages")), F.col("at").cast("int")))
    words = F.size(F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    found = looked.groupBy(*by).agg(F.avg(words).alias("avg_words"))
    return found.withColumn("class", F.when(F.col("avg_words") >= LEAST_WORDS, "text").otherwise("image"))


def pdf_classes(listed: DataFrame, make: Callable[[], Extractor], timeout: float = 0, parallel: int = 0) -> DataFrame:
    """doc_id, path, class (text or image) of PDFs that file_pages() has listed, by the words that a sample of their pages holds; those without a page are images."""
    pdfs = listed.where("kind = 'pdf'").select("doc_id", "path", "n_pages")
    looked = pdfs.where("n_pages > 0").select("doc_id", "path", "n_pages", F.explode(sample_pages(F.col("n_pages"))).alias("at"))
    own_make = packed(make)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader(own_make)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for at in r.ats:
                    try:
                        with Slot(parallel):
                            rows.append((r.doc_id, r.path, int(at), int(r.n_pages), own.ask("native", r.path, int(at) + 1, timeout=timeout)))
                    except ExtractionError:  # a page that can't be read has no words
                        rows.append((r.doc_id, r.path, int(at), int(r.n_pages), ""))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "at", "n_pages", "text"])

    dealt = looked.groupBy("doc_id", "path", "n_pages").agg(F.collect_list("at").alias("ats"))
    read = dealt.mapInPandas(look, "doc_id string, path string, at int, n_pages int, text string", profile=_profile(listed.sparkSession, parallel))
    found = classify(read, "doc_id", "path")
    return pdfs.select("doc_id", "path").distinct().join(found, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("class", F.lit("image")).alias("class"))


def resolve_method(asked: Column, pdf_class: Column, force_ocr: Column | bool = False, has_docling: bool = False) -> Column:
    """How a PDF is read: images and forced ones by recognition, else as asked; without its library `docling` is plain text."""
    force = F.lit(force_ocr) if isinstance(force_ocr, bool) else force_ocr
    native = F.when(asked == "docling", F.lit("docling" if has_docling else "text")).otherwise(asked)
    return F.when(force | (asked == "paddleocrvl") | (pdf_class == "image"), "paddleocrvl").otherwise(native)
