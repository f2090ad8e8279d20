"""Whole runs: from files or page texts to books, statistics and a report."""

from __future__ import annotations

import logging
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import markup
from quire.operators import figures, pages, stats
from quire.operators.keep import kept
from quire.sources import epub, extract, files, filesink

logger = logging.getLogger(__name__)


def page_metrics(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per source page that was worked on; clean-up runs inside Spark's own stages and has no time of its own."""
    own = parts.select("doc_id", "page_id", "ord", "chars", "status")
    joined = raw.select("doc_id", "page_id", "ord", "t_ocr", "no_layout").join(own, ["doc_id", "page_id", "ord"])
    return joined.select("doc_id", F.col("page_id").alias("name"), "ord", F.lit(0.0).alias("t_pre"), "t_ocr", F.lit(0.0).alias("t_post"), F.col("t_ocr").alias("total"), "chars", F.lit(False).alias("looped"), "no_layout", (F.col("status") == "error").alias("error"))


@dataclass
class Run:
    """What a run has read: pages (doc_id, path, page, page_id, ord, file_ord), their metrics, and counts that were observed on the way."""

    pages: DataFrame
    metrics: DataFrame
    total: int
    skipped: int
    done: int
    errors: int
    figures: int


def recognise(spark: SparkSession, config: Config, sources: DataFrame, make: Callable[[], extract.Extractor], parts_folder: str) -> DataFrame:
    return run(spark, config, sources, make, parts_folder).metrics


def run(spark: SparkSession, config: Config, sources: DataFrame, make: Callable[[], extract.Extractor], parts_folder: str) -> Run:
    """Reads the pages that have no part yet, and writes their parts and figures.

    sources: doc_id, path, stem, kind, ord.  Files that can't be opened are reported and left out.  With the method `text` (or `docling`, where the extractor has it)
    PDFs that hold text are read as they are; images, and PDFs of images, are recognised.
    """
    timeout, parallel = config.page_timeout, config.n_parallel
    listed = kept(extract.file_pages(sources, make, timeout, parallel))
    for r in listed.where("error is not null").toLocalIterator():
        logger.error("Failed to open %s: %s", r["path"], r["error"])
    pages_ = extract.page_list(listed)
    parts = files.read_parts(spark, parts_folder) if config.resume else None
    todo = pages_ if parts is None else pages.todo(pages_, parts)
    todo = kept(todo)
    count, left = pages_.count(), todo.count()
    folder = f"{parts_folder.rstrip('/')}-raw/{uuid.uuid4().hex}"
    if not left:
        empty = spark.createDataFrame([], f"{extract.PAGES_RAW}")
        return Run(pages_, page_metrics(empty, pages.text_parts(empty)), count, count, 0, 0, 0)
    native = None
    if config.extraction_method != "paddleocrvl" and not config.pdf_force_ocr:
        classes = extract.pdf_classes(listed.join(todo.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi"), make, timeout, parallel)
        method = extract.resolve_method(F.lit(config.extraction_method), F.col("class"), has_docling="docling" in getattr(make, "methods", ()))
        native = kept(classes.select("path", method.alias("method")).where("method <> 'paddleocrvl'"))

    def read(rows: DataFrame, name: str, how: str = "") -> DataFrame:
        # raw texts are dear, and the parts that say which are to be read change below: they go to a table first
        extract.extract_pages(rows, make, None, config.use_layout_detection, timeout, parallel, how).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    raw = read(todo if native is None else todo.join(native, "path", "left_anti"), "recognised")
    found = pages.page_parts(raw, config)
    drawn = 0
    if native is not None:
        for how, method in (("native", "text"), ("docling", "docling")):
            own = todo.join(native.where(F.col("method") == method), "path", "left_semi")
            if not own.isEmpty():
                texts = read(own, how, how)
                drawn += write_figures(texts, config.figures_dir)
                raw, found = raw.union(texts), found.union(pages.text_parts(texts))
    seen = Observation("parts")
    bad = F.col("status") == "error"
    batch = files.write_parts(found.observe(seen, F.count_if(~bad).alias("done"), F.count_if(bad).alias("errors")), parts_folder)
    metrics = kept(page_metrics(raw, spark.read.parquet(batch)))
    files.drop(spark, folder)
    return Run(pages_, metrics, count, count - left, seen.get["done"], seen.get["errors"], drawn)


def write_figures(raw: DataFrame, folder: str) -> int:
    """Writes the figures of native pages into folder/<page>/imgs, from the tasks that have them; the number of files."""
    own = raw.select("page_id", F.explode("figures").alias("f")).select(F.concat("page_id", F.lit("/imgs/"), "f.name").alias("name"), "f.content")
    return 0 if own.isEmpty() else filesink.write_files(own, folder)


def books(spark: SparkSession, config: Config, page_list: DataFrame, parts_folder: str) -> DataFrame:
    return pages.assemble(page_list, files.read_parts(spark, parts_folder), config.extraction_method, config.header_patterns)


def write_report(metrics: DataFrame, config: Config, total: int, skipped: int, model: str, elapsed_s: float, load_s: float = 0.0) -> None:
    """The run's report, line by line, into config.report_file."""
    facts = {"Date": time.strftime("%Y-%m-%d %H:%M:%S"), "Model": model, "Layout detection": str(config.use_layout_detection), "Output": f"`{config.output_file}`"}
    lines = stats.report(metrics, total=total, skipped=skipped, title="OCR Run Report", facts=facts, load_s=load_s, elapsed_s=elapsed_s)
    os.makedirs(os.path.dirname(config.report_file) or ".", exist_ok=True)
    with open(config.report_file, "w", encoding="utf-8", newline="\n") as out:
        for r in lines.orderBy("part", "ord").toLocalIterator():
            out.write(r["line"] + "\n")


def write_epub(spark: SparkSession, config: Config, path: str) -> None:
    """The book of one archive, over whatever is there, with its images and drawings in the figures' folder, which is emptied first."""
    archive = spark.read.format("binaryFile").load(path).select(F.lit("book").alias("doc_id"), "content")
    found = epub.images(archive)
    book = epub.clean_books(epub.texts(archive), found)
    shutil.rmtree(config.figures_dir, ignore_errors=True)
    os.makedirs(config.figures_dir)
    for rows in (found.select(F.col("saved").alias("name"), "content"), epub.svg_files(book).select("name", F.encode("content", "utf-8").alias("content"))):
        filesink.write_files(rows, config.figures_dir)
    text = F.col("markdown")
    if config.mode == "obsidian":
        text = markup.wikilinks_markdown(text, config.vault_figures_dir)
    os.makedirs(os.path.dirname(config.output_file) or ".", exist_ok=True)
    with open(config.output_file, "w", encoding="utf-8", newline="\n") as out:
        out.write(book.select(text.alias("markdown")).first()["markdown"])
    if config.mode == "obsidian":
        migrate(spark, config, flat=True)


def epub_books(archives: DataFrame) -> DataFrame:
    """doc_id, markdown, svgs, metrics of archives (doc_id, content)."""
    return epub.clean_books(epub.texts(archives), epub.images(archives))


def postprocess_only(spark: SparkSession, config: Config, *paths: str) -> DataFrame:
    return pages.postprocess_books(files.read_markdown(spark, *paths), config)


def migrate(spark: SparkSession, config: Config, flat: bool = False, page_ids: DataFrame | None = None, dry_run: bool = False) -> int:
    """Copies figures into the vault; the number of files."""
    if not config.vault_root or not config.vault_figures_dir:
        raise ValueError("the vault's root and its figures folder are needed")
    target = f"{config.vault_root}/{config.vault_figures_dir}"
    pattern = f"{config.figures_dir}/*" if flat else f"{config.figures_dir}/*/imgs/*"
    found = _names(spark, pattern).withColumn("page_id", F.element_at(F.split("path", "/"), -3))
    existing = _names(spark, f"{target}/*")
    return files.copy_figures(figures.migration_plan(found, existing, page_ids, dry_run), target, dry_run)


def _names(spark: SparkSession, pattern: str) -> DataFrame:
    import glob
    import os

    rows = [(os.path.abspath(p), os.path.basename(p)) for p in sorted(glob.glob(pattern)) if os.path.isfile(p)]
    return spark.createDataFrame(rows, "path string, name string")


def by_document(metrics: DataFrame) -> DataFrame:
    """Statistics per document, and for all in a row without one; no row of no pages."""
    return stats.run_stats(metrics, "doc_id", totals=True)
