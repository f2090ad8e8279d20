"""Pages and documents: resuming, the page chain, assembly."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import clean, html, markup, math, pages

BOOK_TITLE = "# OCR Book\n\n"


def todo(all_pages: DataFrame, parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_id")) -> DataFrame:
    """Pages that no part stands for yet; a page that failed has a part too."""
    return all_pages.join(parts.select(*keys).distinct(), list(keys), "left_anti")


def skipped(all_pages: DataFrame, parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_id")) -> DataFrame:
    return all_pages.join(parts.select(*keys).distinct(), list(keys), "left_semi")


def figures_from_book(config: Config) -> str:
    """The figures' folder, seen from the book's."""
    return os.path.relpath(config.figures_dir, os.path.dirname(config.output_file) or ".").replace(os.sep, "/")


def _clean(text: Column, config: Config, no_layout: Column | bool = False, spare: bool = False) -> Column:
    return clean.clean_page(text, no_layout, config.remove_isolated_page_numbers, config.rejoin_hyphenated_words, config.collapse_blank_lines, spare)


def _formulas(text: Column) -> Column:
    return math.fix_double_scripts(math.strip_math_spacing(text))


def page_parts(raw: DataFrame, config: Config) -> DataFrame:
    """parts of recognised pages: doc_id, page_id, ord, page_label, clean_text, block, chars, status.

    raw: doc_id, page_id, ord, raw_text, error, no_layout.  Each step is a projection of its own, so that Spark
    computes shared expressions once.
    """
    step = raw.withColumn("_n", pages.page_number(F.coalesce("raw_text", F.lit(""))))
    step = step.select("*", F.col("_n.label").alias("page_label"), F.col("_n.text").alias("_t")).drop("_n")
    text, no_layout = F.col("_t"), F.coalesce(F.col("no_layout"), F.lit(False))
    spare = not config.keep_html  # the converter has a worker in each core already
    if config.postprocess:
        step = step.withColumn("_t", _clean(text, config, no_layout, spare))
    step = step.withColumn("_t", markup.strip_table_styles(text))
    if config.postprocess:
        step = step.withColumn("_t", _formulas(text))
    if config.mode == "obsidian":
        step = step.withColumn("_t", markup.wikilinks_html(text, config.vault_figures_dir))
    else:
        step = step.withColumn("_t", markup.fix_image_paths(text, F.col("page_id"), figures_from_book(config)))
    if not config.keep_html:
        step = step.withColumn("_t", html.html_to_markdown(text))
        if config.postprocess:
            step = step.withColumn("_t", _formulas(_clean(text, config, no_layout, spare)))
    return _parts(step, F.col("_t"))


def text_parts(raw: DataFrame) -> DataFrame:
    """parts of pages with native text; pages without a printed number are labelled by their place."""
    step = raw.withColumn("_n", pages.page_number(F.coalesce("raw_text", F.lit(""))))
    step = step.select("*", F.coalesce(F.col("_n.label"), F.col("ord").cast("string")).alias("page_label"), F.col("_n.text").alias("_t"))
    return _parts(step, F.col("_t"))


def _parts(step: DataFrame, text: Column) -> DataFrame:
    failed = F.col("error").isNotNull()
    return step.select(
        "doc_id",
        "page_id",
        "ord",
        F.when(~failed, F.col("page_label")).alias("page_label"),
        F.when(~failed, text).alias("clean_text"),
        F.when(failed, pages.error_block(F.col("page_id"), F.col("error"))).otherwise(pages.page_block(F.col("page_id"), text, F.col("page_label"))).alias("block"),
        F.when(~failed, F.length(text)).cast("long").alias("chars"),
        F.when(failed, "error").when(F.col("no_layout"), "fallback").otherwise("ok").alias("status"),
    )


def assemble(page_list: DataFrame, parts: DataFrame, method: str, headers: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """books(doc_id, markdown, n_pages, n_errors): title, a comment on the method, and the parts there are, in page order.

    page_list: doc_id, page_id, ord.  Sources that share a name share a page, which has all of their parts, in order, at its first place.
    """
    within = "ord, block" if "ord" in parts.columns else "block"
    own = parts.groupBy("doc_id", "page_id").agg(F.expr(f"listagg(block, '') within group (order by {within})").alias("block"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad"))
    joined = page_list.groupBy("doc_id", "page_id").agg(F.min("ord").alias("ord")).join(own, ["doc_id", "page_id"])
    return books_of(joined, method, headers)


def books_of(blocks: DataFrame, method: str, headers: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """As assemble(), from a row per page: doc_id, page_id, ord, block, and n and bad, the parts and failed parts in it."""
    head = F.lit(f"{BOOK_TITLE}<!-- Generated with {method} -->\n")
    body = F.expr("listagg(block, '') within group (order by ord, page_id)")
    books = blocks.groupBy("doc_id").agg(F.concat(head, body).alias("markdown"), F.sum("n").alias("n_pages"), F.sum("bad").alias("n_errors"))
    return books.withColumn("markdown", pages.header_detection(F.col("markdown"), list(headers))) if headers else books


def postprocess_books(books: DataFrame, config: Config) -> DataFrame:
    """books (markdown and any others) cleaned again after assembly; HTML stays."""
    text = F.col("markdown")
    if config.postprocess:
        books = books.withColumn("markdown", _clean(text, config)).withColumn("markdown", markup.strip_table_styles(text)).withColumn("markdown", _formulas(text))
    books = books.withColumn("markdown", markup.wikilinks_book(text, config.vault_figures_dir))
    return books.withColumn("markdown", pages.header_detection(text, list(config.header_patterns))) if config.header_patterns else books
