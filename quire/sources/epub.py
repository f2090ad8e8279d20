"""EPUB archives: images and text, with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import epub
from quire.operators.figures import collision_names

#: Images that are taken, and tags that end a line.
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg")
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "br"}


def images(books: DataFrame) -> DataFrame:
    """doc_id, path (in the archive), name, content, saved of each image.  books: doc_id, content."""

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for i, path in enumerate(archive.namelist()):
                        if path.lower().endswith(IMAGES):
                            yield pd.DataFrame({"doc_id": [doc], "ord": [i], "path": [path], "name": [path.rpartition("/")[2]], "content": [archive.read(path)]})

    return collision_names(books.select("doc_id", "content").mapInPandas(run, "doc_id string, ord long, path string, name string, content binary")).drop("ord")


def image_names(found: DataFrame) -> DataFrame:
    """doc_id, names: map from a path in the archive to the name it is saved under."""
    return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "saved"))).alias("names"))


def _spine(archive: zipfile.ZipFile) -> list[str]:
    """Documents in the package's order; all XHTML files by name where there is no package."""
    every = [n for n in archive.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    try:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        root = ElementTree.fromstring(archive.read(package))
        base = package.rpartition("/")[0]
        items = [e.get("href") for e in root.iter() if e.tag.endswith("}item") and "html" in (e.get("media-type") or "")]
        return [f"{base}/{h}" if base else h for h in items] or sorted(every)
    except (KeyError, StopIteration, ElementTree.ParseError):
        return sorted(every)


def _words(node) -> list[str]:
    """Stripped texts below a node, depth first, with a line feed after each block that has any."""
    out, stack = [], [(node, False)]
    begun: list[int] = []
    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            if item.strip():
                out.append(item.strip())
        elif closing:
            tag = item.tag.rpartition("}")[2] if isinstance(item.tag, str) else ""
            if len(out) > begun.pop() and tag in BLOCKS:
                out.append("\n")
        else:
            begun.append(len(out))
            stack.append((item, True))
            for child in reversed(item):
                stack.append((child.tail or "", False))
                stack.append((child, False))
            stack.append((item.text or "", False))
    return out


def texts(books: DataFrame) -> DataFrame:
    """doc_id, markdown, items; documents that aren't well-formed XML are left out.  books: doc_id, content."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found, names = [], _spine(archive)
                    for name in names:
                        try:
                            root = ElementTree.fromstring(archive.read(name).decode("utf-8", "ignore"))
                        except (ElementTree.ParseError, KeyError):
                            continue
                        if text := " ".join(_words(root)).replace("  ", " ").strip():
                            found.append(text)
                rows.append((doc, "\n\n".join(found), len(names)))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown", "items"])

    return books.select("doc_id", "content").mapInPandas(run, "doc_id string, markdown string, items int")


def clean_books(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """raw (doc_id, markdown) cleaned, with its drawings (svgs) and metrics; found: images()."""
    if found is not None:
        raw = raw.join(image_names(found), "doc_id", "left")
    else:
        raw = raw.withColumn("names", F.lit(None).cast("map<string,string>"))
    raw = raw.withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    clean = raw.select("doc_id", F.col("markdown").alias("raw"), "names", epub.inline_svgs(F.col("markdown")).alias("svgs"), epub.clean_markdown(F.col("markdown"), F.col("names")).alias("markdown"))
    return clean.select("doc_id", "markdown", "svgs", epub.metrics(F.col("raw"), F.col("markdown"), F.size("names")).alias("metrics"))


def svg_files(clean: DataFrame) -> DataFrame:
    """doc_id, name, content of the drawings of clean_books()."""
    named = clean.select("doc_id", F.posexplode("svgs").alias("k", "content"))
    return named.select("doc_id", F.format_string("inline_svg_%03d.svg", F.col("k") + 1).alias("name"), "content")
