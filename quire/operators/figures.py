"""Figures: layout boxes, and where figure files go."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of boxes that are figures, the least score, labels of blocks that are left out of a page's text.
FIGURE_LABELS = ("image", "chart", "header_image", "footer_image", "table")
LEAST_SCORE = 0.5
DROPPED_BLOCKS = ("header_image", "footer", "footer_image")
BOXES = "array<struct<label:string,score:double,bbox:array<double>>>"


def parse_boxes(layout: Column) -> Column:
    """Boxes of a layout result in JSON, whatever else it holds; a result that is a text itself is read as JSON again.

    Without a result there are no boxes; a field that is missing or isn't what it should be is null.  What isn't JSON has null for boxes.
    """
    get = F.try_variant_get
    result = F.try_parse_json(layout)
    text = get(result, "$.res", "string")
    inner = F.when(F.startswith(F.schema_of_variant(get(result, "$.res", "variant")), F.lit("STRING")), F.try_parse_json(text)).otherwise(get(result, "$.res", "variant"))
    found = F.coalesce(get(inner, "$.boxes", "array<variant>"), F.array().cast("array<variant>"))
    box = lambda b: F.struct(get(b, "$.label", "string").alias("label"), get(b, "$.score", "double").alias("score"), get(b, "$.bbox", "array<double>").alias("bbox"))
    return F.when(result.isNotNull(), F.transform(found, box))


def figure_boxes(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: b["label"].isin(*FIGURE_LABELS) & (F.coalesce(b["score"], F.lit(0.0)) > LEAST_SCORE))


def text_blocks(labels: Column) -> Column:
    return F.filter(labels, lambda label: ~label.isin(*DROPPED_BLOCKS))


def crop_points(bbox: Column, dpi: int = 200) -> Column:
    """A box in points, from pixels at dpi."""
    return F.transform(bbox, lambda x: x * F.lit(72.0 / dpi))


def migration_plan(figures: DataFrame, existing: DataFrame, page_ids: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """The figures (path, name, page_id) to copy: those of the pages named, whose name isn't there yet; of equal names the first path.

    A dry run copies nothing and so lists all of equal names.
    """
    if page_ids is not None:
        figures = figures.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    new = figures.join(existing.select("name").distinct(), "name", "left_anti")
    if dry_run:
        return new
    first = new.groupBy("name").agg(F.min("path").alias("path"))
    return new.join(first, ["name", "path"], "left_semi")


def collision_names(files: DataFrame) -> DataFrame:
    """files (doc_id, path, name, and ord where their order isn't that of paths) with saved: a name that is taken gets the first number behind its stem that is free.

    Which numbers are free depends on all names before, so a document's names, not its files, meet in one call.
    """
    place = "ord" if "ord" in files.columns else "path"

    def name_all(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        tried: dict[str, int] = {}
        saved = []
        for name in rows.sort_values(place)["name"]:
            found, path = name, PurePosixPath(name)
            while found in used:
                tried[name] = tried.get(name, 0) + 1
                found = f"{path.stem}_{tried[name]}{path.suffix}"
            used.add(found)
            saved.append(found)
        return rows.sort_values(place)[["doc_id", "path"]].assign(saved=saved)

    kinds = {c: files.schema[c].dataType.simpleString() for c in ("doc_id", "path")}
    names = files.select(*dict.fromkeys(["doc_id", "path", "name", place])).groupBy("doc_id").applyInPandas(name_all, f"doc_id {kinds['doc_id']}, path {kinds['path']}, saved string")
    return files.join(names, ["doc_id", "path"])
