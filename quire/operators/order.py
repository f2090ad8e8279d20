"""Order, numbering and selection of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.formats import padded, stem, suffix
from quire.operators.keep import kept

#: How a source's suffix names its kind.
KINDS = {".pdf": "pdf", ".epub": "epub"}


def natural_key(name: Column) -> Column:
    """Sorts page_2 before page_10: text and numbers by turns.  Add the name itself to break ties."""
    text, number = (F.regexp_extract_all(name, F.lit("([^0-9]*)([0-9]*)"), F.lit(i)) for i in (1, 2))
    return F.zip_with(text, number, lambda s, n: F.struct(s.alias("s"), F.when(n != "", n).try_cast("decimal(38,0)").alias("n")))


def kind(name: Column) -> Column:
    end = suffix(name)
    return F.when(end == ".pdf", "pdf").when(end == ".epub", "epub").otherwise("image")


def is_source(name: Column, extensions: tuple[str, ...], documents: bool = True) -> Column:
    return suffix(name).isin(*extensions, *(KINDS if documents else ()))


def numbered(files: DataFrame, *order: Column, prefix: str = "page", start: int = 1) -> DataFrame:
    """files (name and any others) with ord and new_name: prefix_001.jpg and so on, wide enough for the last.

    Rows are numbered by ranges of the order, not in one task: each range is counted, and its rows are numbered from
    what stands before.
    """
    ranked = with_position(files, *order, start=start)
    total = files.count()
    width = max(3, len(str(start + total - 1)))
    return ranked.withColumn("new_name", F.concat(F.lit(prefix + "_"), padded(F.col("ord"), width), suffix(F.col("name"))))


def with_position(rows: DataFrame, *order: Column, start: int = 1, name: str = "ord") -> DataFrame:
    """rows with their place in a total order, from start on."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # ranges come from a sample and may differ from one computation to the next, so rows are kept before they are counted
    marked = kept(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1)))
    # one row per partition
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(sizes, "_part").withColumn(name, F.col("_before") + F.col("_in") + start).drop("_at", "_part", "_in", "_before")


def duplicate_stems(files: DataFrame) -> DataFrame:
    """Stems that more than one file has."""
    return files.groupBy(stem(F.col("name")).alias("stem")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def kind_gate(files: DataFrame, most: int = 5) -> DataFrame:
    """A row per kind: count, first names, and what is wrong with the folder: more than one PDF or EPUB, or kinds that are mixed.

    The first names are picked from each task's first ones, so no kind's files are gathered.
    """
    marked = files.select("name", kind(F.col("name")).alias("kind"))
    counts = marked.groupBy("kind").agg(F.count(F.lit(1)).alias("files"))
    names = marked.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(natural_key(F.col("name")), "name"))).where(F.col("k") <= most)
    first = names.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("preview"))
    kinds = counts.agg(F.count(F.lit(1)).alias("kinds"))  # one row
    problem = F.when(F.col("kinds") > 1, "mixed kinds").when(F.col("kind").isin("pdf", "epub") & (F.col("files") > 1), F.concat(F.lit("more than one "), "kind"))
    return counts.join(first, "kind").join(F.broadcast(kinds)).select("kind", "files", "preview", problem.alias("problem"))


def requested(folders: DataFrame, names: list[str] | None) -> DataFrame:
    """folders (folder and any others) that were asked for, with ord in the order of asking; all in natural order if none were."""
    spark = folders.sparkSession
    if names is None:
        return with_position(folders, natural_key(F.col("folder")), F.col("folder"), start=0)
    asked = spark.createDataFrame(list(enumerate(names)), "ord long, folder string")  # as many rows as names were given
    return folders.join(F.broadcast(asked), "folder")


def not_found(folders: DataFrame, names: list[str]) -> DataFrame:
    asked = folders.sparkSession.createDataFrame(list(enumerate(names)), "ord long, folder string")
    return asked.join(folders.select("folder").distinct(), "folder", "left_anti")


def level_key(relative: Column, moment: Column) -> Column:
    """Own files of a folder first, by time, then its folders in natural order, level by level."""
    parts = F.split(relative, "/")
    last = F.size(parts) - 1
    zero = F.lit(None).cast("timestamp")
    return F.transform(parts, lambda p, i: F.struct(F.when(i == last, 0).otherwise(1).alias("level"), F.when(i == last, moment).otherwise(zero).alias("moment"), F.when(i < last, natural_key(p)).alias("folder"), p.alias("name")))
