"""Source files: listing, selection, reading, and the sinks that act on files."""

from __future__ import annotations

import logging
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.formats import base_name, stem, suffix
from quire.operators import order

logger = logging.getLogger(__name__)


class SourceError(Exception):
    pass


def either_case(extensions: tuple[str, ...]) -> str:
    """A glob for these suffixes in either case, which the listing itself applies."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None, recursive: bool = False) -> DataFrame:
    """path, name, stem, ext, kind, mtime, length of the files; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", either_case(extensions))
    name = base_name(F.col("path"))
    found = reader.load(folder).select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), "length")
    return found.select("path", "name", stem(F.col("name")).alias("stem"), suffix(F.col("name")).alias("ext"), order.kind(F.col("name")).alias("kind"), "mtime", "length")


def collect_sources(spark: SparkSession, folder: str, extensions: tuple[str, ...], files: tuple[str, ...] | None = None, documents: bool = True) -> DataFrame:
    """The files of a run with ord: those given, or a folder's images, PDFs and EPUBs in natural order.

    documents=False takes images alone, in plain order.
    """
    if files is not None:
        if lost := [f for f in files if "://" not in f and not os.path.exists(local(f))]:
            raise SourceError(f"not found: {', '.join(lost)}")
        rows = spark.createDataFrame(list(enumerate(files)), "ord long, path string").withColumn("name", base_name(F.col("path")))
        return rows.select("path", "name", stem(F.col("name")).alias("stem"), suffix(F.col("name")).alias("ext"), order.kind(F.col("name")).alias("kind"), "ord")
    wanted = extensions + (tuple(order.KINDS) if documents else ())
    if "://" not in folder:
        if not os.path.exists(folder):
            raise SourceError(f"not found: {folder}")
        if os.path.isfile(folder) and not documents and not folder.lower().endswith(extensions):
            raise SourceError(f"not an image: {folder}")
    found = listing(spark, folder, wanted)
    if found.isEmpty():
        if has_images_below(spark, folder, extensions):
            raise SourceError(f"no image directly in {folder}: images are in subfolders; copy and number them first")
        if not documents:
            raise SourceError(f"no image ({', '.join(extensions)}) in {folder}")
    if not documents:
        for r in order.duplicate_stems(found).orderBy("stem").toLocalIterator():
            logger.warning("%s: %d files of that name; their pages share a part", r["stem"], r["files"])
    keys = [order.natural_key(F.col("name")), F.col("name")] if documents else [F.col("path")]
    return order.with_position(found.drop("length"), *keys, start=0)


def has_images_below(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> bool:
    """Whether a subfolder, at any depth, has images; the folder's own don't count."""
    return not listing(spark, folder, extensions, recursive=True).select(_relative(folder)).where(F.instr("relative", "/") > 0).limit(1).isEmpty()


def _relative(folder: str):
    root = os.path.abspath(local(folder)) if "://" not in folder else folder.rstrip("/")
    return F.substr("path", F.locate(root, "path") + F.lit(len(root) + 1)).alias("relative")


def subfolder_plan(spark: SparkSession, folder: str, extensions: tuple[str, ...], chapters: list[str] | None = None, prefix: str = "page", start: int = 1, by_level: bool = False) -> DataFrame:
    """old, new_name of the images in the subfolders: folder by folder, by time or level by level."""
    files = listing(spark, folder, extensions, recursive=True).select("*", _relative(folder))
    files = files.where(F.instr("relative", "/") > 0).withColumn("folder", F.substring_index("relative", "/", 1))
    folders = order.requested(files.select("folder").distinct(), chapters).select("folder", F.col("ord").alias("folder_ord"))
    inner = F.expr("substring(relative, length(folder) + 2)")
    keys = [F.col("folder_ord"), order.level_key(inner, F.col("mtime"))] if by_level else [F.col("folder_ord"), F.col("mtime"), F.col("path")]
    plan = order.numbered(files.join(folders, "folder"), *keys, prefix=prefix, start=start)
    return plan.select("ord", F.col("path").alias("old"), "new_name")


def rename_plan(spark: SparkSession, folder: str, extensions: tuple[str, ...], prefix: str = "page", start: int = 1) -> DataFrame:
    """old, new_name of a folder's images, by time."""
    plan = order.numbered(listing(spark, folder, extensions), F.col("mtime"), F.col("path"), prefix=prefix, start=start)
    return plan.select("ord", F.col("path").alias("old"), "new_name")


def local(path: str) -> str:
    return path.removeprefix("file:") if path.startswith("file:/") else path


def apply_plan(plan: DataFrame, folder: str, move: bool = False, dry_run: bool = False) -> list[str]:
    """Copies or renames on the machine that has the files, row by row; gives the new paths in order.

    Files are renamed by way of names that no file has, so that a file whose name another one gets isn't lost.
    """
    done, moved, mark = [], [], uuid.uuid4().hex
    for r in plan.orderBy("ord").toLocalIterator():
        old, new = local(r["old"]).replace("///", "/"), os.path.join(folder, r["new_name"])
        if dry_run:
            print(f"  {os.path.basename(old)}  ->  {r['new_name']}")
        elif move:
            os.rename(old, f"{new}.{mark}")
            moved.append(new)
        else:
            shutil.copy2(old, new)
        done.append(new)
    for new in moved:
        os.rename(f"{new}.{mark}", new)
    return done


def free_path(path: str) -> str:
    """path, or with the first free number behind its stem."""
    root, ext = os.path.splitext(path)
    n, found = 1, path
    while os.path.exists(found):
        found, n = f"{root}_{n}{ext}", n + 1
    return found


def write_book(markdown: str, path: str) -> str:
    """Never over a file that is there."""
    path = free_path(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as file:
        file.write(markdown)
    return path


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (stem, ext and any others; stems differ) with name: stem.ext, or with the least number behind the stem that neither taken (name) nor a wanted stem has."""
    whole = taken.select(stem(F.col("name")).alias("own"), F.regexp_extract("name", r"(\.[^.]*)\z", 1).alias("ext")).union(wanted.select("stem", "ext"))
    numbered = whole.select(F.regexp_extract("own", r"\A(?s:(.+))_([1-9][0-9]{0,8})\z", 1).alias("stem"), "ext", F.regexp_extract("own", r"_([1-9][0-9]{0,8})\z", 1).try_cast("int").alias("n")).where("n is not null and stem <> ''")
    plain = taken.select(stem(F.col("name")).alias("stem"), F.regexp_extract("name", r"(\.[^.]*)\z", 1).alias("ext"), F.lit(0).alias("n"))
    used = numbered.union(plain).groupBy("stem", "ext").agg(F.collect_set("n").alias("used"))
    free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"), 1)
    number = F.coalesce(F.when(F.array_contains("used", 0), free), F.lit(0))
    return wanted.join(used, ["stem", "ext"], "left").select(*wanted.columns, F.concat("stem", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), "ext").alias("name"))


def write_books(books: DataFrame, path: str, single: bool) -> DataFrame:
    """Writes books (doc_id, markdown) beside path, from the tasks that have them, and gives doc_id and name: path's own if it is the only one, else with -doc_id behind its stem; never over a file that is there."""
    from quire.operators.keep import kept
    from quire.sources.filesink import write_files

    spark = books.sparkSession
    folder, (own, ext) = os.path.dirname(path) or ".", os.path.splitext(os.path.basename(path))
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    named = books.select("doc_id", F.lit(own).alias("stem") if single else F.concat(F.lit(f"{own}-"), "doc_id").alias("stem"), F.lit(ext).alias("ext"))
    store, path_ = _store(spark, folder)
    taken = [(x.getPath().getName(),) for x in store.listStatus(path_(folder))] if store.exists(path_(folder)) else []
    names = kept(free_names(named, spark.createDataFrame(taken, "name string")).select("doc_id", "name"))
    write_files(books.join(names, "doc_id").select("name", F.encode("markdown", "utf-8").alias("content")), folder)
    return names


def copy_figures(plan: DataFrame, target: str, dry_run: bool = False) -> int:
    """Copies a migration plan's files, from the tasks that list them; the number of them."""
    from quire.sources.filesink import write_files

    if dry_run:
        return plan.count()
    return write_files(plan.select("name", F.col("path").alias("source")), target)


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (the path) and markdown."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("markdown"))


def write_parts(parts: DataFrame, folder: str, batch: int | None = None) -> str:
    """Adds parts as files of their own, in a folder with the batch's number; nothing that is there is read or written anew.  Gives that folder.

    A page may come again: read_parts() takes what came last.  A numbered batch that comes again replaces its own files.  Without a number, parts are written
    aside first; then the batch claims the next number, which it shares with no other run, so batches are in the order in which they were complete.
    """
    folder = folder.rstrip("/")
    if batch is not None:
        parts.write.mode("overwrite").parquet(out := f"{folder}/batch={batch:012d}")
        return out
    spark = parts.sparkSession
    parts.write.parquet(aside := f"{folder}/_aside-{uuid.uuid4().hex}")
    store, path = _store(spark, folder)
    n = 1 + max([-1, *_batches(spark, folder)])
    while True:
        claim, out = path(f"{folder}/_claimed-{n:012d}"), f"{folder}/batch={n:012d}"
        if store.createNewFile(claim):
            if not store.exists(path(out)):
                break
            store.delete(claim, False)  # its batch came between
        n += 1
    store.rename(path(aside), path(out))
    store.delete(claim, False)
    return out


def _store(spark: SparkSession, folder: str):
    """The folder's file system, and what makes its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop(spark: SparkSession, folder: str) -> None:
    store, path = _store(spark, folder)
    store.delete(path(folder), True)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches in folder."""
    store, path = _store(spark, folder)
    if not store.exists(path(folder)):
        return []
    names = [x.getPath().getName() for x in store.listStatus(path(folder))]
    return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]


def read_parts(spark: SparkSession, folder: str) -> DataFrame | None:
    """Each page's parts of the latest batch that has any, which are several where sources share a name; None where no part is."""
    if not _batches(spark, folder):
        return None
    every = spark.read.parquet(folder)
    columns = [c for c in every.columns if c != "batch"]
    last = every.groupBy("doc_id", "page_id", "batch").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    last = last.groupBy("doc_id", "page_id").agg(F.max_by("rows", "batch").alias("rows"))
    return last.select(F.explode("rows").alias("p")).select("p.*")


def compact_parts(spark: SparkSession, folder: str) -> None:
    """Writes each page's latest parts into one batch, which counts before the others go; to be run while no batch is written."""
    old = _batches(spark, folder)
    if len(old) > 1:
        write_parts(read_parts(spark, folder), folder)
        for n in old:
            drop(spark, f"{folder.rstrip('/')}/batch={n:012d}")
