"""Files of pages as a data source: spark.read.format("quire_pages").

A partition is a range of pages of a file, or some small files; its task opens the files itself, so no content ever travels.  Ranges are cut by the files' lengths, which
the listing knows: the k-th of m ranges of a file has its pages k*n/m to (k+1)*n/m, whatever n turns out to be.  A file that can't be opened gives one row with an
error, and so does a page that can't be read.

Options: path (a folder, a glob or a file), extractor (MODULE:NAME, or what packed() gave in hexadecimal), read (pages, native or raster), suffix (.pdf),
dpi (200), rangeBytes (64 MB), timeout (seconds; 0: none).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.reader import ExtractionError, packed, reader

RANGE_BYTES = 64 << 20
COLUMNS = {"pages": "", "native": ", text string", "raster": ", image binary"}


def made(option: str) -> bytes:
    """What makes an extractor, from an option's text."""
    if ":" in option:
        module, _, name = option.partition(":")
        return packed(getattr(importlib.import_module(module), name))
    return bytes.fromhex(option)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and lengths of the files, as Spark writes paths."""
    import fnmatch
    import os

    from pyarrow import fs

    if "://" in path:
        store, own = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(own)] if path.endswith(own) else path.split("://")[0] + "://"
    else:
        store, own, head = fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")), "file:"
    folder, _, name = own.rpartition("/")
    glob = any(c in name for c in "*?[")
    if not glob and store.get_file_info(own).type == fs.FileType.File:
        found = [store.get_file_info(own)]
    else:
        found = store.get_file_info(fs.FileSelector(folder if glob else own))
    found = [f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(suffix) and (not glob or fnmatch.fnmatch(f.base_name, name))]
    return sorted((head + f.path, f.size) for f in found)


def ranges(files: list[tuple[str, int]], size: int) -> list[list[tuple[str, int, int]]]:
    """(path, k, m) by partition: the k-th of m ranges of a file's pages; small files share a partition."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, length in files:
        m = max(1, -(-length // size))
        if m > 1 or room < length or not out:
            out += [[] for _ in range(m)]
            room = size if m == 1 else length  # a large file's last range takes no other file
        for k in range(m):
            out[k - m].append((path, k, m))
        room -= length
    return out


class Ranges(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(tuple(files))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.read_, self.suffix = options["path"], options.get("read", "pages"), options.get("suffix", ".pdf")
        if self.read_ not in COLUMNS:
            raise ValueError(f"read is one of {', '.join(COLUMNS)}")
        self.made, self.dpi = made(options["extractor"]), int(options.get("dpi", 200))
        self.size, self.timeout = int(options.get("rangebytes", RANGE_BYTES)), float(options.get("timeout", 0))

    def partitions(self) -> list[InputPartition]:
        return [Ranges(x) for x in ranges(listed(self.path, self.suffix), self.size)] or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own = reader(self.made)
        none = () if self.read_ == "pages" else (None,)
        for path, k, m in partition.value:
            try:
                n = own.ask("pages", path, timeout=self.timeout)
            except ExtractionError as e:
                if not k:  # one row for a file, whatever its ranges
                    yield (path, None, None, str(e), *none)
                continue
            for page in range(k * n // m + 1, (k + 1) * n // m + 1):
                try:
                    args = (page, self.dpi) if self.read_ == "raster" else (page,)
                    value = () if self.read_ == "pages" else (own.ask(self.read_, path, *args, timeout=self.timeout),)
                    yield (path, n, page, None, *value)
                except ExtractionError as e:
                    yield (path, n, page, str(e), *none)


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return "path string, n_pages int, page int, error string" + COLUMNS[self.options.get("read", "pages")]

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read_files(spark: SparkSession, path: str, make: Callable | str, read: str = "pages", **options) -> DataFrame:
    """path, n_pages, page, error, and the text or image, of the pages of files; make: what makes an extractor, or its MODULE:NAME."""
    spark.dataSource.register(PagedFiles)
    source = spark.read.format("quire_pages").option("extractor", make if isinstance(make, str) else packed(make).hex()).option("read", read)
    return source.options(**{k: str(v) for k, v in options.items()}).load(path)
