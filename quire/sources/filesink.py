"""Rows as files of their own: df.write.format("quire_files").

Each row names a file below the folder and holds its content, or the path that it is copied from.  Tasks write the files, none passes through the driver.  A file is written under a name of
the job's own folder and gets its place only when it is whole, so a task that fails, or that runs twice, leaves no half file.  Committing removes
the job's folder; aborting removes it with all that isn't whole yet, and the files that the job's finished tasks had put in place.

Columns: name string, content binary, source string (either of the two may be missing or null).  Options: path (the folder).  A file that is there is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are copied at a time.
PIECE = 1 << 20


def place(folder: str):
    """A folder's file system, and its path there."""
    import os

    from pyarrow import fs

    if "://" in folder:
        store, path = fs.FileSystem.from_uri(folder)
        return store, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:") if folder.startswith("file:/") else folder)


@dataclass
class Written(WriterCommitMessage):
    names: int
    manifest: str


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        if "name" not in columns or not {"content", "source"} & set(columns):
            raise ValueError("a file needs a name, and content or a source")
        self.folder, self.job = folder, f".job-{uuid.uuid4().hex}"
        store, root = place(folder)
        store.create_dir(f"{root}/{self.job}", recursive=True)  # by the driver alone: a task that goes on behind an abort finds none

    def write(self, iterator: Iterator) -> Written:
        store, root = place(self.folder)
        own, n, made = f"{root}/{self.job}/{uuid.uuid4().hex}", 0, set()
        store.create_dir(own, recursive=False)
        manifest = store.open_output_stream(f"{own}.names", compression=None)
        for row in iterator:
            row = row.asDict()
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name below the folder: {name!r}")
            with store.open_output_stream(f"{own}/file", compression=None) as out:
                if row.get("content") is not None:
                    out.write(bytes(row["content"]))
                else:
                    _copy(row["source"], out)
            parent = f"{root}/{name}".rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            manifest.write(name.encode() + b"\n")
            store.move(f"{own}/file", f"{root}/{name}")
            n += 1
        manifest.close()
        return Written(n, f"{own}.names")

    def commit(self, messages: list) -> None:
        store, root = place(self.folder)
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list) -> None:
        store, root = place(self.folder)
        for m in messages:
            if m is not None:
                with store.open_input_stream(m.manifest, compression=None) as names:
                    for name in names.read().decode().splitlines():
                        store.delete_file(f"{root}/{name}")
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def _copy(source: str, out) -> None:
    store, path = place(source)
    with store.open_input_stream(path, compression=None) as file:
        while piece := file.read(PIECE):
            out.write(piece)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema.names)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, and content or source) as files below folder; the number of them, counted on the way."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    if "://" not in folder:
        folder = place(folder)[1]  # tasks have working folders of their own
    rows.sparkSession.dataSource.register(Files)
    seen = Observation("files")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("quire_files").mode("append").option("path", folder).save()
    return seen.get["n"]
