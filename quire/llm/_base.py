"""What the operators of this folder share: tables, the shared folder, files in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is set on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), in compressed files, of which a reader takes the columns that it needs; a checkpoint's rows are as wide as in memory."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _place(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def put_file(uri: str, data: bytes) -> None:
    file = NewFile(uri)
    file.put(data)
    file.close()


class NewFile:
    """A file that is written under another name first, so that a task that is run twice leaves one whole file."""

    def __init__(self, uri: str):
        self.where, self.path = _place(uri)
        self.where.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own, self.size = f"{self.path}.{uuid.uuid4().hex}.part", 0
        self.out = self.where.open_output_stream(self.own, compression=None)

    def put(self, data: bytes) -> int:
        """Appends; gives where data begins."""
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.out.close()
        self.where.move(self.own, self.path)


def drop_folder(uri: str) -> None:
    where, path = _place(uri)
    where.delete_dir(path)


def get_bytes(uri: str, first: int, size: int) -> bytes:
    where, path = _place(uri)
    with where.open_input_file(path) as file:
        return file.read_at(size, first)
