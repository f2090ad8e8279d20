"""Rows that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names; a temporary one only where none is named on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names; cached where it names none, as in tests."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    df = df.persist()
    df.count()
    return df
