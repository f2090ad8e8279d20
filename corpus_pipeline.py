"""A training corpus from `documents`, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
run() writes as Parquet in the shared folder and reads again as the next one's docs.  All but the last
return the columns of `documents`.

* toxicity: rows that the classifier predicts toxic go; it learns from `labels`.
* line_dedup: lines that are on many sites go from the texts; n_chars follows; all rows stay.
* simhash: of each component of near-duplicates the row with the smallest doc_id stays.
* decontaminate: rows that hold an item of `benchmark`, edits allowed, go.
* packing: the rows that are left, as pieces placed in sequences of 2048 tokens.

No stage can be put in SQL whole (a fitted model, HyperLogLog sketches beside exact counts, components, edit distances,
byte-pair merges), so ORACLE_SQL is None; the tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _base, decontaminate, line_dedup, packing, simhash, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, _base.table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _base.table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("simhash", _simhash), ("decontaminate", _decontaminate), ("packing", _packing)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents")
    folder = _base.new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
