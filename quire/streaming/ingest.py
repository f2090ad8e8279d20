"""Pages as they come: files of pages_raw in, parts out, totals on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.config import Config
from quire.operators import pages, stats
from quire.sources import extract, files


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of new Parquet files in folder, as they appear."""
    return spark.readStream.schema(extract.PAGES_RAW).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_parts(stream: DataFrame, config: Config, parts_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Cleans each batch and writes its parts; a batch that comes again replaces its own, and of a page's parts the latest counts (files.read_parts)."""

    def batch(rows: DataFrame, number: int) -> None:
        # of a page that comes twice in a batch the last by its source and text counts
        last = rows.groupBy("doc_id", "page_id").agg(F.max_by(F.struct(*extract.COLUMNS), F.struct("source", "raw_text", "error", "t_ocr")).alias("r")).select("r.*")
        files.write_parts(pages.page_parts(last, config), parts_folder, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(stream: DataFrame) -> DataFrame:
    """Running totals per document; output in complete or update mode."""
    rows = stream.select("doc_id", F.col("page_id").alias("name"), F.col("t_ocr").alias("total"), F.length("raw_text").cast("long").alias("chars"), F.lit(False).alias("looped"), "no_layout", F.col("error").isNotNull().alias("error"))
    return stats.run_stats(rows, "doc_id")


def windowed_speed(stream: DataFrame, moment: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Pages and mean seconds per window of event time; rows later than `late` are left out."""
    return stream.withWatermark(moment, late).groupBy(F.window(moment, window)).agg(F.count(F.lit(1)).alias("pages"), F.avg("total").alias("avg_time"))
