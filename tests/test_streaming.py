"""State of streams: which pages of a document have come, and speed by window."""

import time

from pyspark.sql import functions as F

from quire.streaming import assembly, ingest

SCHEMA = "doc_id string, page_id string, ord long, place int, n_pages int, block string, status string"


def page(doc, place, n, block=None, status="ok"):
    return (doc, f"p{place}", place + 1, place, n, block or f"<{doc}{place}>", status)


def feed(spark, tmp_path, *batches, wait=3600.0):
    """Writes each list of pages as a file of its own, in order, and runs the stream over what is new."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        assembly.write_books(stream, "m", str(tmp_path / "out"), str(tmp_path / "state"), wait).awaitTermination()


def books(spark, tmp_path):
    head = "# OCR Book\n\n<!-- Generated with m -->\n"
    return {r["doc_id"]: (r["markdown"].removeprefix(head), r["n_pages"], r["n_errors"]) for r in assembly.read_books(spark, str(tmp_path / "out")).collect()}


def events(spark, tmp_path):
    found = spark.read.parquet(str(tmp_path / "out" / "events")).where("event is not null")
    return sorted((r["batch"], r["doc_id"], r["event"]) for r in found.collect())


def test_books_come_with_their_last_page(spark, tmp_path):
    feed(spark, tmp_path, [page("a", 2, 3), page("b", 0, 2), page("c", 0, 1)], [page("a", 0, 3), page("b", 1, 2, status="error")])
    assert books(spark, tmp_path) == {"b": ("<b0><b1>", 2, 1), "c": ("<c0>", 1, 0)}
    feed(spark, tmp_path, [page("a", 1, 3), page("a", 0, 3, "<a0 anew>")], [page("c", 0, 1, "<late>")], [page("b", 0, 2), page("b", 0, 2)])
    assert books(spark, tmp_path) == {"a": ("<a0 anew><a1><a2>", 3, 0), "b": ("<b0><b1>", 2, 1), "c": ("<late>", 1, 0)}
    assert events(spark, tmp_path) == [(0, "c", "whole"), (1, "b", "whole"), (2, "a", "whole"), (3, "c", "late"), (4, "b", "late")]


def test_documents_are_given_up_in_time(spark, tmp_path):
    feed(spark, tmp_path, [page("a", 0, 9), page("a", 7, 9), page("b", 0, 1)], wait=0.5)
    time.sleep(1.5)
    feed(spark, tmp_path, [page("c", 0, 2)], wait=0.5)
    assert books(spark, tmp_path) == {"a": ("<a0><a7>", 2, 0), "b": ("<b0>", 1, 0)}
    time.sleep(1.5)
    feed(spark, tmp_path, [page("a", 1, 9)], wait=0.5)  # its state is gone, its parts aren't
    time.sleep(1.5)
    feed(spark, tmp_path, [page("d", 0, 2)], wait=0.5)
    assert books(spark, tmp_path)["a"] == ("<a0><a1><a7>", 3, 0)
    assert [e for _, d, e in events(spark, tmp_path) if d in "ab"] == ["whole", "given up", "given up"]


def test_of_equal_pages_in_a_batch_the_last_by_text_counts(spark, tmp_path):
    from quire.config import Config
    from quire.sources import extract, files

    rows = [("d", "p", 1, "s", "m", text, 0.5, None, False) for text in ("first text", "second text", "later text")]
    spark.createDataFrame(rows, extract.PAGES_RAW).repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.write_parts(ingest.page_stream(spark, str(tmp_path / "in")), Config(keep_html=True), str(tmp_path / "parts"), str(tmp_path / "state")).awaitTermination()
    assert [r["clean_text"] for r in files.read_parts(spark, str(tmp_path / "parts")).collect()] == ["second text"]


def test_windowed_speed(spark, tmp_path):
    rows = [(60 * m + s, float(m + s)) for m in range(3) for s in (1, 30)]
    df = spark.createDataFrame(rows, "at int, total double").select(F.timestamp_seconds("at").alias("ts"), "total")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.windowed_speed(stream).writeStream.format("memory").queryName("speed_test").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    found = spark.table("speed_test").orderBy("window").collect()
    assert [(r["pages"], r["avg_time"]) for r in found] == [(2, 15.5), (2, 16.5), (2, 17.5)]


def test_blocks_are_shuffled_three_times(spark):
    """To their files, to the state of their document, and to their book: it was eight times."""
    from quire import queries

    def shuffled():
        status = spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    assert queries.stream_books(spark, "/root/testdata/sf0.01").count() > 0
    many = [n for k, n in shuffled().items() if k not in before]
    assert sum(many) < 4.5 * max(many)
