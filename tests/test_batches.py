"""Python functions of texts work on a slice at a time: what a worker holds doesn't grow with the Arrow batch."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import batches, html, loops


def peak(udf, text, rows=4000):
    """Most bytes of Python objects while an Arrow batch goes through; results are let go as they are sent on."""
    batch, seen = pa.array([text, None] * (rows // 2)), 0
    tracemalloc.start()
    try:
        for got in udf.func(iter([batch, batch.slice(0, 0)])):
            assert got.null_count == len(got) // 2 or len(got) == 1
            seen += len(got)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        assert seen == rows


def test_slices_are_bounded_and_whole():
    texts = pa.array(["a" * n for n in (3, 100, 0, 5000, 1, 1)] + [None] * 3 + ["é" * 400])
    found = [s.to_pylist() for s in batches.slices(texts, 1000)]
    assert sum(found, []) == texts.to_pylist() and len(found) > 2
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 1000 for s in found)
    assert list(batches.slices(pa.array([], pa.string()))) == []


def test_converter_holds_a_slice_at_a_time():
    assert peak(html._convert, "<p>" + "some <b>words</b> " * 500 + "</p>") < 8 << 20  # of 18 MB


def test_loops_are_looked_for_in_a_slice_at_a_time():
    assert peak(loops._collapsed, "some words and 15 more; " * 3 + "line\n" * 2000) < 40 << 20  # a search of a million characters takes 80


def test_batches_of_many_slices_keep_their_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<h1>"), F.repeat(F.lit("x"), 400), F.col("id").cast("string"), F.lit("</h1>"))).alias("t"))
    for i, t in df.select("id", html.html_to_markdown(F.col("t"))).collect():
        assert t == (f"# {'x' * 400}{i}" if i % 7 else None)


def test_no_worker_where_no_page_is_read_without_layout(spark):
    """A Python step holds a worker in each core, rows or not: loops have one only where a page may be asked for."""
    from quire.config import Config
    from quire.operators.pages import page_parts

    line = "a part of a line " * 4
    raw = spark.range(4).selectExpr("cast(id as string) doc_id", "concat('p', id) page_id", "id ord", f"concat('{line}', id) raw_text", "cast(null as string) error", "id % 2 = 0 or id = 9 as some")

    def found(no_layout):
        df = page_parts(raw.withColumn("no_layout", no_layout).drop("some"), Config(keep_html=False))
        steps = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return steps, [r["clean_text"].count("part") for r in df.orderBy("ord").collect()]

    assert found(F.lit(False)) == (1, [4] * 4)  # the converter's
    assert found(F.col("some")) == (3, [1, 4, 1, 4])
    assert found(F.when(F.col("some"), True)) == (3, [1, 4, 1, 4])
