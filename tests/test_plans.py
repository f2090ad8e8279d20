"""What the plans of the page queries must look like."""

import contextlib
import io
import re

import pytest

from quire.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = {"collapse_loops", "planted_loops", "page_pipeline", "collision_names", "html_to_markdown", "page_pipeline_markdown"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_ingest", "stream_books", "paged_files"}))
def test_stays_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert bool(re.search("EvalPython|InPandas|InArrow", text)) == (name in PYTHON)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["clean_page", "fix_double_scripts", "wikilinks_md", "collapse_loops"])
def test_reads_two_columns_and_never_shuffles(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert re.findall(r"ReadSchema: (struct<.*>)", text) == ["struct<doc_id:bigint,text:string>"]
    assert "Exchange" not in text


def test_statistics_shuffle_partial_sums_only(spark):
    text = plan(QUERIES["run_stats"](spark, SF))
    assert text.count("Exchange hashpartitioning") <= 1 and "partial_" in text


def test_resume_filters_by_anti_join(spark):
    assert "LeftAnti" in plan(QUERIES["resume_anti_join"](spark, SF))


def test_totals_come_from_the_same_pass(spark):
    text = plan(QUERIES["stats_by_document"](spark, SF))
    assert text.count("Scan parquet") <= 2 and len(re.findall(r"\) Expand", text)) >= 1 and "Union" not in text
    assert len(re.findall(r"\(\d+\) Scan parquet", text)) == 1


@pytest.mark.parametrize("name", ["collapse_loops", "html_to_markdown", "page_pipeline_markdown"])
def test_python_takes_slices(spark, name):
    """Every Python step of texts is an iterator over Arrow batches, which sends slices on as they are done."""
    from pyspark.util import PythonEvalType

    kinds = re.findall(r"\(\d+\) ArrowEvalPython.*?Arguments: .*?\], (\d+)", plan(QUERIES[name](spark, SF)), re.S)
    assert kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}
