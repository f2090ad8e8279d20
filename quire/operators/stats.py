"""Run statistics: one row per page in, totals out.

page_metrics(doc_id, name, t_pre, t_ocr, t_post, total, chars, looped, no_layout, error); skipped pages have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.formats import duration, seconds, thousands
from quire.functions.sums import exact_avg, exact_sum

STEPS = ("t_ocr", "t_post", "total")

# The report's labels, headings and sentences.
SUMMARY = ["## Summary", "", "| Metric | Value |", "|---|---|"]
CELLS = ("Total pages", "Processed successfully", "Skipped (resume)", "Errors", "Fallback no-layout", "Model load", "Total duration (pipeline)", "Total characters", "Average characters/page")
BREAKDOWN = ["## Execution Time Breakdown", "", "| Step | Avg | Min | Max | Total | % |", "|---|---|---|---|---|---|"]
STEP_LABELS = {"t_ocr": "Inference (pipeline.predict)", "t_post": "Post-processing", "total": "**Total/page**"}
REVIEW = [
    "## Pages processed in fallback (without layout) — to review",
    "",
    "These pages triggered a timeout and were reprocessed without layout detection.",
    "Quality may be degraded (missing headers, broken words).",
    "",
]
DETAIL = ["## Per-page Detail", "", "| Page | OCR | Post-processing | Total | Characters | Notes |", "|---|---|---|---|---|---|"]
# End of fixed values.


def _ok() -> Column:
    return ~F.coalesce(F.col("error"), F.lit(False))


def run_stats(pages: DataFrame, *by: str, totals: bool = False) -> DataFrame:
    """done, errors, loop_stops, fallbacks, total_chars, avg_chars, avg_time per group; with totals, in the same pass, a row for each shorter list of groups, whose others are null."""
    fallback = _ok() & F.coalesce(F.col("no_layout"), F.lit(False)) & (F.coalesce(F.col("name"), F.lit("")) != "")
    found = (pages.rollup if totals else pages.groupBy)(*by).agg(
        F.count_if(_ok()).alias("done"),
        F.count_if(~_ok()).alias("errors"),
        F.count_if(_ok() & F.coalesce(F.col("looped"), F.lit(False))).alias("loop_stops"),
        F.count_if(fallback).alias("fallbacks"),
        F.coalesce(F.sum(F.when(_ok(), F.col("chars"))), F.lit(0)).alias("total_chars"),
        F.coalesce(exact_avg(F.when(_ok(), F.col("total"))), F.lit(0.0)).alias("avg_time"),
    )
    return found.withColumn("avg_chars", F.when(F.col("done") > 0, F.floor(F.col("total_chars") / F.col("done"))).otherwise(0).cast("long"))


def with_eta(stats: DataFrame, total: Column, skipped: Column) -> DataFrame:
    """Seconds left: mean time by pages that are neither done, skipped nor failed; null if either is zero."""
    left = total - F.col("done") - skipped - F.col("errors")
    return stats.withColumn("eta_s", F.when((F.col("avg_time") != 0) & (left > 0), F.col("avg_time") * left))


def step_breakdown(pages: DataFrame, *by: str) -> DataFrame:
    """avg, min, max, sum and share of the whole time of each step; zeros where nothing was done."""
    zero = F.lit(0.0)
    own = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("t"), F.col("total").alias("whole")) for s in STEPS])).alias("s")
    rows = pages.where(_ok()).select(*by, own).select(*by, "s.step", "s.t", "s.whole")
    found = rows.groupBy(*by, "step").agg(*[F.coalesce(f(F.col("t")), zero).alias(n) for n, f in (("avg", exact_avg), ("min", F.min), ("max", F.max), ("sum", exact_sum))], F.coalesce(exact_sum(F.col("whole")), zero).alias("whole"))
    return found.select(*by, "step", "avg", "min", "max", "sum", F.when(F.col("whole") != 0, 100 * F.col("sum") / F.col("whole")).otherwise(0.0).alias("percent"))


def fallback_pages(pages: DataFrame) -> DataFrame:
    """Pages that were read without layout, to be looked at again."""
    return pages.where(_ok() & F.col("no_layout") & (F.coalesce(F.col("name"), F.lit("")) != "")).select("name")


def detail_rows(pages: DataFrame) -> DataFrame:
    """ord and the report's table row of each page."""
    ok = F.concat_ws(" | ", "name", seconds(F.col("t_ocr"), 2), seconds(F.col("t_post"), 3), seconds(F.col("total"), 2), thousands(F.col("chars")), F.when(F.col("no_layout"), "fallback").otherwise(""))
    failed = F.concat_ws(" | ", "name", *[F.lit("—")] * 3, F.lit("ERROR"), F.lit(""))
    return pages.select("ord", F.concat(F.lit("| "), F.when(_ok(), ok).otherwise(failed), F.lit(" |")).alias("line"))


def _lines(spark, part: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, i, line) for i, line in enumerate(lines)], "part int, ord long, line string")


def report(pages: DataFrame, *, total: int, skipped: int, title: str, facts: dict[str, str], load_s: float, elapsed_s: float) -> DataFrame:
    """The report as lines (part, ord, line): order by part and ord, and join by line feeds.

    Totals make a few rows; the page table stays distributed.
    """
    spark = pages.sparkSession
    s, steps = run_stats(pages).first(), {r["step"]: r for r in step_breakdown(pages).collect()}  # one row, and one per step
    shown = spark.range(1).select(duration(F.lit(float(elapsed_s))).alias("d")).first()["d"]
    head = [f"# {title}", "", *[f"**{k}** : {v}  " for k, v in facts.items()], "", *SUMMARY]
    values = (total, s["done"], skipped, s["errors"], s["fallbacks"], f"{load_s:.1f}s", shown, f"{s['total_chars']:,}", f"{s['avg_chars']:,}")
    head += [f"| {k} | {v} |" for k, v in zip(CELLS, values, strict=True)] + [""]
    if s["done"]:
        head += BREAKDOWN
        for step, a, b in (("t_ocr", 2, 1), ("t_post", 3, 2)):
            r = steps[step]
            head.append(f"| {STEP_LABELS[step]} | {r['avg']:.{a}f}s | {r['min']:.{a}f}s | {r['max']:.{a}f}s | {r['sum']:.{b}f}s | {r['percent']:.1f}% |")
        r = steps["total"]
        head += [f"| {STEP_LABELS['total']} | **{r['avg']:.2f}s** | **{r['min']:.2f}s** | **{r['max']:.2f}s** | **{r['sum']:.1f}s** | — |", ""]
    lines = _lines(spark, 0, head)
    if s["fallbacks"]:
        lines = lines.union(_lines(spark, 1, REVIEW)).union(fallback_pages_in_order(pages)).union(_lines(spark, 3, [""]))
    if s["done"] or s["errors"]:
        rows = detail_rows(pages).select(F.lit(5), F.col("ord").cast("long"), "line")
        lines = lines.union(_lines(spark, 4, DETAIL)).union(rows).union(_lines(spark, 6, [""]))
    return lines


def fallback_pages_in_order(pages: DataFrame) -> DataFrame:
    kept = pages.where(_ok() & F.col("no_layout") & (F.coalesce(F.col("name"), F.lit("")) != ""))
    return kept.select(F.lit(2).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- "), "name").alias("line"))
