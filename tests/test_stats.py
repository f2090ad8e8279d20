"""Sums in any order, and how reports write them."""

import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions.formats import duration, fixed
from quire.functions.sums import exact_avg, exact_sum
from quire.operators import stats
from quire.queries import ORACLE_SQL, QUERIES


def test_sums_are_exact_in_any_partitioning(spark):
    rng = random.Random(1)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-6, 9) for _ in range(5000)] + [0.1] * 1000 + [2.0**52 - 0.5, -(2.0**51) + 0.25, 1e-15]
    got = set()
    for parts, seed in ((1, 0), (3, 1), (17, 2)):
        rows = values[:]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(v,) for v in rows], "v double").repartition(parts)
        got.add(tuple(df.agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first()))
    assert len(got) == 1
    total = float(sum(map(Fraction, values)))
    found = got.pop()
    assert abs(found[0] - total) <= math.ulp(total) and found[1] == found[0] / len(values)
    few = spark.createDataFrame([(0.5,), (None,), (0.25,)], "v double")
    assert tuple(few.agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first()) == (0.75, 0.375)
    assert tuple(few.where("v is null").agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first()) == (None, None)


def test_times_round_to_even(spark):
    values = [0.0, 0.4, 0.5, 1.5, 2.5, 3.5, 59.4, 59.5, 59.999, 60.0, 75.0, 81.0, 90.0, 105.0, 135.0, 3600.0, 5999.9, 1e6 + 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [f"{v:.0f}s" if v < 60 else f"{v / 60:.1f} min" for v in values]
    assert [r[0] for r in df.select(duration(F.col("v"))).collect()] == want
    for digits in range(4):
        assert [r[0] for r in df.select(fixed(F.col("v") / 8, digits)).collect()] == [f"{v / 8:.{digits}f}" for v in values]


@pytest.mark.parametrize("name", ["run_report", "step_breakdown", "run_stats", "stats_by_document", "eta"])
def test_shuffled_rows_give_the_same_report(spark, tmp_path, name):
    """The queries over one table and over the same rows in another order and in other files."""
    source = "/root/testdata/sf0.01/events.parquet"
    events = spark.read.parquet(source)
    events.orderBy(F.rand(5)).repartition(13).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{source}'")
    cursor = db.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    for folder in ("/root/testdata/sf0.01", str(tmp_path)):
        assert sorted((tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect()), key=repr) == want


def test_totals_beside_groups(spark):
    rows = [("a", "p", 1.0, 2, False, None, False), ("a", "q", 0.5, 3, None, True, None), ("b", "r", 4.0, 5, False, False, True)]
    df = spark.createDataFrame(rows, "doc_id string, name string, total double, chars int, looped boolean, no_layout boolean, error boolean")
    found = {r["doc_id"]: (r["done"], r["errors"], r["fallbacks"], r["total_chars"], r["avg_time"]) for r in stats.run_stats(df, "doc_id", totals=True).collect()}
    assert found == {"a": (2, 0, 1, 5, 0.75), "b": (0, 1, 0, 0, 0.0), None: (2, 1, 1, 5, 0.75)}
