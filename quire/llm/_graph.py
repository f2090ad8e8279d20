"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

HOT_SHARE = 2_000


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b): root is the smallest vertex of its component.

    Each round joins every vertex's larger neighbours, then its smaller ones, to its smallest
    neighbour, until nothing changes; the number of rounds grows with the logarithm of the longest
    path.  Minima are aggregated before the shuffle, no vertex's neighbours are gathered, and
    each round is cut by a checkpoint in the shared folder.
    """
    now = _base.cut(_ordered(links.select("a", "b")))
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _ordered(_to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _to_least(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = _base.cut(_ordered(small))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_least(links: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """Links with m, the smallest neighbour of a; a vertex with a great share of all links is looked up where its links are."""
    least = _base.cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = least.where(F.col("n") * hot_share > total).select("a", "m")  # fewer than hot_share
    if total <= hot_share or hot.isEmpty():
        found = links.join(least.select("a", "m"), "a")
    else:
        rest = links.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.where(F.col("n") * hot_share <= total).select("a", "m"), "a")
        found = links.join(F.broadcast(hot), "a").select("a", "b", "m").union(rest.select("a", "b", "m"))
    return found.select("a", "b", F.least("a", "m").alias("m"))


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]
