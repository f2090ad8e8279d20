"""Removes lines that many sites share, by distinct-site spread.

Each line is known by its 128-bit hash.  A HyperLogLog sketch of the sites that hold it is built for every line
and merged by aggregation, so a line on billions of pages costs one sketch per task.  Lines estimated
well above or below the threshold are settled; those within the sketch's error of it get an exact count
of distinct sites.  A document that was copied to many sites makes no boilerplate of its lines: a line must be in as many different
texts, too, which are counted in the same way.  Lines at or above the threshold are boilerplate and go from every text, whatever is left of it.

Lines are split at line feeds and compared without white space (ASCII's six characters) at their ends; lines shorter than `min_chars` stay,
as do all lines of null texts.  Null sites count as one site.  All rows stay.
Repeated rows stay, and their sites and texts count once.  An empty table gives no rows.

Lines are looked up where they are in the spread ones as long as those are BROADCAST at most.  Of more, the ones that hold over one HOT_SHARE-th of all
their occurrences, HOT_SHARE at most, go to every task, and the others are joined on their hashes, so no line's occurrences meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

MIN_SITES = 6
MIN_CHARS = 20
#: The sketch's log2 of buckets, and the relative error that counts as near: three standard errors.
LG_K = 10
NEAR = 3 * 1.04 / 2 ** (LG_K / 2)
BROADCAST, HOT_SHARE = 200_000, 2_000


def _bare(line):
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.xxhash64("text").alias("same"), F.explode(F.split("text", "\n")).alias("line"))
    bare = keyed.select("site", "same", _bare(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    return bare.select(F.unhex(F.md5("line")).alias("key"), "site", "same")


def _held(lines: DataFrame, spread: DataFrame, broadcast: int = BROADCAST, hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows of lines whose key is in spread (key, n), which is read from files."""
    size = spread.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if size["keys"] <= broadcast:
        return lines.join(F.broadcast(spread.select("key")), "key", "left_semi")
    hot = spread.where(F.col("n") * hot_share > size["n"]).select("key")  # fewer than hot_share
    rest = lines.join(F.broadcast(hot), "key", "left_anti").join(spread.select("key").hint("merge"), "key", "left_semi")
    return lines.join(F.broadcast(hot), "key", "left_semi").union(rest)


def _about(estimate, least: int):
    """Whether an estimate may be of the least or more, and whether it must be."""
    return estimate >= (1 - NEAR) * least - 1, estimate > (1 + NEAR) * least + 1


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, broadcast: int = BROADCAST, hot_share: int = HOT_SHARE) -> DataFrame:
    """key, n (occurrences, to a row), sites and texts of the lines on min_sites sites and in min_sites texts or more; both are estimates where that settles it."""
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K)))
    lines = _lines(docs, min_chars)
    spread = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), sketch("site").alias("sites"))
    spread = _base.cut(spread.where(_about(F.col("sites"), min_sites)[0]))
    own = _base.cut(_held(lines, spread, broadcast, hot_share))
    both = spread.join(own.groupBy("key").agg(sketch("same").alias("texts")), "key").where(_about(F.col("texts"), min_sites)[0])
    both = _base.cut(both)
    for column, of in (("sites", "site"), ("texts", "same")):
        sure = _about(F.col(column), min_sites)[1]
        near = own.join(F.broadcast(both.where(~sure).select("key")), "key", "left_semi") if both.where(~sure).count() <= broadcast else _held(own, both.where(~sure), 0, hot_share)
        exact = near.select("key", of).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
        both = both.join(exact, "key", "left").withColumn(column, F.coalesce("exact", column)).drop("exact").where(F.col(column) >= min_sites)
        both = _base.cut(both)
    return both


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, broadcast: int = BROADCAST, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs (doc_id, text, source and any others) without boilerplate lines, with the number of those in lines_removed."""
    found = boilerplate(docs, min_sites, min_chars, broadcast, hot_share).select("key", "n")
    placed = docs.select("doc_id", "text").where("text is not null")
    placed = placed.select("doc_id", F.xxhash64("text").alias("_same"), F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    placed = placed.select("doc_id", "_same", "_at", _bare(F.col("_line")).alias("_line")).where(F.length("_line") >= min_chars)
    placed = placed.select("doc_id", "_same", "_at", F.unhex(F.md5("_line")).alias("key"))
    # rows with equal doc_id and text lose equal lines
    gone = _held(placed, found, broadcast, hot_share).groupBy("doc_id", "_same").agg(F.collect_set("_at").alias("_gone"))
    named = docs.withColumn("_same", F.xxhash64("text")).alias("d")
    joined = named.join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._same") == F.col("g._same")), "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("d.text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c != "lines_removed"]
    return joined.select(*columns, F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("lines_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents")
    return remove_boilerplate(docs).select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP3_SQL = """
with lines as (
  select doc_id, coalesce(source, '') as site, text as whole, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
bare as (
  select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as own from lines),
shared as (
  select own from bare where length(own) >= 20
  group by own having count(distinct site) >= 6 and count(distinct md5(whole)) >= 6),
judged as (
  select b.*, s.own is not null as gone from bare b left join shared s on s.own = b.own),
kept as (
  select doc_id, count(*) filter (where gone) as lines_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
  from judged group by doc_id)
select d.doc_id, coalesce(k.lines_removed, 0)::int as lines_removed, length(k.text)::bigint as n_chars, md5(k.text) as text_md5
from documents d left join kept k using (doc_id)
"""
