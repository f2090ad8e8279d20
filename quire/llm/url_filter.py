"""URL rules by Bloom filter cascades.

A rule is a host and a path: it fits its host and all subdomains where the url's path starts with the
rule's; of the rules that fit, the longest decides (of two as long, the one with the longer host).  Each url so has a few keys that
could be rules: the last labels of its host, as many as some rule has, with the start of its path, as
long as some rule's.  All keys of the corpus are the universe.

For the blocked and the allowed rules there is a cascade each.  Its first filter holds the rules; the second the
universe's false positives of the first; the third the rules that the second takes for false
positives; and so on until none is left.  So a cascade answers exactly for every key of the universe, and urls are judged
without a join.  The first filter's error rate is the number of rules over that of keys, so that later
filters hold about as many keys as there are rules.  Filters of false positives are put together from each task's bits.

Urls that are null or lack `://` have an empty host and path, which no rule fits.  A key that is blocked and allowed
is blocked.  Without rules every url is allowed.  Null and repeated page_ids keep their rows.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    """A filter over keys given as two 64-bit hashes each."""

    def __init__(self, keys: int, error: float, seed: int = 0):
        error = min(max(error, 1e-15), 0.5)
        self.bits = max(64, math.ceil(-max(keys, 1) * math.log(error) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(-math.log2(error)))
        self.words = np.zeros(self.bits // 64, dtype="<u8")
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)  # keys that meet in one filter part in another

    def places(self, h1, h2):
        first, step = (self._mixed(np.asarray(h).astype("<i8").view("<u8"))[:, None] for h in (h1, h2))
        return (first + np.arange(self.hashes, dtype=np.uint64) * (step | np.uint64(1))) % np.uint64(self.bits)

    def _mixed(self, h):
        h = (h ^ self.seed) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(29)

    def add(self, h1, h2) -> None:
        p = self.places(h1, h2).ravel()
        np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def holds(self, h1, h2):
        if not len(h1):
            return np.zeros(0, dtype=bool)
        p = self.places(h1, h2)
        return (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).all(axis=1)


class Cascade:
    """Filters, by turns of listed keys and of the universe's false positives."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def holds(self, h1, h2):
        """Whether each key is listed; exact for keys of the universe."""
        h1, h2 = np.asarray(h1), np.asarray(h2)
        listed, left = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            passed = level.holds(h1[left], h2[left])
            listed[left[passed]] = k % 2 == 0  # what a filter lets through counts as its own kind until a later one says otherwise
            left = left[passed]
        return listed


def _hashes(key):
    return F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")


def _filter_of(rows: DataFrame, keys: int, error: float, seed: int) -> Bloom:
    """The filter of rows (h1, h2): each task ORs its bits, the driver gets the words that aren't zero."""
    bloom = Bloom(keys, error, seed)

    def bits(batches):
        for batch in batches:
            p = np.unique(bloom.places(batch["h1"], batch["h2"]).ravel())
            at, starts = np.unique(p >> np.uint64(6), return_index=True)
            words = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), starts) if len(p) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"at": at.astype(np.int64), "word": words.view(np.int64)})

    for r in rows.select("h1", "h2").mapInPandas(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        bloom.words[r["at"]] = np.uint64(r["word"] % 2**64)
    return bloom


def _passing(rows: DataFrame, bloom: Bloom) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bloom)  # its size is known: bits

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(h1.to_numpy(), h2.to_numpy()), index=h1.index)

    return rows.where(passes("h1", "h2"))


def build(listed: Iterable[str], universe: DataFrame, error: float | None = None, max_levels: int = 60) -> Cascade:
    """listed: keys; universe: key (repeats allowed)."""
    spark, listed = universe.sparkSession, sorted(set(listed))
    if not listed:
        return Cascade([])
    own = spark.createDataFrame([(k,) for k in listed], "key string").select("key", *_hashes(F.col("key"))).toPandas()
    h1, h2 = own["h1"].to_numpy(), own["h2"].to_numpy()
    first = error
    if first is None:
        keys = universe.agg(F.approx_count_distinct("key")).first()[0]
        first = len(listed) / max(2 * len(listed), keys)
    levels = [Bloom(len(listed), first)]
    levels[0].add(h1, h2)
    names = F.broadcast(spark.createDataFrame([(k,) for k in listed], "key string"))  # the rules, which the caller has at hand
    wrong = _base.cut(_passing(universe.select("key", *_hashes(F.col("key"))), levels[0]).distinct().join(names, "key", "left_anti"))
    while len(levels) < max_levels:
        n = wrong.count()
        if not n:
            break
        levels.append(_filter_of(wrong, n, error or 0.5, len(levels)))
        kept = levels[-1].holds(h1, h2)
        h1, h2 = h1[kept], h2[kept]
        if not len(h1):
            break
        levels.append(Bloom(len(h1), error or 0.5, len(levels)))
        levels[-1].add(h1, h2)
        wrong = _base.cut(_passing(wrong, levels[-1]))
    else:
        raise ValueError("keys of the universe can't be told apart by their hashes")
    return Cascade(levels)


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path added."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path")]
    return pages.select(*columns, F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def _keys(rules) -> F.col:
    """The keys of host and path that could be rules, longest first, as an array of (length, host's length, key)."""
    labels = sorted({host.count(".") + 1 for _, host, _ in rules})
    lengths = sorted({len(path) for _, _, path in rules})
    n, found = F.size(F.split("host", r"\.")), []
    for a in labels:
        suffix = F.substring_index("host", ".", -a)
        for b in lengths:
            key = F.concat(suffix, F.substring("path", 1, b))
            found.append(F.when((n >= a) & (F.length("path") >= b), F.struct(F.length(key).alias("n"), F.length(suffix).alias("h"), key.alias("key"))))
    return F.sort_array(F.filter(F.array(*found), lambda k: k.isNotNull()), asc=False)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, error: float | None = None) -> DataFrame:
    """pages (url and any others) with host, path, rule and verdict added."""
    rules = [(verdict, host.translate(str.maketrans(UPPER, LOWER)), path) for verdict, host, path in rules]
    if any(verdict not in ("block", "allow") or not host or "/" in host or not path.startswith("/") for verdict, host, path in rules):
        raise ValueError("a rule is block or allow, a host, and a path that starts with /")
    placed = parts(pages.drop("rule", "verdict"))
    if not rules:
        return placed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    placed = placed.withColumn("_keys", _keys(rules))
    universe = placed.select(F.explode("_keys.key").alias("key"))
    shared = pages.sparkSession.sparkContext.broadcast([build([h + p for v, h, p in rules if v == kind], universe, error) for kind in ("block", "allow")])

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Place from 1 of the first key that is listed, below 0 if it is allowed; 0 if none is."""
        sizes = np.array([len(x) for x in h1], dtype=np.int64)
        a, b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in h]) if len(h) else np.zeros(0, np.int64) for h in (h1, h2))
        block, allow = (c.holds(a, b) for c in shared.value)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        hit = np.flatnonzero(block | allow)[::-1]
        out = np.zeros(len(sizes), dtype=np.int32)
        out[row[hit]] = np.where(block[hit], at[hit], -at[hit])  # the first comes last
        return pd.Series(out, index=h1.index)

    at = first(F.transform("_keys", lambda k: F.xxhash64(k["key"])), F.transform("_keys", lambda k: F.xxhash64(k["key"], F.lit(1))))
    judged = placed.withColumn("_at", at)
    rule = F.when(F.col("_at") != 0, F.element_at("_keys", F.greatest(F.abs("_at"), F.lit(1)))["key"])
    return judged.withColumn("rule", rule).withColumn("verdict", F.when(F.col("_at") > 0, "block").otherwise("allow")).drop("_keys", "_at")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(_base.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with cut as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
rules (verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
  select page_id, r.verdict, r.h || r.p as rule, row_number() over (partition by page_id order by length(r.h || r.p) desc) as k
  from cut join rules r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))
select c.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from cut c left join fits f on f.page_id = c.page_id and k = 1
"""
