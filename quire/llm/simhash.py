"""SimHash near-duplicates, joined by a Gray-order hierarchical index.

Fingerprints at four or fewer differing bits agree wholly on two of six blocks of bits.  Each
distinct fingerprint goes to the 15 buckets that its pairs of blocks name, and a task joins whole
buckets: their fingerprints, sorted by Gray rank, are the leaves of an index whose nodes hold the
bits that all leaves below share.  A search adds up, from the top, the differences on the bits a node has
beyond its parent's, and leaves out every group whose sum goes over the limit.  So every pair
within the limit is found, and none beyond.  A node whose leaves all belong to the searcher's component already is left
out as well: of a bucket's links only a spanning forest is needed, so thousands of near copies in one bucket do not give
millions of pairs.  Buckets above a size are cut into parts, and each pair of parts is joined in a task of its own.

Null texts count as empty: fingerprint zero, linked like any other.  A null doc_id links, but names no component
unless all of its component's are null.  Repeated rows stay.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.llm import _base
from quire.llm._graph import components

SEED = 42
DIFFERENCES = 4
#: Rows of a bucket beyond which it is cut into parts, and rows that a task joins at a time.
PART_ROWS = 4096
CHUNK_ROWS = 120_000
FAN = 16


def fingerprint(text: str | None, width: int = 4) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower and split know ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 4096):
        ones += np.unpackbits(h[a : a + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _prints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype="<u8").view("<i8"), index=text.index)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return docs.select("doc_id", _prints("text").alias("fp"))


def gray_rank(fp):
    """Place in the Gray sequence, as a column of signed longs."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def block_masks(differences: int = DIFFERENCES, bits: int = 64) -> list[int]:
    """Masks of the pairs of blocks: fingerprints within the differences agree on one at least."""
    n = differences + 2
    edges = [bits * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    return [a | b for a, b in combinations(masks, 2)]


class GrayIndex:
    """Index over rows sorted by bucket and Gray rank; joins rows of one bucket."""

    def __init__(self, fps, first, last, differences: int = DIFFERENCES, lone: bool = False):
        """fps: unsigned 64-bit.  Row i looks among rows first[i] to last[i] - 1."""
        self.fps, self.first, self.last, self.most = fps, first, last, differences
        self.values, self.masks = [fps], [np.full(len(fps), 2**64 - 1, dtype=np.uint64)]
        while len(self.values[-1]) > 1:
            value, mask = self.values[-1], self.masks[-1]
            starts = np.arange(0, len(value), FAN)
            same = np.bitwise_and.reduceat(mask & ~(value ^ np.repeat(value[starts], np.diff(np.append(starts, len(value))))), starts)
            self.values.append(value[starts])
            self.masks.append(same)
        self.root = np.arange(len(fps))

    def _joint(self) -> list:
        """By level and node: the component of all leaves below, or -1."""
        joint = [self.root]
        while len(joint) < len(self.values):
            below = joint[-1]
            starts = np.arange(0, len(below), FAN)
            least, most = np.minimum.reduceat(below, starts), np.maximum.reduceat(below, starts)
            joint.append(np.where(least == most, least, -1))
        return joint

    def search(self, rows):
        """Pairs (row, other) within the differences, other in the row's range, but for those joined already."""
        joint = self._joint()
        rows = rows[self.first[rows] < self.last[rows]]
        low, high = self.first[rows], self.last[rows] - 1
        level = np.zeros(len(rows), dtype=np.int64)
        for k in range(1, len(self.values)):
            level[(high // FAN ** (k - 1)) - (low // FAN ** (k - 1)) > 1] = k
        q = node = acc = seen = None
        for k in reversed(range(len(self.values))):
            new = np.flatnonzero(level == k)
            a, b = low[new] // FAN**k, high[new] // FAN**k
            two = a != b
            nq, nn = np.concatenate([rows[new], rows[new][two]]), np.concatenate([a, b[two]])
            if q is not None and len(q):  # children of what is left of the level above
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                cq, ca, cs = np.repeat(q, FAN), np.repeat(acc, FAN), np.repeat(seen, FAN)
                ok = child < len(self.values[k])
                span = FAN**k
                ok &= (child * span < self.last[cq]) & ((child + 1) * span > self.first[cq])
                q, node, acc, seen = cq[ok], child[ok], ca[ok], cs[ok]
                q, node = np.concatenate([q, nq]), np.concatenate([node, nn])
                acc, seen = np.concatenate([acc, np.zeros(len(nq), np.int64)]), np.concatenate([seen, np.zeros(len(nq), np.uint64)])
            else:
                q, node, acc, seen = nq, nn, np.zeros(len(nq), np.int64), np.zeros(len(nq), np.uint64)
            mask = self.masks[k][node]
            acc = acc + np.bitwise_count((self.fps[q] ^ self.values[k][node]) & mask & ~seen)
            keep = (acc <= self.most) & (joint[k][node] != self.root[q])
            q, node, acc, seen = q[keep], node[keep], acc[keep], mask[keep]
        return q, node

    def join(self, a, b) -> None:
        """Takes links into self.root: each component's smallest row."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def run(self):
        """Joins all; (row, root) of the rows that are not their own root."""
        width = self.last - self.first
        for at in range(0, len(small := np.flatnonzero((width > 0) & (width < 4 * FAN))), 65_536):
            self.join(*self.search(small[at : at + 65_536]))
        for at in range(0, len(large := np.flatnonzero(width >= 4 * FAN)), 256):
            self.join(*self.search(large[at : at + 256]))
        rows = np.flatnonzero(self.root != np.arange(len(self.root)))
        return rows, self.root[rows]


def links(fps: DataFrame, differences: int = DIFFERENCES, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): links that join distinct fingerprints fp as all links within the differences do."""
    signed = [m - 2**64 if m >> 63 else m for m in block_masks(differences)]
    keyed = fps.select("fp", gray_rank(F.col("fp")).alias("rank"), F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("k", "key"))
    large = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")).drop("n")
    large = _base.cut(large)
    if large.isEmpty():
        rest = keyed.select("k", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "rank", "fp")
    else:
        joined = keyed.join(large, ["k", "key"], "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
        # a row of a large bucket goes to each pair of parts that holds its own
        others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        rest = joined.withColumn("other", F.explode(others)).select("k", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rank", "fp")
    bucket = ["k", "key", "i", "j"]

    def run(batches) -> Iterator:
        def work(k, key, i, j, part, fp):
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(k)))
            last, row = np.repeat(starts + sizes, sizes), np.arange(len(k))
            first = row + 1
            across = i != j
            if across.any():  # rows of part i look among those of part j, which come after them
                later = np.add.reduceat((part == j).astype(np.int64), starts)
                second = last - np.repeat(later, sizes)
                first = np.where(across, np.where(part == i, second, last), first)
            index = GrayIndex(fp.view("<u8"), first, last, differences)
            a, b = index.run()
            return pd.DataFrame({"a": fp[a], "b": fp[b]})

        held: list = []
        n = 0
        for batch in batches:
            held.append([batch[c].to_numpy() for c in ("k", "key", "i", "j", "part", "fp")])
            n += len(batch)
            if n >= CHUNK_ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                same = np.ones(n, dtype=bool)
                for c in cols[:4]:
                    same &= c == c[-1]
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last bucket may go on
                if cut:
                    yield work(*[c[:cut] for c in cols])
                held, n = [[c[cut:] for c in cols]], n - cut
        if n:
            yield work(*[np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = rest.repartition(*bucket).sortWithinPartitions(*bucket, "part", "rank")
    return dealt.select("k", "key", "i", "j", "part", "fp").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, differences: int = DIFFERENCES) -> DataFrame:
    """doc_id, fingerprint, component_id.  docs: doc_id, text."""
    prints = _base.cut(fingerprints(docs))
    found = components(links(prints.select("fp").distinct(), differences))
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = named.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = roots.join(ids, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, differences: int = DIFFERENCES) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's, of rows that repeat it one with the least text hash.

    Rows with null doc_ids come after all others.
    """
    same = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", same.alias("same"))
    kept = near_duplicates(docs.select(key.alias("doc_id"), "text"), differences).where("doc_id = component_id")
    kept = kept.select("doc_id.doc_id", F.col("doc_id.same").alias("_same")).distinct().alias("k")
    named = docs.withColumn("_same", same).alias("d")
    joined = named.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._same") == F.col("k._same")), "left_semi")
    return joined.dropDuplicates(["doc_id", "_same"]).select(*docs.columns)


def op2_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.table(spark, sf_dir, "documents"))
