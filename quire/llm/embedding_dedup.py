"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a unit vector pseudo-randomly (three rounds of random signs and a fast Hadamard
transform) and names the coordinate with the largest absolute value, with its sign.  Each table joins two such hashes of independent rotations
into a bucket.  Besides its own bucket a vector probes the next likely ones: those where a hash takes its
second- or third-largest coordinate instead.  Pairs that meet in a bucket are verified by cosine in double precision;
every link that is reported reaches the limit.

Equal vectors form a class and are hashed once; their links are counted, not expanded.  A bucket with more than `part_rows`
rows is cut into parts, and each pair of parts is joined in a task of its own, so none is capped.  No pair leaves its task: a pair that
meets in several buckets counts in the first of them, which both vectors' hashes tell, so a bucket gives each row's number of
links, and of its links a spanning forest; components come from those by star contraction.

Vectors that are null, zero, or hold a null or a non-finite component link with nothing.  Vectors of
different lengths link with nothing either.  A null vec_id links, but names no component unless all of its component's
are null; repeated vec_ids count as rows of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._graph import components

LIMIT = 0.95
TABLES = 10
PART_ROWS = 2000
SEED = 11


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows, unscaled; their length is a power of two."""
    import numpy as np

    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, n)
        h *= 2
    return x


def rotated(x, table: int, part: int, seed: int = SEED):
    import numpy as np

    n = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = np.random.default_rng([seed, table, part, n])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], n))
    return x


def ranked(x, table: int, part: int, count: int):
    """The count likeliest vertices of each row, likeliest first: 2 * coordinate + (1 if negative)."""
    import numpy as np

    y = rotated(x, table, part)
    count = min(count, y.shape[1])
    best = np.argpartition(-np.abs(y), count - 1, axis=1)[:, :count]
    size = np.take_along_axis(np.abs(y), best, axis=1)
    best = np.take_along_axis(best, np.argsort(-size, axis=1, kind="stable"), axis=1)
    return best * 2 + (np.take_along_axis(y, best, axis=1) < 0)


#: Which of its likeliest vertices each of the two hashes takes: the own bucket, then the probes.
PROBES = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))


def _usable(vector):
    sound = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector, lambda c: c != 0)
    return F.coalesce(sound, F.lit(False))


def _units(vectors):
    import numpy as np

    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(batches) -> Iterator:
    """Classes with codes: by table and hash the three likeliest vertices (-1 where there are fewer), as 16-bit integers where those suffice, else 32-bit ones."""
    import numpy as np

    for batch in batches:
        for _, rows in batch.groupby(batch["vector"].map(len)):
            x = _units(rows["vector"])
            codes = np.full((len(x), TABLES, 2, 3), -1, dtype="<i4")
            for table in range(TABLES):
                for part in range(2):
                    got = ranked(x, table, part, 3)
                    codes[:, table, part, : got.shape[1]] = got
            codes = codes.astype("<i2") if x.shape[1] <= 1 << 13 else codes
            yield rows.assign(codes=[c.tobytes() for c in codes])


def _probe(batches) -> Iterator:
    """cls, dim, tbl, bucket, own of each probe; own is 1 in a vector's own bucket."""
    import numpy as np

    for batch in batches:
        for _, rows in batch.groupby("dim"):
            codes = _codes(rows["codes"])
            for table in range(TABLES):
                for i, j in PROBES:
                    a, b = codes[:, table, 0, i], codes[:, table, 1, j]
                    some = (a >= 0) & (b >= 0)
                    yield pd.DataFrame({"cls": rows["cls"][some], "dim": rows["dim"][some], "tbl": np.int32(table), "bucket": (a << 24 | b)[some], "own": np.int32(i + j == 0)})


def _codes(column):
    import numpy as np

    kind = f"<i{len(column.iloc[0]) // (TABLES * 6)}"  # rows of one length of vectors
    return np.frombuffer(b"".join(column), kind).reshape(len(column), TABLES, 2, 3).astype(np.int64)


def _reaches(x, y):
    """By pair and table, whether the own bucket of x is among those that y probes; codes of the pairs."""
    import numpy as np

    probed = np.zeros((4, 4), dtype=bool)
    probed[tuple(zip(*PROBES, strict=True))] = True
    same = x[:, :, :, :1] == y
    rank = np.where(same.any(axis=3), same.argmax(axis=3), 3)
    return probed[rank[:, :, 0], rank[:, :, 1]]


def _counts_here(x, y, table: int, bucket: int):
    """Whether this table and bucket are the first where each pair meets."""
    import numpy as np

    to_x, to_y = _reaches(x[:, : table + 1], y[:, : table + 1]), _reaches(y[:, : table + 1], x[:, : table + 1])
    none = np.iinfo(np.int64).max
    of_x, of_y = (z[:, table, 0, 0].astype(np.int64) << 24 | z[:, table, 1, 0] for z in (x, y))
    least = np.minimum(np.where(to_x[:, table], of_x, none), np.where(to_y[:, table], of_y, none))
    return ~(to_x | to_y)[:, :table].any(axis=1) & (least == bucket)


def _verify(limit: float):
    def work(rows):
        """Links of a bucket's parts i and j: numbers by row, and a forest."""
        import numpy as np

        i, j, table, bucket = (int(rows[c].iloc[0]) for c in ("i", "j", "tbl", "bucket"))
        x, codes = _units(rows["vector"]), _codes(rows["codes"])
        cls, part, own, n = rows["cls"].to_numpy(), rows["part"].to_numpy(), rows["own"].to_numpy().astype(bool), rows["n"].to_numpy()
        links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for at in range(0, len(x), 256):
            some = slice(at, at + 256)
            near = x[some] @ x.T >= limit - 1e-9
            near &= own[some, None] | own[None, :]  # one of the two is in its own bucket
            near &= cls[some, None] < cls[None, :]
            if i != j:
                near &= part[some, None] != part[None, :]
            a, b = np.nonzero(near)
            a += at
            for k in range(0, len(a), 50_000):
                p, q = a[k : k + 50_000], b[k : k + 50_000]
                exact = np.einsum("nd,nd->n", x[p], x[q]) >= limit
                p, q = p[exact], q[exact]
                here = _counts_here(codes[p], codes[q], table, bucket)
                links += np.bincount(p[here], weights=n[q[here]], minlength=len(x)).astype(np.int64)
                links += np.bincount(q[here], weights=n[p[here]], minlength=len(x)).astype(np.int64)
                while len(p):
                    ra, rb = root[p], root[q]
                    apart = ra != rb
                    p, q, ra, rb = p[apart], q[apart], ra[apart], rb[apart]
                    np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                    while (root[root] != root).any():
                        root = root[root]
        linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        return [(cls[linked], np.full(len(linked), -1), links[linked]), (cls[child], cls[root[child]], np.zeros(len(child), np.int64))]

    def run(batches) -> Iterator:
        import numpy as np

        key, held, n = ["dim", "tbl", "bucket", "i", "j"], [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < 20_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            ends = np.flatnonzero((rows[key].iloc[1:].to_numpy() != rows[key].iloc[:-1].to_numpy()).any(axis=1))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
            held, n = [rows.iloc[cut:]], len(rows) - cut
            if cut:
                yield from groups(rows.iloc[:cut])
        if n:
            yield from groups(pd.concat(held, ignore_index=True))

    def groups(rows) -> Iterator:
        import numpy as np

        key = rows[["dim", "tbl", "bucket", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        found = [x for a, b in zip(starts, [*starts[1:], len(rows)], strict=True) if b - a > 1 for x in work(rows.iloc[a:b]) if len(x[0])]
        if found:
            yield pd.DataFrame(dict(zip(("a", "b", "links"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def link(classes: DataFrame, limit: float = LIMIT, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """classes: cls (distinct, a long), n (copies), vector (of floats or doubles).  (cls, others), the number of rows linked to it outside its class; and links (a, b) that join what all links join."""
    classes = classes.select("cls", "n", F.size("vector").alias("dim"), "vector")
    kind = classes.schema["vector"].dataType.simpleString()
    hashed = _base.cut(classes.mapInPandas(_hash, f"cls long, n long, dim int, vector {kind}, codes binary"))
    probes = hashed.select("cls", "dim", "codes").mapInPandas(_probe, "cls long, dim int, tbl int, bucket long, own int")
    probes = _base.cut(probes)
    bucket = ["dim", "tbl", "bucket"]
    size = probes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("some"))
    size = size.where((F.col("rows") > 1) & (F.col("some") > 0)).withColumn("parts", F.ceil(F.col("rows") / part_rows).cast("int"))
    met = probes.join(size.select(*bucket, "parts"), bucket).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # a row of a large bucket goes to each pair of parts that holds its own
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "own", "cls").join(hashed.select("cls", "n", "vector", "codes"), "cls")
    group = [*bucket, "i", "j"]
    dealt = met.repartition(*group).sortWithinPartitions(*group)
    found = _base.cut(dealt.mapInPandas(_verify(limit), "a long, b long, links long"))
    others = found.where("b < 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))
    return others, found.where("b >= 0").select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, part_rows: int = PART_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept.  vectors: vec_id, embedding."""
    # floats travel as floats; cosines are of doubles
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    vector = F.col("embedding").cast(f"array<{kind}>")
    # -0.0 and 0.0 are one value
    rows = vectors.select("vec_id", F.when(_usable(vector), F.transform(vector, lambda c: (c + F.lit(0.0)).cast(kind))).alias("vector"))
    same = F.struct(F.xxhash64("vector").alias("h"), F.md5(F.concat_ws(",", F.transform("vector", lambda c: c.cast("string")))).alias("m"))
    keyed = rows.select("vec_id", "vector", F.when(F.col("vector").isNotNull(), same).alias("same"))
    classes = keyed.where("same is not null").groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = _base.cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    others, forest = link(classes, limit, part_rows)
    roots = classes.select("cls", "same", "n", "least").join(components(forest).withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = roots.join(ids, "root").join(others, "cls", "left")
    table = table.select("same", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "same").join(table, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.table(spark, sf_dir, "embeddings"))
