"""Clusters vectors around centroids, exactly, with Drake's adaptive bounds.

Components are integers, floor(scale * x), so distances, sums and means are exact and the result depends on neither layout nor order.  Each vector carries an upper
bound of the distance to its own centroid, lower bounds of the distances to its next nearest ones, in their order, and one lower bound for
all the rest.  When centroids move, bounds give way by as much.  A vector whose upper bound is below all others stays where it is and
no distance is computed; else its own distance is, then those to as few of the next nearest as certify the order, and only when even the rest's
bound is reached are all centroids looked at.  Bounds are kept as floats that are rounded away from certainty, and ties never pass as certain, so the
assignment is the exact one, the smaller number winning ties.  The number of bounds adapts: a round keeps as many as the one before had use for.

A round reads vectors and bounds from the shared folder and writes them again, one map without a shuffle; the round before is deleted once that is done.  Sums change by
vectors that have moved only, added up in their tasks, so a round sends clusters times components numbers from each batch at most, and the driver holds
the centroids alone.

Vectors of another length, or that are null or hold a null or a non-finite component, are left out.  A null vec_id counts as an empty one in the choice of first
centroids; rows with equal vec_ids are ordered by their components there, and stay.  With fewer vectors than clusters each is a centroid.  An empty table gives no rows.
Integers of 2^27 and above are reckoned with Python's own, exactly; distances and their sums beyond a long read as the largest one, and sums must have 38 digits at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

CLUSTERS, ROUNDS, COMPONENTS, SCALE, KEY = 8, 10, 64, 1024, 3
#: Vectors that are reckoned with at a time.
ROWS = 4096
#: Relative slack of bounds, far above the rounding of a double.
SLACK = 1e-9
SMALL = 1 << 27
LONG = 2**63 - 1


def _integers(column, dim: int, scale: int):
    """Rows of floor(scale * x): 64-bit integers where squares of distances fit, else Python's."""
    import numpy as np

    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    if not x.size or np.abs(x).max() < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object)


def _centres(centres: list[list[int]]):
    import numpy as np

    return np.array(centres, dtype=np.int64 if all(abs(v) < SMALL for c in centres for v in c) else object)


def _squares(x, centre):
    """Exact squared distances of rows to a centre, or of each to its own."""
    d = (x - centre) if x.dtype == centre.dtype else (x.astype(object) - centre.astype(object))
    return (d * d).sum(axis=1)


class Bounds:
    """For each of some vectors: own centroid, upper bound; the next nearest ones and lower bounds; a lower bound for the rest."""

    def __init__(self, own, upper, near, lower, rest):
        self.own, self.upper, self.near, self.lower, self.rest = own, upper, near, lower, rest


def scan(x, centres, count: int) -> Bounds:
    """Bounds from all distances, with `count` next nearest ones."""
    import numpy as np

    squares = np.stack([_squares(x, c) for c in centres], axis=1)
    order = np.argsort(squares, axis=1, kind="stable")[:, : count + 2]
    far = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(np.float64))
    own, near = order[:, 0], order[:, 1 : count + 1]
    rest = far[:, count + 1] * (1 - SLACK) if far.shape[1] > count + 1 else np.full(len(x), np.inf)
    return Bounds(own, far[:, 0] * (1 + SLACK), near, far[:, 1 : count + 1] * (1 - SLACK), rest)


def settle(x, bounds: Bounds, centres, moved, count: int):
    """New bounds after centroids moved by the given distances at most, and how many of the next nearest each vector needed; -1 where all centroids were looked at."""
    import numpy as np

    own, near = bounds.own.copy(), bounds.near[:, :count].copy()
    width = near.shape[1]
    # what loses its own bound joins the rest
    rest = np.minimum(bounds.rest, bounds.lower[:, width:].min(axis=1)) if bounds.lower.shape[1] > width else bounds.rest
    rest = (rest - moved.max()) * (1 - SLACK)
    lower = (bounds.lower[:, :width] - moved[near]) * (1 - SLACK)
    upper = (bounds.upper + moved[own]) * (1 + SLACK)
    # least bound of those from the k-th next nearest on
    tail = np.minimum.accumulate(np.concatenate([rest[:, None], lower[:, ::-1]], axis=1), axis=1)[:, ::-1]
    needed = np.zeros(len(x), dtype=np.int64)
    doubt = np.flatnonzero(upper >= tail[:, 0])
    if len(doubt):
        upper[doubt] = np.sqrt(_squares(x[doubt], centres[own[doubt]]).astype(np.float64)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= tail[doubt, 0]]
    if len(doubt):
        ahead = (tail[doubt] <= upper[doubt, None]).sum(axis=1)  # as many come into question, since tail only grows; beyond width, the rest does
        needed[doubt] = np.where(ahead > width, -1, ahead)
        for z in np.unique(ahead[ahead <= width]).tolist():
            rows = doubt[ahead == z]
            some = np.concatenate([own[rows, None], near[rows, :z]], axis=1)
            squares = np.stack([_squares(x[rows], centres[some[:, j]]) for j in range(z + 1)], axis=1)
            order = np.lexsort((some, squares), axis=1) if squares.dtype != object else np.array([sorted(range(z + 1), key=lambda j, s=s, c=c: (s[j], c[j])) for s, c in zip(squares, some, strict=True)])
            some, far = np.take_along_axis(some, order, axis=1), np.sqrt(np.take_along_axis(squares, order, axis=1).astype(np.float64))
            own[rows], upper[rows] = some[:, 0], far[:, 0] * (1 + SLACK)
            near[rows, :z], lower[rows, :z] = some[:, 1:], far[:, 1:] * (1 - SLACK)
    out = Bounds(own, upper, near, lower, rest)
    every = np.flatnonzero(needed < 0)
    if len(every):
        new = scan(x[every], centres, width)
        out.own[every], out.upper[every], out.near[every], out.lower[every], out.rest[every] = new.own, new.upper, new.near, new.lower, new.rest
    return out, needed


def _step(centres: list[list[int]], moved, count: int, dim: int, scale: int, first: bool, kind: str):
    """Vectors with their bounds for these centroids; was: the centroid before, or -1."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c, far = _centres(centres), np.asarray(moved, dtype=np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = _integers(rows.column("vector"), dim, scale)
                if first:
                    b, was, needed = scan(x, c, count), np.full(len(x), -1), np.full(len(x), -1)
                else:
                    was = rows.column("cluster").to_numpy()
                    get = lambda name, kind, n=len(x), rows=rows: rows.column(name).flatten().to_numpy().reshape(n, -1).astype(kind)
                    b, needed = settle(x, Bounds(was.astype(np.int64), rows.column("upper").to_numpy(), get("near", np.int64), get("lower", np.float64), rows.column("rest").to_numpy()), c, far, count)
                edges = pa.array(np.arange(len(x) + 1) * b.near.shape[1], pa.int32())
                near, lower = (pa.ListArray.from_arrays(edges, pa.array(v.ravel(), t)) for v, t in ((b.near, pa.int32()), (b.lower, pa.float64())))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("vector"), pa.array(b.own, pa.int32()), pa.array(was, pa.int32()), pa.array(needed, pa.int32()), pa.array(b.upper), near, lower, pa.array(b.rest)],
                    names=["vec_id", "vector", "cluster", "was", "needed", "upper", "near", "lower", "rest"],
                )

    return run


def _changes(dim: int, scale: int):
    """What the vectors of a batch that have moved add to each component of each cluster, and take away; component -1 is their number."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _integers(batch.column("vector"), dim, scale)
            if x.dtype != object and len(x):  # 2^27 times a batch's rows fits
                x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
            else:
                x = np.concatenate([x, np.ones((len(x), 1), dtype=object)], axis=1)
            out = []
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy()
                for c in np.unique(of[of >= 0]).tolist():
                    for k, v in enumerate(x[of == c].sum(axis=0).tolist()):
                        out.append((c, k if k < dim else -1, Decimal(sign * int(v))))
            if out:
                c, k, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.decimal128(38, 0))], names=["cluster", "component", "value"])

    return run


def _distances(centres: list[list[int]], dim: int, scale: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = _centres(centres)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                own = rows.column("cluster")
                squares = _squares(_integers(rows.column("vector"), dim, scale), c[own.to_numpy()])
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), own, pa.array(np.minimum(squares, LONG).tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, vector of the vectors with so many components, all of them finite."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    vector = F.col("embedding").cast(f"array<{kind}>")
    sound = (F.size(vector) == dim) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", F.when(sound, vector).alias("vector")).where("vector is not null")


def _first(rows: DataFrame, clusters: int, scale: int, key: int) -> list[list[int]]:
    """The vectors with the least hashes of `key`:vec_id, as integers: as many as there are clusters."""
    import math

    drawn = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    best = rows.select(drawn.alias("h"), "vector").orderBy("h", "vector").limit(clusters).collect()
    return [[math.floor(scale * float(v)) for v in r["vector"]] for r in best]


def _moves(before: list[list[int]], after: list[list[int]]) -> list[float]:
    """Distances that centroids moved, or a little more."""
    return [(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5) * (1 + SLACK) for x, y in zip(before, after, strict=True)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = COMPONENTS, scale: int = SCALE, key: int = KEY, bounds: int | None = None) -> tuple[DataFrame, list[list[int]], list[dict]]:
    """Vectors (vec_id, cluster, distance), the last centroids, and a row for each round: bounds kept, vectors that moved, and that had all centroids looked at.

    vectors: vec_id, embedding and any others.  bounds: at first, a quarter of the clusters.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim)
    centres = _first(rows, clusters, scale, key)
    folder = _base.new_folder(spark, "centroids")
    kind, name = rows.schema["vector"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {name}, vector {kind}, cluster int, was int, needed int, upper double, near array<int>, lower array<double>, rest double"
    k = len(centres)
    count = min(max(0, k - 1), max(2, clusters // 4) if bounds is None else bounds)
    sums, sizes = [[0] * dim for _ in range(k)], [0] * k
    moved, log = [0.0] * k, []
    state = rows
    for round_ in range(rounds + 1):
        out = f"{folder}/{round_}"
        state.mapInArrow(_step(centres, moved, count, dim, scale, round_ == 0, kind), schema).write.parquet(out)
        state = spark.read.parquet(out)
        if round_:
            _base.drop_folder(f"{folder}/{round_ - 1}")
        use = state.agg(F.count(F.when(F.col("cluster") != F.col("was"), 1)).alias("moved"), F.count(F.when(F.col("needed") < 0, 1)).alias("scanned"), F.max("needed").alias("needed")).first()
        log.append({"bounds": count, "moved": use["moved"], "scanned": use["scanned"]})
        if round_ == rounds:
            break
        if use["moved"]:
            new = state.where("cluster <> was").select("vector", "cluster", "was").mapInArrow(_changes(dim, scale), "cluster int, component int, value decimal(38,0)")
            for r in new.groupBy("cluster", "component").agg(F.sum("value").alias("value")).collect():  # clusters times components at most
                if r["component"] < 0:
                    sizes[r["cluster"]] += int(r["value"])
                else:
                    sums[r["cluster"]][r["component"]] += int(r["value"])
        after = [[s // n for s in total] if n else old for total, n, old in zip(sums, sizes, centres, strict=True)]
        moved, centres = _moves(centres, after), after
        if round_ and use["needed"] is not None:  # fewer bounds if no vector used them all
            count = min(count, max(1, use["needed"]))
    found = state.select("vec_id", "vector", "cluster").mapInArrow(_distances(centres, dim, scale), f"vec_id {name}, cluster int, distance long")
    return found, centres, log


def clustered(vectors: DataFrame, **ways) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found, centres, _ = cluster(vectors, **ways)
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    total = min(sum(per.values()), LONG)
    table = [(c, min(per.get(c, 0), LONG), total, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres)]
    table = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(_base.table(spark, sf_dir, "embeddings"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = COMPONENTS, scale: int = SCALE, key: int = KEY) -> str:
    floored = "(s - ((s % n) + n) % n) // n"
    out = f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
c0 as materialized (
  select row_number() over (order by h) - 1 as cluster, v as c from (select sha256('{key}:' || vec_id) as h, v from kept order by h limit {clusters}))"""
    near = "select vec_id, any_value(v) as v, min(struct_pack(d := d, cluster := cluster)) as best from (select k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept k, c{r} c) group by vec_id"
    for r in range(rounds):
        out += f""",
a{r} as materialized ({near.format(r=r)}),
c{r + 1} as materialized (
  select o.cluster, coalesce(m.c, o.c) as c from c{r} o left join (
    select cluster, list({floored} order by i) as c from (
      select cluster, i, sum(x)::bigint as s, count(*) as n from (select best.cluster as cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by cluster, i) group by cluster) m using (cluster))"""
    return (
        out
        + f""",
a as materialized ({near.format(r=rounds)})
select vec_id, best.cluster::int as cluster, best.d as distance, (sum(best.d) over (partition by best.cluster))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a join c{rounds} c on c.cluster = best.cluster
"""
    )


OP12_SQL = _sql()
