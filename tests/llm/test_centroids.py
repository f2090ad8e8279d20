import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from quire.llm import centroids

SF = "/root/testdata/sf0.01"
COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, clusters=8, rounds=10, dim=64):
    """Lloyd's rounds over Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = [sum(d for _, k, d in found if k == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, min(d, 2**63 - 1), min(per[k], 2**63 - 1), min(sum(per), 2**63 - 1), digest[k]) for i, k, d in found]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = centroids.op12_centroid_clustering(spark, SF)
    assert tuple(got.columns) == COLUMNS
    assert order(got.collect()) == order(db.execute(centroids.OP12_SQL).fetchall())


@pytest.mark.parametrize("seed,clusters,bounds,spread", [(1, 8, None, 3), (2, 12, 3, 40), (3, 5, 1, 1), (4, 3, 2, 2), (5, 1, None, 5), (6, 6, 5, 4)])
def test_equals_brute_force(spark, seed, clusters, bounds, spread):
    """Few distinct components, so that many distances tie; more or fewer bounds than are needed."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-spread, spread + 1) / 1024 for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.clustered(df, clusters=clusters, rounds=6, dim=4, bounds=bounds).collect()
    assert order(got) == order(brute(rows, clusters, 6, 4))


def test_hostile_rows(spark):
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [0.0, -0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.25, 0.5])]
    rows += [rows[5]] * 4 + [(200, [1e9, -1e9, 1e9]), (201, [1e20, 1.0, -3.5])]  # beyond 64-bit squares
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as vector", "3 as distance", "4 as near")
    got = centroids.clustered(df, clusters=4, rounds=5, dim=3).collect()
    assert order(got) == order(brute(rows, 4, 5, 3))
    assert centroids.clustered(df.limit(0), clusters=4, rounds=3, dim=3).count() == 0
    few = df.where("vec_id in (1, 2)")
    assert order(centroids.clustered(few, clusters=4, rounds=3, dim=3).collect()) == order(brute([r for r in rows if r[0] in (1, 2)], 4, 3, 3))


def test_bounds_hold_and_spare_distances():
    """Through many moves of centroids the assignment is that of all distances; most vectors never need them."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 60, (400, 8)) + c for c in rng.normal(0, 900, (12, 8))]).astype(np.int64)
    centres = x[rng.choice(len(x), 24, replace=False)]
    state, count, scanned, free = centroids.scan(x, centres, 6), 6, 0, 0
    for _ in range(15):
        after = np.stack([x[state.own == k].sum(axis=0) // max(1, (state.own == k).sum()) if (state.own == k).any() else c for k, c in enumerate(centres)])
        moved = np.array(centroids._moves(centres.tolist(), after.tolist()))
        centres = after
        state, needed = centroids.settle(x, state, centres, moved, count)
        far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        assert (state.own == far.argmin(axis=1)).all()
        true = np.sqrt(far)
        assert (state.upper >= true[np.arange(len(x)), state.own]).all()
        assert (state.lower <= np.take_along_axis(true, state.near, axis=1) + 1e-6).all()
        rest = true.copy()
        np.put_along_axis(rest, np.concatenate([state.own[:, None], state.near], axis=1), np.inf, axis=1)
        assert (state.rest <= rest.min(axis=1) + 1e-6).all()
        scanned, free = scanned + (needed < 0).sum(), free + (needed == 0).sum()
        if (needed >= 0).any():
            count = min(count, max(1, int(needed.max())))
    assert scanned < 0.2 * 15 * len(x) and free > 0.5 * 15 * len(x)


def test_rounds_leave_one_folder(spark, tmp_path):
    """Bounds adapt, later rounds look at few vectors, and only the last round's table stays."""
    from quire.llm import _base

    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found, centres, log = centroids.cluster(rows)
    assert found.count() == rows.count() and len(centres) == 8 and len(log) == 11
    assert log[0]["moved"] == rows.count() and log[-1]["moved"] < log[1]["moved"] and log[-1]["bounds"] <= log[0]["bounds"]
    folder = found.inputFiles()[0].rpartition("/")[0]
    where, path = _base._place(folder.rpartition("/")[0])
    from pyarrow import fs

    assert [f.base_name for f in where.get_file_info(fs.FileSelector(path))] == ["10"]
