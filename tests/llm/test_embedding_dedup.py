import math

import numpy as np
import pytest

from quire.llm import embedding_dedup as ed

SF = "/root/testdata/sf0.01"


def brute(rows, limit=0.95):
    """rows: (id, vector); n_links and component of each row number."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    links, root = [set() for _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and len(v) == len(rows[j][1]):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= limit:
                    links[i].add(j)
                    links[j].add(i)
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(len(rows))]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(ed.hadamard(x), x @ h)
    y = ed.rotated(x, 3, 1)
    assert np.allclose(y @ y.T, x @ x.T * 8**3)


def test_recall_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()]
    r = np.random.default_rng(1)
    for k in range(400):  # pairs at and about the limit
        v = r.normal(size=64)
        v /= np.linalg.norm(v)
        w = r.normal(size=64)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = r.uniform(0.93, 0.97)
        rows += [(10_000 + 2 * k, v.tolist()), (10_001 + 2 * k, (c * v + math.sqrt(1 - c * c) * w).tolist())]
    links, root = brute(rows)
    got = {r["vec_id"]: r for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = sum(map(len, links))
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * want <= found <= want
    assert all(got[i]["n_links"] <= len(links[k]) for k, (i, _) in enumerate(rows))
    assert np.mean([got[i]["component_id"] == rows[root[k]][0] for k, (i, _) in enumerate(rows)]) > 0.97


@pytest.mark.parametrize("part_rows", [2000, 3])
def test_hostile_rows(spark, part_rows):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0, -4.0]
    rows = [(1, base), (2, base), (3, [2.0, 4.0, 6.0, -8.0]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 3.0, -4.0]), (8, [nan, 2.0, 3.0, -4.0]), (9, [inf, 2.0, 3.0, -4.0]), (None, base), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1e300, 2e300, 3e300, -4e300]), (13, [-1.0, -2.0, -3.0, 4.0]), (14, [5.0]), (14, [7.0]), (15, [0.0, 1.0, 0.0, 0.0]), (16, [-0.0, 1.0, 0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cls", "2 as n", "3 as label", "4 as kept")
    got = sorted(map(tuple, ed.near_duplicates(df, part_rows=part_rows).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), (12, 4, 1, False), (10, 1, 10, True), (11, 1, 10, False), (14, 1, 14, True), (14, 1, 14, True), (15, 1, 15, True), (16, 1, 15, False)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 13)]
    assert got == sorted(want, key=str)
    assert ed.near_duplicates(df.limit(0)).count() == 0
