import zlib

import numpy as np
import pytest

from quire.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_features(text):
    text, out = f" {text.lower()} ", set()
    for n in (3, 4, 5):
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = h * 1_000_003 + ord(c)
            out.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 46)
    return sorted(out)


def test_features(monkeypatch):
    for text in ("A", "Ab", "Héllo, wörld 🙂", "abc " * 50):
        assert toxicity.features(text).tolist() == plain_features(text)
    monkeypatch.setattr(toxicity, "CHARS", 7)
    assert toxicity.features("some text that is cut").tolist() == plain_features("some text that is cut")
    assert toxicity.features(None).tolist() == toxicity.features("").tolist() == []


def test_held_out_accuracy(spark):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    test = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    pos, neg = [s for s, t in test if t], [s for s, t in test if not t]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.95
    assert np.mean([s >= 0.5 for s in pos]) > 0.65
    assert np.mean([s >= 0.5 for s in neg]) <= 0.02


def test_fit_equals_dense_fit():
    """The same classifier on a dense table of all features, by plain matrix algebra."""
    r = np.random.default_rng(5)
    rows = [(np.sort(r.choice(400, r.integers(1, 60), replace=False)) * 600 + 7 * label, int(label)) for label in r.integers(0, 2, 40)]
    model = toxicity.Classifier.fit(rows, rounds=25)
    x, y = np.zeros((40, 1 << toxicity.BITS), dtype=np.float64), np.array([label for _, label in rows], dtype=float)
    for i, (f, _) in enumerate(rows):
        x[i, f] = 1
    toxic, clean = x[y > 0].sum(axis=0) + 1, x[y == 0].sum(axis=0) + 1
    x = x / np.sqrt(x.sum(axis=1, keepdims=True)) * np.log((toxic / toxic.sum()) / (clean / clean.sum()))
    w, share = np.zeros(x.shape[1] + 1), np.where(y > 0, 20 / y.sum(), 20 / (40 - y.sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 26):
        miss = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) * share / 40
        g = np.append(x.T @ miss + toxicity.PENALTY * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert [model.margin(f) for f, _ in rows] == pytest.approx((x @ w[:-1] + w[-1]).tolist(), rel=1e-6, abs=1e-9)


def test_cut():
    r = np.random.default_rng(3)
    for n in (2, 10, 500):
        toxic = r.random(n) < 0.3
        toxic[:2] = True, False
        z = r.normal(size=n).round(1) + toxic
        at = toxicity.cut(z, toxic, 0.05)
        found = {c: ((z[toxic] >= c).mean(), (z[~toxic] >= c).mean()) for c in [*np.unique(z), 99.0, at]}
        assert found[at][1] <= 0.05 and found[at][0] - found[at][1] == pytest.approx(max(a - b for a, b in found.values() if b <= 0.05))
    assert toxicity.cut([1.0, 2.0], [True, True]) == toxicity.cut([], []) == 0.0

def test_hostile_rows(spark):
    docs = [(i, "you vile fool " * 3 if i % 2 else "a calm day by the lake") for i in range(60)] + [(100, None), (101, ""), (None, "vile fool"), (3, "x" * 300_000), (3, "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as score", "8 as toxic", "9 as predicted")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int").selectExpr("*", "1 as text")
    model = toxicity.learn(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if (r["doc_id"] or 99) < 60 and len(r["text"]) < 100)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    kept = toxicity.reject_toxic(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id % 2 = 0 and doc_id < 60").count() == 30
    none = toxicity.score(df, toxicity.learn(df, labels.limit(0))).collect()
    assert all(r["score"] == pytest.approx(0.25) and r["predicted"] == 0 for r in none)
    assert toxicity.score(df.limit(0), model).count() == 0
