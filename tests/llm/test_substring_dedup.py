import hashlib
import random

import duckdb
import numpy as np
import pytest

from quire.llm import substring_dedup as sub

SF = "/root/testdata/sf0.01"


def brute(docs, window):
    """(doc_id, kept words, n, removed) of documents in order, by a table of all windows as tuples."""
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen, out = set(), []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if (key := tuple(w[i : i + window])) in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((d, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone)))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3]))


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(db.execute(sub.OP13_SQL).fetchall())
    got = sorted(map(tuple, sub.op13_substring_dedup(spark, SF).collect()))
    assert got == want
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("seed,vocabulary,window,mer,frequent", [(1, 2, 5, 2, 1_000_000), (2, 30, 6, 3, 1_000_000), (3, 3, 20, 6, 40), (4, 2, 8, 2, 3), (5, 1, 7, 3, 1_000_000)])
def test_equals_brute_force(spark, seed, vocabulary, window, mer, frequent):
    """Small vocabularies, where runs are frequent, minimisers tie and texts have periods; few and many buckets."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))) for _ in range(6)]
    docs = []
    for d in range(120):
        text = " ".join(str(rng.randrange(vocabulary)) for _ in range(rng.randint(0, 60)))
        docs.append((d, f"{text} {rng.choice(shared)} {rng.choice(shared)}" if rng.random() < 0.6 else text))
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").repartition(5)
    for bucket_words in (20, 1_000_000):
        got = sub.remove_repeats(df, window, mer, bucket_words, frequent).select("doc_id", "text", "n_words", "n_removed").collect()
        assert in_order(got) == in_order(brute(docs, window))


def test_hostile_rows(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = [(1, f"start {passage} end"), (2, passage.replace(" ", "\n\t ")), (3, None), (4, ""), (5, " \n "), (6, " ".join(["same"] * 3000)), (7, "naïve № " * 30), (8, f"W0 {passage[3:]}"), (9, "short")]
    late = [(None, f"x {passage}"), (None, None), (-3, "before all others")]
    df = spark.createDataFrame(docs[::-1] + late, "doc_id int, text string").selectExpr("*", "1 as tag", "2 as gone", "3 as n_words", "4 as bucket").repartition(3)
    out = sub.remove_repeats(df)
    assert out.schema["doc_id"].dataType.simpleString() == "int"
    by = {(r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in out.collect()}
    assert len(by) == len(docs) + len(late)
    assert {(1, f"start {passage} end", 27, 0), (2, "", 25, 25), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "same", 3000, 2999), (8, "W0", 25, 24), (9, "short", 1, 0)} <= by
    assert {(None, "x", 26, 25), (None, "", 0, 0), (-3, "before all others", 3, 0)} <= by
    assert sub.remove_repeats(df.limit(0)).count() == 0


def test_rows_that_repeat(spark):
    """Of equal rows one stays whole; rows of one doc_id are ordered by a hash, so one of two that share a passage keeps it."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, passage)] * 5 + [(2, "few words only")] * 3 + [(3, f"a {passage} b")] * 2 + [(4, " ".join(f"v{i}" for i in range(40))), (4, " ".join(f"v{i}" for i in range(1, 41)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = [tuple(r) for r in sub.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()]
    assert sorted(r for r in rows if r[0] == 1) == [(1, 30, 0)] + [(1, 30, 30)] * 4
    assert [r for r in rows if r[0] == 2] == [(2, 3, 0)] * 3
    # the second of two equal rows loses every word under a window, own ones too
    assert sorted(r for r in rows if r[0] == 3) == [(3, 32, 30), (3, 32, 32)]
    assert sorted(r[2] for r in rows if r[0] == 4) == [0, 39]


def test_very_long_text(spark):
    """A text over the size of a slice is cut into segments, which share no window and miss none."""
    rng = random.Random(7)
    words = [str(rng.randrange(10**9)) for _ in range(900_000)]
    words[800_000:800_050] = words[100:150]
    text = " ".join(words)
    assert len(text) > sub.SLICE_BYTES
    df = spark.createDataFrame([(2, text), (1, " ".join(words[500_000:500_100]))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sub.remove_repeats(df).collect()}
    assert (rows[1]["n_removed"], rows[2]["n_words"], rows[2]["n_removed"]) == (0, 900_000, 150)
    assert hashlib.md5(rows[2]["text"].encode()).digest() == hashlib.md5(" ".join(words[:500_000] + words[500_100:800_000] + words[800_050:]).encode()).digest()
    parts = list(sub._segments(b"  a b\tc\nd e  ff ", 2, size=3))
    assert len(parts) > 2 and all(p == [b"a", b"b", b"c", b"d", b"e", b"ff"][n : n + len(p)] for n, p in parts)
    ends = [n + len(p) for n, p in parts]
    assert ends[-1] == 6 and all(n == max(0, e - 2) for (n, _), e in zip(parts[1:], ends, strict=False))


def test_equal_hashes_of_different_windows():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2, 400)
    at = np.arange(400 - 5)
    kinds = {}
    want = [kinds.setdefault(tuple(ids[i : i + 5]), i) for i in at]
    assert sub.first_equal(ids, at, np.zeros(len(at), np.uint64), 5).tolist() == want
    assert sub.first_equal(ids, at, sub.rolling(sub.mix(ids.astype(np.uint64)), 5)[at], 5).tolist() == want


def test_strings_travel_not_windows(spark):
    """Words go out some three times; no minimiser is frequent where one line of few words is in every text."""
    rng = random.Random(3)
    line = "our newsletter comes on every second monday of the month"
    docs = [(d, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(60)), line, *(f"w{rng.randrange(10**6)}" for _ in range(60))])) for d in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0L as tag").repartition(4)
    hot = [r["mer"] for r in df.mapInArrow(sub._count(64 * 4, sub.WINDOW, sub.MER), "mer long, n long").groupBy("mer").sum("n").where("mer is not null and `sum(n)` * 256 > 52000").select("mer").collect()]
    assert len(hot) == 10 - sub.MER + 1  # runs within ten words
    frequent = np.sort(np.array(hot, dtype=np.int64).view(np.uint64))
    part = sub._Slice(__import__("pyarrow").array(" ".join(t for _, t in docs).split()), np.array([len(t.split()) for _, t in docs]), sub.WINDOW, sub.MER)
    key = part.keys(frequent)[part.places(sub.WINDOW)]
    assert not np.isin(key, frequent).any()
    assert 1 + (key[1:] != key[:-1]).sum() < len(key) / 6
    assert np.unique(key, return_counts=True)[1].max() < 40
