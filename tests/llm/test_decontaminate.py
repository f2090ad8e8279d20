import random

import numpy as np
import pytest

from quire.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@pytest.mark.parametrize("seed", range(40))
def test_myers_equals_brute_force(seed):
    r = random.Random(seed)
    pattern = "".join(r.choice("ab c") for _ in range(r.randint(1, 90)))
    text = "".join(r.choice("ab c") for _ in range(r.randint(0, 120)))
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    d, end = plain_distance(pattern, text)
    for most in (0, d - 1, d, d + 1, 200):
        got = dc.least_distance(pattern, masks, text, most)
        want = (d, end) if d <= most and (d < len(pattern) or end) else None
        if d == len(pattern):  # the empty part: any end will do
            assert got is None or got[0] == d
        else:
            assert got == want


def edited(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = text[:i] + r.choice(["", "q", text[i] + "z"]) + text[i + 1 :]
    return text


def test_search_equals_brute_force():
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(4, 25)))) for i in range(25)]
    searcher = dc.Searcher(items)
    hits = 0
    for i, item in items:
        k = next(x[3] for x in searcher.items if x[0] == [i])
        for n in {0, k // 2, k, k + 1, 2 * k + 2}:
            text = dc.normal(" ".join(word() for _ in range(40)) + " " + edited(r, item, n) + "? " + " ".join(word() for _ in range(40)))
            want = {name for name, t in items if plain_distance(dc.normal(t), text)[0] <= next(x[3] for x in searcher.items if name in x[0])}
            assert {name for names, *_ in searcher.search(text.upper()) for name in names} == want
            hits += len(want)
    assert hits > 50


def test_hostile_rows(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it rests beside the old stone bridge."
    docs = [(1, None), (2, ""), (3, f"so: {item.upper()} ok"), (4, "the quick brown fox jumps over the lazy cat"), (None, item.replace("stone", "stome")), (5, "word " * 100_000 + item), (5, "word " * 100_000 + item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as distance")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, ""), (11, "too short")], "item_id long, text string").selectExpr("*", "3 as doc_id")
    rows = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in dc.occurrences(df, items).collect())
    assert rows == [(0, 7, 1), (0, 8, 1), (3, 7, 0), (3, 8, 0), (5, 7, 0), (5, 7, 0), (5, 8, 0), (5, 8, 0)]
    assert rows == sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in dc.occurrences(df, items, block_chars=20).collect())
    kept = dc.decontaminate(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert dc.occurrences(df, items.limit(0)).count() == 0 and dc.decontaminate(df, items.limit(0)).count() == len(docs)
    assert dc.occurrences(df.limit(0), items).count() == 0


@pytest.mark.parametrize("size", range(1, 40))
def test_every_length_has_its_whole_budget(size):
    """Items of any length are found with as many edits as the rate allows; without an edit as whole words only."""
    r = random.Random(size)
    item = dc.normal("".join(r.choice("abcdefgh ") for _ in range(3 * size)).strip())[:size].strip() or "a"
    k = int(len(item) * dc.ERROR_RATE)
    searcher = dc.Searcher([(1, item)])
    assert [x[3] for x in searcher.items] == [k]
    for n in range(2 * k + 3):
        text = dc.normal(f"xx yy {edited(r, item, n)} zz")
        want = plain_distance(item, text)[0] <= k if k else f" {item} " in f" {text} "
        assert bool(searcher.search(text)) == want
    assert bool(searcher.search(f"x{item}y")) == (k > 0)


def least_distances(items, text):
    """Of each item to any part of text: Sellers' table, a row of all items at a time."""
    width = max(map(len, items))
    codes = np.zeros((len(items), width), dtype=np.int32)
    for i, x in enumerate(items):
        codes[i, : len(x)] = [ord(c) for c in x]
    at, last = np.arange(width + 1), (np.arange(len(items)), np.array([len(x) for x in items]))
    now = np.broadcast_to(at, (len(items), width + 1)).copy()
    best = now[last].copy()
    for c in text:
        new = np.minimum(now[:, 1:] + 1, now[:, :-1] + (codes != ord(c)))
        now = np.minimum.accumulate(np.concatenate([np.zeros((len(items), 1), new.dtype), new], axis=1) - at, axis=1) + at
        best = np.minimum(best, now[last])
    return best


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [(i, dc.normal(t)) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.op8_benchmark_decontamination(spark, SF).collect()}
    want = {}
    for d, t in docs:
        for (i, x), n in zip(items, least_distances([x for _, x in items], dc.normal(t)).tolist(), strict=True):
            if n <= int(len(x) * dc.ERROR_RATE):
                want[d, i] = n
    assert got == want and got
