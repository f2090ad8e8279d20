import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import simhash
from quire.llm._graph import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, most=4):
    """prints: key -> fingerprint; key -> smallest key reachable."""
    keys, root = sorted(prints), {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    f = np.array([prints[k] for k in keys], dtype=np.uint64)
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= most) + i + 1:
            a, b = find(keys[i]), find(keys[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_fingerprint():
    for text in (None, "", " \t\n", "A", "one Two", "a b c d", "É É É É é", "a\x0bb\x0cc d e f", "x " * 9999, "to be or not to be that is the question " * 3):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_links_equal_brute_force(spark, part_rows):
    r = random.Random(part_rows)
    prints = [r.getrandbits(64) for _ in range(600)]
    for seed in prints[:6] + [0, 2**64 - 1]:
        for _ in range(60):
            x = seed
            for b in r.sample(range(64), r.randint(0, 7)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    want = plain_components(dict(zip(prints, prints, strict=True)))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = {r["v"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df, part_rows=part_rows)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(found.get(p, p), set()).add(p)
    expected = {}
    for p in prints:
        expected.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 - i, 5000) for i in range(1, 30)] + [(7, 7), (300, 301), (301, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {5000 - i: 4971 for i in range(30)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hostile_rows(spark):
    docs = [(None, "one two three four five"), (9, "one two three four five"), (3, None), (4, ""), (4, ""), (5, " \n"), (7, "w " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root")
    rows = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert sorted((r[0] or 0, r[2]) for r in rows) == [(0, 9), (3, 3), (4, 3), (4, 3), (5, 3), (7, 7), (9, 9)]
    assert {r[1] for r in rows if r[0] in (3, 4, 5)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(None, "other words than those above, so alone", 1, 2), (None, "other words than those above, so alone", 1, 2), (9, "yet other words under a number that is there", 1, 2)], df.schema))
    kept = simhash.keep_one(more)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in kept.collect()) == [(0, "oth"), (3, ""), (7, "w w"), (9, "one"), (9, "yet")]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_query(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    prints = {k: plain_fingerprint(t) for k, t in docs.items()}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_near_duplicates(spark, SF).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in docs}
