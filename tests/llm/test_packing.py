import random
import zlib

import numpy as np
import pytest

from quire.llm import packing
from quire.llm._tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


def filled(entries, counts, capacity):
    """Expands a plan piece by piece: bin -> [(offset, length)]."""
    by, bins = {}, {}
    for length, rank, first, each, offset in entries:
        by.setdefault(length, []).append((rank, first, each, offset))
    for length, n in counts:
        for r in range(n):
            rank, first, each, offset = max(e for e in by[length] if e[0] <= r)
            bins.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_within_capacity(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 100])
    counts = [(n, r.randint(1, 40)) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity))]
    entries, total = packing.plan(counts, capacity)
    bins = filled(entries, counts, capacity)
    assert sorted(bins) == list(range(total))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert sum(len(x) for x in bins.values()) == sum(n for _, n in counts)
    least = max(-(-sum(a * b for a, b in counts) // capacity), sum(b for a, b in counts if 2 * a > capacity), sum(b for a, b in counts if 3 * a > capacity) // 2)
    assert total <= 1.4 * least + 2


def test_plan_edges():
    assert packing.plan([]) == ([], 0)
    assert packing.plan([(5, 0)]) == ([], 0)
    assert packing.plan([(1024, 3)])[1] == 2
    assert packing.plan([(2048, 4), (1, 2048)])[1] == 5
    with pytest.raises(ValueError):
        packing.plan([(2049, 1)])


def check(rows, docs, capacity):
    e = encoder(vocabulary_path())
    want = {}
    for name, text in docs:
        ids = np.array([*e.library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(name, []).append(ids)
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["piece"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen.keys() == want.keys()
    for name, texts in want.items():
        expected = sorted((a, len(x[a : a + capacity]), zlib.crc32(x[a : a + capacity]), a // capacity) for x in texts for a in range(0, len(x), capacity))
        assert sorted(seen[name]) == expected
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_hostile_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "It's <|endoftext|> naïve №5"), (4, "x"), (None, "y"), (5, "Ünïcode ΣΑΣ İ é    done!!")] + [(i, "same words here") for i in range(10, 60)] + [(70, "again and again")] * 9 + [(71, "long " * 700)] * 3 + [(None, "y")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as sequence_id")
    for capacity in (2048, 50):
        check(packing.pack(df, capacity=capacity).collect(), docs, capacity)
    assert packing.pack(df.limit(0)).count() == 0


def test_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op6_best_fit_packing(spark, SF).collect()
    check(rows, docs, 2048)
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-tokens // 2048) + 1
