import zlib

import numpy as np
import pytest

from quire.llm import _base, token_files
from quire.llm._tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,top", [(0, 1), (1, 65536), (1000, 7), (200_000, 49408)])
def test_shard_answers_as_the_array_does(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) ** 2 // max(top, 1)).astype(np.int64)
    shard = token_files.WaveletShard(token_files.build_shard(ids, [3, None], [n, 0]))
    assert shard.doc_ids == [3, None] and shard.lengths.tolist() == [n, 0]
    assert (shard.decode() == ids).all()
    for i in rng.integers(0, n, 20) if n else []:
        assert shard.access(int(i)) == ids[i]
        t = int(ids[i])
        places = np.flatnonzero(ids == t)
        assert shard.count(t) == len(places)
        assert shard.rank(t, int(i)) == int((places < i).sum())
        k = int(rng.integers(0, len(places)))
        assert shard.select(t, k) == places[k]
    if n == 1000:
        assert shard.find(3) == np.flatnonzero(ids == 3).tolist()
        with pytest.raises(IndexError):
            shard.access(n)
        with pytest.raises(IndexError):
            shard.select(3, n)
    assert shard.count(65000) == int((ids == 65000).sum())


def expected(docs):
    e, at, out = encoder(vocabulary_path()), 0, []
    for name, text in docs:
        ids = np.array([*e.library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((name, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_hostile_rows(spark):
    docs = [(None, "y"), (-5, "minus"), (1, None), (2, ""), (3, "a b c " * 3000), (3, "a b c " * 3000), (3, "a b c " * 3000), (4, "It's <|endoftext|> naïve №5"), (2**60 + 1, "Ünïcode ΣΑΣ İ é    done!!")]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").selectExpr("*", "1 as start", "2 as path")
    manifest = token_files.write_shards(df.repartition(3), _base.new_folder(spark, "t"), shard_tokens=100)
    assert manifest.count() > 1
    rows = token_files.read_shards(manifest).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected(docs)
    assert token_files.token_digests(df.limit(0), _base.new_folder(spark, "t")).count() == 0
    # texts that share a doc_id keep their rows, one behind another, in either order
    texts = ["first text", "another, longer text", "", "first text"]
    several = spark.createDataFrame([(7, t) for t in texts] + [(6, "before"), (8, "behind")], "doc_id long, text string").repartition(4)
    rows = sorted(token_files.token_digests(several, _base.new_folder(spark, "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [6, 7, 7, 7, 7, 8]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    want = sorted((n, crc) for _, _, n, crc in expected([(7, t) for t in texts]))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows[1:5]) == want


def test_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rows = token_files.op9_wavelet_token_files(spark, SF).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected(docs)
