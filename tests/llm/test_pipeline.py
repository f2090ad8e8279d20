from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, line_dedup, packing, simhash, toxicity
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        steps.append((name, before, {r["doc_id"]: r for r in docs.collect()}))
    assert [s[0] for s in steps] == ["toxicity", "line_dedup", "simhash", "decontaminate"]
    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = steps
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(b) == {i for i, r in a.items() if model.score(r["text"]) < 0.5} and all(b[i] == a[i] for i in b)
    sites = {}
    for r in b.values():
        for line in r["text"].split("\n"):
            x = sites.setdefault(line.strip(" \t\x0b\x0c\r"), (set(), set()))
            x[0].add(r["source"])
            x[1].add(r["text"])
    shared = {x for x, s in sites.items() if len(x) >= line_dedup.MIN_CHARS and min(map(len, s)) >= line_dedup.MIN_SITES}
    assert {i: r["text"] for i, r in c.items()} == {i: "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\x0b\x0c\r") not in shared) for i, r in b.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in c.values())
    groups = plain_components({i: plain_fingerprint(r["text"]) for i, r in c.items()})
    assert set(d) == set(groups.values()) and all(d[i] == c[i] for i in d)
    searcher = decontaminate.Searcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert set(e) == {i for i, r in d.items() if not searcher.search(r["text"])} and len(e) < len(d)
    check(packing.pack(docs).collect(), [(i, r["text"]) for i, r in e.items()], 2048)
    assert simhash.DIFFERENCES == 4


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert 0 < rows.select("doc_id").distinct().count() < 200


HOSTILE = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c", None, "s", None), (2, "a b c", None, "s", None), (3, "own words of a text that no other has " * 5, "en", "s", 190)]
CLASHING = ["score", "predicted", "held_out", "lines_removed", "key", "line", "fingerprint", "component_id", "fp", "root", "item_id", "piece", "length", "sequence_id"]


def test_empty_tables_and_nulls(spark):
    """What each stage leaves of rows with nulls, repeated and empty ones; rows of no words are alike, so one of them stays."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    hostile, kept = spark.createDataFrame(HOSTILE, schema), {}
    for docs in (hostile, hostile.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            kept.setdefault(name, []).append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()))
            if name != "packing":
                assert out.columns == schema.names and [f.dataType for f in out.schema] == [f.dataType for f in schema]
                docs = out
    every = [(False, 1), (False, 2), (False, 2), (False, 3), (True, 0)]
    assert kept["toxicity"] == [every, []] and kept["line_dedup"] == [every, []]
    assert kept["simhash"] == kept["decontaminate"] == kept["packing"] == [[(False, 1), (False, 2), (False, 3)], []]


def test_columns_that_clash(spark):
    """Columns of the stages' own names come through each stage as they are."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(HOSTILE, schema)
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(f"own {i}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 2, 2, 3] and all(r["piece"] == 0 for r in rows)
        else:
            lost = {"toxicity": {"held_out", "score", "predicted"}, "line_dedup": {"lines_removed"}}.get(name, set())
            assert [c for c in docs.columns if c not in lost] == [c for c in out.columns if c not in lost], name
            assert all(r[c] == f"own {i}" for r in rows for i, c in enumerate(CLASHING) if c in out.columns and c not in lost), name
