import sys

import __spark_entry__ as entry
from quire.queries import QUERIES


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(spark, monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
