import random
import re

import duckdb
import pytest

from quire.llm import url_filter as uf

SF = "/root/testdata/sf0.01"


def plain(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[2].translate(str.maketrans(uf.UPPER, uf.LOWER)), m[3]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(db.execute(uf.OP7_SQL).fetchall(), key=str)
    got = sorted(map(tuple, uf.op7_url_filters(spark, SF).collect()), key=str)
    assert got == want and len({r[3] for r in got}) == 5


@pytest.mark.parametrize("error", [None, 0.5, 0.3])
def test_cascade_is_exact_on_its_universe(spark, error):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7]
    cascade = uf.build(listed, spark.createDataFrame([(k,) for k in keys], "key string"), error)
    assert error is None or len(cascade.levels) > 3
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", *uf._hashes(uf.F.col("key"))).toPandas()
    got = set(rows["key"][cascade.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy())])
    assert got == set(listed)


@pytest.mark.parametrize("error", [None, 0.5])
def test_judge_equals_brute_force(spark, error):
    r = random.Random(3)
    name = lambda: ".".join(r.choice(["a", "b", "net", "org", "x"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice(["a", "b/", "en/", "/"]) for _ in range(r.randint(0, 3)))
    rules = list({(h, p): (r.choice(["block", "allow"]), h, p) for h, p in [(name(), path()) for _ in range(60)]}.values())
    urls = [f"http://{name()}{path()}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for row in uf.judge(df, rules, error).collect():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == plain(row["url"], rules)


def test_hostile_rows(spark):
    urls = [None, "", "no scheme.net/", "http://", "://net/", "http://NET", "http://net/", "HTTP://A.B.Net/x?y#z", "http://example.net/en/?q", "http://example.net/en", "https://www.example.com/de/a://b", "http://xnet/", "http://org/fr/", "http://.net/", "a\nb://c.org/fr/\nd", "http://É.net/é", "http://a.net?x=/", "http://" + "a." * 50_000 + "net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://net/"), (6, "http://net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'r' as rule", "1 as key", "2 as h1")
    got = uf.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], uf.RULES)
    assert uf.judge(df.limit(0)).count() == 0
    assert {(r["rule"], r["verdict"]) for r in uf.judge(df, []).collect()} == {(None, "allow")}
