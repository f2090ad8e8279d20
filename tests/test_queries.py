import os

import duckdb
import pytest

from quire.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose result must differ from the table that they start from.
CHANGED = {"strip_page_numbers", "rejoin_hyphens", "join_paragraphs", "collapse_blanks", "clean_page", "strip_table_styles", "fix_image_paths", "wikilinks_html", "wikilinks_md", "strip_math_spacing", "fix_double_scripts", "header_detection", "epub_line_steps", "postprocess_file"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.columns, [tuple(r) for r in df.collect()]
    assert got[1]
    if name in ORACLE_SQL:
        cursor = db.execute(ORACLE_SQL[name])
        want = [c[0] for c in cursor.description], cursor.fetchall()
        assert rows(*got) == rows(*want)
