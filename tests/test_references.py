"""Pages whose titles end within a reference, or hold one that SQL does not read: each query gives the rows of its SQL."""

import duckdb
import pytest

from pagequarry.plans import all_queries

QUERIES, ORACLES = all_queries()
SF = "/root/testdata/sf0.001"
ENDS = "&quot &quot; &quo &lt &lt; &gt &#39 &#39; &amp &amp; &am & &&& &copy &copy; &middot &nbsp; &eacute &Eacute;x &#233; &#x41 &notit; &ampx &unknown;".split()


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """The pages with another end to each title and heading."""
    folder = tmp_path_factory.mktemp("cut")
    duckdb.execute(f"""COPY (SELECT page_id, url, replace(replace(html, '</title>', e || '</title>'), '</h1>', e || '</h1>') AS html
     FROM (SELECT *, CAST({ENDS!r} AS VARCHAR[])[page_id % {len(ENDS)} + 1] AS e FROM '{SF}/pages.parquet')) TO '{folder}/pages.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["page_metadata", "absolutify_urls", "clean_html", "preclean_html"])
def test_references_are_those_of_the_sql(spark, cut, name):
    df = QUERIES[name](spark, cut)
    got = {r["page_id"]: r for r in df.collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{cut}/pages.parquet'")
    names = [x[0] for x in c.execute(f"DESCRIBE {ORACLES[name]}").fetchall()]
    want = [dict(zip(names, r)) for r in c.execute(ORACLES[name]).fetchall()]
    assert len(got) == len(want) >= 2 * len(ENDS)
    assert [r for r in want if got[r["page_id"]].asDict() != r] == []
