"""strip_markdown over documents whose last line, or whole text, is but a mark or blank, or that hold what reads as an escape or code: the rows of its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.plans import all_queries

QUERIES, ORACLES = all_queries()
ENDINGS = ["", " ", "\n", "*", "-", "+", "#", "##", ">", "***", "* ", "- ", "> ", "-----", "*-----*", "`", "```", "``", "\\", "\\*", "\\`", "`\\*", "[x](", "![", "__", "~~", " \n ", "$1", "\\1"]


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    texts = [None, *ENDINGS, *(f"word of **one**\n{e}" for e in ENDINGS), *("\n".join(["a _b_ c"] * n + [e]) for n in (3, 5, 8) for e in ENDINGS), *(f"{e}\n*x* y" for e in ENDINGS)]
    folder = tmp_path_factory.mktemp("documents")
    c = duckdb.connect()
    c.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO d VALUES (?, ?, 'en', 's', ?)", [(k, t, len(t or "")) for k, t in enumerate(texts)])
    c.execute(f"COPY d TO '{folder}/documents.parquet'")
    return str(folder)


def test_documents_are_stripped_as_in_sql(spark, documents):
    got = {r["doc_id"]: r["plain"] for r in QUERIES["strip_markdown"](spark, documents).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}/documents.parquet'")
    want = dict(c.execute(f"SELECT doc_id, plain FROM ({ORACLES['strip_markdown']})").fetchall())
    assert len(want) > 150 and {k: (got[k], w) for k, w in want.items() if got[k] != w} == {} and len(got) == len(want)


def test_parts_keep_blanks_at_their_inner_end(spark):
    df = spark.createDataFrame([(" \n# *a* \n ",)], "md string")
    assert [df.select(T.strip_markdown(F.col("md"), t)).first()[0] for t in ("both", "start", "end")] == ["a", "a \n ", " \na"]
