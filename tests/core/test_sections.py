"""Texts as bodies of Markdown sections: the SQL has three sections for each document, whatever its text looks like."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexiflume.operators import chunking

TEXTS = ["plain", "### junk\nword", "a\n# b\n#### c d", "", "   ", "\\# kept\n\\\\## both", "#\nx", "# \n\n# y\r# z", "\n", "[clause] 1 a\n[clause] 2 b", "#\ttab \n  # in"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, ("en", "de")[i % 2], f"src{i}", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["C01", "C07", "S01"])
def test_a_text_is_one_section(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tables}/documents.parquet/*.parquet')")
    df = entry.queries()[name](spark, f"file://{tables}")
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(map(str, map(tuple, df.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_headers_split_unless_they_are_text(spark):
    docs = spark.createDataFrame([(1, "# a\n## b\nx\n\n### c\n\n#### d\ny")], "doc_id long, text string")
    assert {(r.chapter, r.article, r.content) for r in chunking.header_split(docs).collect()} == {("b", "d", "y"), ("b", None, "x\n")}
    escaped = docs.select("doc_id", chunking.as_body("text").alias("text"))
    assert [r.content for r in chunking.header_split(escaped, literal=True).collect()] == [docs.first().text]
