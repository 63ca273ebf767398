"""Text queries that SQL can express, against DuckDB."""

import duckdb
import pytest

queries = pytest.importorskip("tarnlake.llm.queries")

SF = "/root/testdata/sf0.001"


def compare(spark, sf, name, files="{}.parquet"):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{files.format(t)}')")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, SF, name)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty values, words parted by no-break spaces, capitals beyond A-Z, copies, and vectors that link with nothing."""
    nan, inf = float("nan"), float("inf")
    text = "One two THREE four five six seven eight nine ten"
    texts = [None, "", " \t\n", "one two", "ONE  TWO", "one two three", text, text.upper(), text + " eleven", "a b c d e", "Ä b c d e", "ä b c d e", "x " * 3000, "x " * 4, "x " * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [None, [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [-1.0, 0.0], [0.0, 3.0], [1.0, 0.6]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = [None, "", "<p>", "<p>", "é中", "<p>", ""]
    spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in sorted(queries.ORACLE_SQL):
        compare(spark, str(tmp_path), name, "{}.parquet/*.parquet")
