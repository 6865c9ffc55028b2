"""Small tables with the awkward cases every operator must stand."""

import duckdb

SF = "/root/testdata/sf0.001"
ODD = [(900001, None), (900002, ""), (900003, "   \n\t "), (900004, "one two"), (900005, "One two"), (900006, "x" * 30_000), (900007, "a b c d e f g " * 4000), (900008, "naïve ▁ 日本語 \U0001f600 \x00 end"), (900009, "@ . + +1 1.2.3 a@b 4 4")]


def documents(limit: int = 200) -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {limit}").fetchall()


def frame(spark, rows, extra: bool = True):
    """A documents table; repeated rows, and extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "0 AS id", "1 AS size", "2 AS rep", "'x' AS n_words", "3 AS bits") if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
