"""Queries against their SQL: on the smallest tables, and on rows with nulls, ties, repetitions and odd texts."""

import os

import duckdb
import pytest

from leafloom.llm import licenses, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def same(spark, name, sf):
    db = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            path = f"{sf}/{f}" if os.path.isfile(f"{sf}/{f}") else f"{sf}/{f}/*.parquet"
            db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    a, b = queries.QUERIES[name](spark, sf), db.execute(queries.SQL[name])
    columns = sorted(a.columns)
    names = [d[0] for d in b.description]
    assert columns == sorted(names)
    rows = lambda found, names: sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found), key=repr)
    return rows(map(tuple, a.collect()), a.columns), rows(b.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_as_its_sql(spark, name):
    a, b = same(spark, name, SF)
    assert len(a) > 0 and a == b


def _odd():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    mit = licenses.TEMPLATES["mit"].split()
    edited = " ".join([*mit[:30], "perhaps", *mit[32:90], "or", "so", *mit[90:]])
    texts = [None, "", "  \n ", "one", "a b\nc d. e", "a b\nc d. e", "c d. e\na b", long, long + " end", "ÉTÉ|été!", "under the MIT license", "x " * 60, "x " * 61, edited, "some " + edited[: len(edited) // 2], " ".join(mit)]
    return [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", [n for n in sorted(queries.SQL) if n != "op10_urls"])
def test_odd_texts_and_repeated_ones(spark, tmp_path, name):
    spark.createDataFrame(_odd(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = same(spark, name, str(tmp_path))
    assert len(a) == len(_odd()) and a == b


def test_fingerprints_of_rows_without_and_with_equal_ids(spark, tmp_path):
    rows = [(i if i % 2 else None, t, *r) for i, t, *r in _odd()] + [(3, f"tie {i}", "en", "s", 5) for i in range(40)] + [(3, "tie 7", "en", "s", 5)] * 3
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = same(spark, "op9_fingerprints", str(tmp_path))
    assert len(a) == len(rows) and a == b


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n != "op10_urls"))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
