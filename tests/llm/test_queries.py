"""Queries run, and those with SQL equal it."""

import duckdb
import pytest

from quire.llm import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    own = queries.queries()[name](spark, sf_dir)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(own.columns)
    assert sorted(map(str, map(tuple, own.select(*names).collect()))) == sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_gives_rows_of_every_document(spark, sf_dir, name):
    own = queries.queries()[name](spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert own.count() == documents or name.startswith(("op1_", "op12_"))
