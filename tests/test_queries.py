"""Every query runs, and those with SQL give DuckDB's rows."""

import duckdb
import pytest

from quire import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, con, tmp_path, name):
    own = plans.queries()[name](spark, sf_dir)
    own.write.parquet(str(tmp_path / "own"))
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert spark.read.parquet(str(tmp_path / "own")).count() > 0
        return
    files = f"'{tmp_path}/own/*.parquet'"
    columns = ", ".join(f'"{c}"' for c in sorted(own.columns))
    left, right = f"SELECT {columns} FROM ({sql})", f"SELECT {columns} FROM {files}"
    assert con.execute(f"SELECT count(*) FROM ((({left}) EXCEPT ALL ({right})) UNION ALL (({right}) EXCEPT ALL ({left})))").fetchone() == (0,)
    kinds = lambda q: dict((r[0], r[1]) for r in con.execute(f"DESCRIBE {q}").fetchall())
    assert kinds(left) == kinds(right)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
