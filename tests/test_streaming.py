"""Progress of streams as a table."""

import pytest
from pyspark.sql import functions as F

from quire.streaming import ingest, reported


def test_progress_of_ingestion(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    with reported(spark, expected=90) as progress:
        ingest(spark, str(tmp_path / "in"), source.schema, lambda d: d.withColumn("x", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "at"), files_per_batch=1)
    rows = progress.table(spark).collect()
    batches = [r for r in rows if r.batch is not None and r.rows]
    assert [r.batch for r in batches] == [0, 1, 2] and sum(r.rows for r in batches) == 90
    assert [r.rows_so_far for r in batches][-1] == 90 and [r.percent for r in batches] == sorted(r.percent for r in batches)
    assert all(r.percent <= 99 for r in batches) and rows[0].message == "started"
    assert (rows[-1].message, rows[-1].percent) == ("ended", 100.0)
    assert len({r.query for r in rows}) == 1


def test_progress_of_a_stream_that_fails(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def broken(batch):
        raise ValueError("no such page")

    with reported(spark) as progress, pytest.raises(Exception, match="no such page"):
        ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, broken, str(tmp_path / "out"), str(tmp_path / "at"))
    assert progress.rows[-1][5].startswith("failed: ") and progress.rows[-1][4] is None
