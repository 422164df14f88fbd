"""Intermediate tables in the folder that driver and executors share.

That folder is ``spark.checkpoint.dir``. Only a session on one machine, as in
tests, may do without: it gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, which cuts its lineage at files that outlive any executor."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written``, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
