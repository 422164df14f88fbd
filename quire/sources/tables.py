"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of texts, and the columns that their rows can be dealt by.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of texts that comes in fewer parts than there are cores is dealt out to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, TEXTS[name])
    return rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows that much work is done on, dealt out by keys: they may be in one part, and small parts would be made one again."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by a hash of its own: rows that a sum has dealt by the keys already would stay as they are, in few parts
    return rows.repartition(parts, F.xxhash64(*keys))
