"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import dropped, spread_join, stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node in ``links`` (columns a, b).

    Rounds of large-star and small-star contraction: first every larger
    neighbour of a node, then every smaller one, is linked to the least node
    around instead. Links shrink to stars in a number of rounds that grows with
    the logarithm of the longest path. Every round is written to the shared
    folder, so lost executors do not cost earlier rounds; a hub with many links
    is spread. No links or labels go to the driver, only their number and a
    checksum.
    """
    spark = links.sparkSession
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).union(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = spread_join(both, least, ["u"], "c", F.col("v"), 2 * state[0]).where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("c"))
        moved = spread_join(large, least, ["high"], "c", F.col("low"), state[0])
        small = moved.select(F.col("low").alias("high"), F.col("m").alias("low")).where("high <> low").union(least.select("high", F.col("m").alias("low"))).distinct()
        after = stored(small, "links")
        dropped(spark, now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select(F.col("low"), F.col("low")).distinct())
