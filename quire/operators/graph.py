"""Connected components and chains of graphs held as tables of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import removed, written


def components(links: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """``keys``, node and component (its least node) for every node of ``links`` (``keys``, a, b), a graph for each key.

    Each round links every larger neighbour of a node, then every smaller one,
    to the least node around instead, until stars are left; their number grows
    with the logarithm of the longest path. Rounds are written to the shared
    folder. Only a count and a checksum of the links go to the driver. Links of
    a node to itself only tell that it is there.
    """
    loops = links.where("a = b").select(*keys, F.col("a").alias("node"))
    now = written(links.where("a <> b").select(*keys, F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    state = _state(now, keys)
    for _ in range(rounds):
        both = now.union(now.select(*keys, "low", "high")).toDF(*keys, "u", "v")
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v <> m").select(*keys, "v", "m").union(least)
        after = written(small.toDF(*keys, "high", "low").distinct(), "links")
        removed(now)
        now, before, state = after, state, _state(after, keys)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(*keys, F.col("high").alias("node"), F.col("low").alias("component"))
    stars = stars.union(now.select(*keys, "low", "low").distinct())
    return stars.union(loops.join(stars.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, "node", "node").distinct())


def _state(links: DataFrame, keys: list[str]) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "high", "low").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def chains(links: DataFrame, most: int = 20) -> DataFrame:
    """id, depth and path of the way from every id along ``links`` (id, base), of ``most`` steps at most; none is walked twice.

    A round takes a step with all ways that still go on, and is written to the
    shared folder; the rows of recursive SQL are bounded, these are not.
    """
    told = lambda c: F.concat(F.lit("/"), F.col(c).cast("string"), F.lit("/"))
    steps = links.select(F.col("id").alias("__next"), F.col("base").alias("__base"))
    now, ended = links.select("id", F.col("base").alias("at"), told("id").alias("path")), []
    for depth in range(most):
        fresh = F.instr(F.col("path"), told("__next")) == 0
        met = written(now.join(steps, (F.col("at") == F.col("__next")) & fresh, "left"), "chains")
        ended.append(met.where("__next is null").select("id", F.lit(depth).alias("depth"), "path"))
        now = met.where("__next is not null").select("id", F.col("__base").alias("at"), F.concat("path", F.col("__next").cast("string"), F.lit("/")).alias("path"))
        if now.isEmpty():
            break
    else:
        ended.append(now.select("id", F.lit(most).alias("depth"), "path"))
    return reduce(DataFrame.union, ended).groupBy("id").agg(F.max("depth").alias("depth"), F.max_by("path", "depth").alias("path"))
