"""Rows set one under another on pages, each page beginning with the header again.

Where a page ends depends on where it began, so pages follow from each other in
order. But where the page that a row would begin ends follows from prefix sums
of heights alone, for every row at once. That gives each row a pointer to the
next beginning; pointers are then doubled, so the rows that really begin a page
are reached from the first one in as many rounds as the number of pages has
binary digits. A table of any length is dealt out to all tasks in each round.

Heights count in thousandths of a point, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.folds import running
from quire.sources.shared import removed, written

UNITS = 1_000
#: Pages in a band of prefix sums.
BAND_PAGES = 16


def not_above(values: DataFrame, queries: DataFrame, keys: list[str], name: str, band: float) -> DataFrame:
    """``queries`` (``keys``, i, v) with the number of ``values`` (``keys``, v) that are at most v, in place of v."""
    both = values.select(*keys, F.lit(None).cast("long").alias("i"), "v", F.lit(1).alias("w")).union(queries.select(*keys, "i", "v", F.lit(0)))
    return running(both.withColumn("late", 1 - F.col("w")), keys, ["v", "late"], F.col("w"), name, band).where("i is not null").select(*keys, "i", name)


def page_starts(rows: DataFrame, keys: list[str], room: int, band: float) -> DataFrame:
    """``keys`` and i of the rows that begin a page, of rows with i (from 0), before and after (sums of heights).

    A page ends before the row that does not fit into ``room``, but a row of
    more than a point must stand on it.
    """
    full = not_above(rows.select(*keys, F.col("after").alias("v")), rows.select(*keys, "i", (F.col("before") + room).alias("v")), keys, "full", band)
    some = not_above(rows.select(*keys, F.col("before").alias("v")), rows.select(*keys, "i", (F.col("before") + UNITS).alias("v")), keys, "some", band)
    jump = written(full.join(some, [*keys, "i"]).select(*keys, "i", F.greatest("full", "some").alias("to")), "page-ends")
    found = written(rows.where("i = 0").select(*keys, "i"), "page-starts")
    while True:
        # pointers past the last row lead nowhere
        new = written(found.join(jump, [*keys, "i"]).select(*keys, F.col("to").alias("i")).join(rows.select(*keys, "i"), [*keys, "i"], "left_semi"), "page-starts")
        if new.isEmpty():
            removed(jump)
            return found
        found = written(found.union(new), "page-starts")
        ahead = jump.select(*keys, F.col("i").alias("to"), F.col("to").alias("then"))
        doubled = written(jump.join(ahead, [*keys, "to"]).select(*keys, "i", F.col("then").alias("to")), "page-ends")
        removed(jump)
        jump = doubled


def paged(rows: DataFrame, keys: list[str], order: list[str], height: str, page: float, header: float = 0.0, order_band: float = 65_536.0) -> DataFrame:
    """``rows`` with page (from 0) and top, in ``order``, the first column of which is a number.

    A page is ``page`` points high and begins with a header; a row that does not
    fit begins the next one, unless the page is empty yet. Rows that tie in
    ``order`` may change places. Heights are not negative and not null; keys are
    not null.
    """
    room, band = round((page - header) * UNITS), float(max(1, round(page * UNITS)) * BAND_PAGES)
    own = F.round(F.col(height) * UNITS).cast("long")
    numbered = running(rows.withColumn("__h", own), keys, order, F.lit(1), "__i", order_band)
    # the row's own number breaks ties, so that sums follow the same order
    numbered = written(numbered.withColumn("__i", F.col("__i") - 1), "numbered")
    placed = running(numbered, keys, ["__i"], F.col("__h"), "__after", order_band)
    placed = written(placed.withColumn("__before", F.col("__after") - F.col("__h")), "placed")
    removed(numbered)
    bare = placed.select(*keys, F.col("__i").alias("i"), F.col("__before").alias("before"), F.col("__after").alias("after"))
    starts = page_starts(bare, keys, room, band)
    starts = running(starts, keys, ["i"], F.lit(1), "page", order_band).withColumn("page", F.col("page") - 1)
    of_row = not_above(starts.select(*keys, F.col("i").alias("v")), bare.select(*keys, "i", F.col("i").alias("v")), keys, "page", order_band).withColumn("page", F.col("page") - 1)
    first = starts.join(bare, [*keys, "i"]).select(*keys, "page", F.col("before").alias("__start"))
    pages = of_row.join(first, [*keys, "page"]).withColumnRenamed("i", "__i")
    top = F.lit(float(header)) + (F.col("__before") - F.col("__start")) / UNITS
    return placed.join(pages, [*keys, "__i"]).select(*rows.columns, F.col("page").cast("int").alias("page"), top.alias("top"))
