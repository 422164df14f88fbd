"""Tables of a page: ruled ones claim their lines, the rest may form tables without rules by their alignment.

A table without rules is a run of three or more neighbouring lines that have as
many segments each, at the left or right edges of the first. Lists and tables of
contents are aligned as well and are told by their texts.

Lines that can be in one run (unclaimed, as many segments as the one before, near
it) form an island, which has its own key; how far a run reaches from each line
does not depend on other runs, so only the choice among them goes in order. The
work on an island grows with the square of its lines, which stand one under
another on one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import list_marker, page_reference, trimmed
from quire.operators.folds import ranked

#: How far an edge may be off, in points and in sizes; the room between lines, in sizes and in points; the
#: least lines of a table, and the most that the first segment of a list is wide, in sizes; the least width of a column.
EDGE, EDGE_SIZES, ROOM_SIZES, ROOM, LEAST_LINES, MARKER_SIZES, LEAST_CELL = 5.0, 0.9, 2.6, 14.0, 3, 3.0, 6.0
#: Fixed value: what the first segment of a list may be besides a marker.
SHORT = r"^\(?[0-9A-Za-z]{1,3}[.)]?$"
#: The least lines that a ruled grid takes, and how far from it their middles may be.
LEAST_CLAIMED, SLACK = 2, 2.0


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with text, and num, their number from the top of the page."""
    some = lines.where(F.exists("segments", lambda s: F.coalesce(trimmed(s.text) != "", F.lit(False))))
    return ranked(some, ["page"], ["y0", "line_id"], "num")


def claimed(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """page, grid, line_id of the numbered lines that a ruled grid (page, grid, x0, y0, x1, y1) takes.

    A grid takes the lines whose middle is inside, if there are two or more and
    no other line stands between them. A line inside of several grids counts
    for the first.
    """
    g = grids.select("page", "grid", *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    l = lines.select("page", "line_id", "num", "y0", "y1", F.col("segments")[0].x.alias("left"), F.element_at("segments", -1).x_end.alias("right"))  # noqa: E741
    middle, centre = (F.col("y0") + F.col("y1")) / 2, (F.col("left") + F.col("right")) / 2
    inside = l.join(g, "page").where(middle.between(F.col("g_y0") - SLACK, F.col("g_y1") + SLACK) & centre.between(F.col("g_x0") - SLACK, F.col("g_x1") + SLACK))
    first = inside.groupBy("page", "line_id").agg(F.min("grid").alias("grid"), F.first("num").alias("num"))
    whole = first.groupBy("page", "grid").agg(F.count("*").alias("n"), (F.max("num") - F.min("num") + 1).alias("span")).where(f"n = span AND n >= {LEAST_CLAIMED}")
    return first.join(whole, ["page", "grid"], "left_semi").select("page", "grid", "line_id")


def _near(a: Column, b: Column, edge: Column) -> Column:
    return F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (F.abs(p.a.x - p.b.x) <= edge) | (F.abs(p.a.x_end - p.b.x_end) <= edge))


def _islands(lines: DataFrame, taken: DataFrame) -> DataFrame:
    """page, island and rows (num, y0, y1, size, cells, mark, above) of lines that may be in one run."""
    free = lines.join(taken.select("page", "line_id"), ["page", "line_id"], "left_anti")
    text = lambda s: F.coalesce(trimmed(s.text), F.lit(""))
    plain = lambda s: trimmed(F.regexp_replace(text(s), "\b", ""))
    cells = F.transform("segments", lambda s: F.struct(s.x.alias("x"), s.x_end.alias("x_end"), text(s).alias("text"), page_reference(plain(s)).alias("number"), ((plain(s) != "") & ~page_reference(plain(s))).alias("title")))
    free = free.select("page", "num", "y0", "y1", "size", cells.alias("cells"), F.size("segments").alias("n")).where("n > 1")
    first = F.col("cells")[0]
    mark = (F.col("n") == 2) & (list_marker(first.text) | first.text.rlike(SHORT))
    order = Window.partitionBy("page").orderBy("num")
    room = F.greatest(F.max("size").over(Window.partitionBy("page")) * ROOM_SIZES, F.lit(ROOM))
    above = F.col("y0") - F.lag("y1").over(order)
    free = free.withColumn("mark", mark).withColumn("above", F.coalesce(above, F.lit(0.0)))
    goes_on = (F.col("num") - F.lag("num").over(order) == 1) & (F.lag("n").over(order) == F.col("n")) & (above < room)
    free = free.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("num")))
    free = free.withColumn("island", F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("num", "y0", "y1", "size", "cells", "mark", "above")))
    return free.groupBy("page", "island").agg(rows.alias("rows")).where(F.size("rows") >= LEAST_LINES)


def _reach(rows: Column, i: Column) -> Column:
    """How many lines from line i of an island on are aligned with it."""
    head, rest = F.get(rows, i), F.slice(rows, i + 2, F.size(rows))
    edge, room = F.greatest(F.lit(EDGE), head["size"] * EDGE_SIZES), F.greatest(head["size"] * ROOM_SIZES, F.lit(ROOM))
    stops = F.transform(rest, lambda r: (r.above >= room) | ~_near(r.cells, head.cells, edge))
    return F.coalesce(F.nullif(F.array_position(stops, True).cast("int"), F.lit(0)), F.size(rest) + 1)


def _is_table(rows: Column, i: Column, n: Column) -> Column:
    """Whether the n lines from line i on are a table: long enough, no list, no contents, and no columns that overlap."""
    head, run = F.get(rows, i), F.slice(rows, i + 1, n)
    listed = (head.cells[0].x_end - head.cells[0].x <= head["size"] * MARKER_SIZES) & F.forall(run, lambda r: r.mark)
    columns = F.sequence(F.lit(1), F.size(head.cells) - 1)
    contents = F.exists(columns, lambda k: F.forall(run, lambda r: F.get(r.cells, k).number & F.get(r.cells, k - 1).title))
    reach = lambda k: F.array_max(F.transform(run, lambda r: F.get(r.cells, k - 1).x_end))
    overlap = F.exists(columns, lambda k: F.array_min(F.transform(run, lambda r: F.get(r.cells, k).x)) <= reach(k))
    return (n >= LEAST_LINES) & ~listed & ~contents & ~overlap


def tables(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """page, first (its number on the page), row, col, x0, y0, x1, y1, text of the cells of tables without rules.

    ``lines`` have page, line_id, y0, y1, size and segments (x, x_end, text) from
    left to right. Columns meet half way between their segments, rows half way
    between their lines. Lines that ``grids`` claim, or without text, take no
    part; null texts count as empty. Ids of lines must be unique on a page.
    """
    own = numbered(lines)
    r = F.col("rows")
    reaches = F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(i.alias("i"), _reach(r, i).alias("n")))
    found = _islands(own, claimed(own, grids)).withColumn("reaches", reaches).withColumn("runs", F.filter("reaches", lambda p: _is_table(r, p.i, p.n)))
    # the choice among runs: a line inside of a table begins no other
    step = lambda a, p: F.when(p.i < a.until, a).otherwise(F.struct((p.i + p.n).alias("until"), F.concat(a.chosen, F.array(p)).alias("chosen")))
    start = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<i:int,n:int>>").alias("chosen"))
    chosen = found.select("page", "rows", F.explode(F.aggregate("runs", start, step, lambda a: a.chosen)).alias("t"))
    run = chosen.select("page", F.slice("rows", F.col("t.i") + 1, F.col("t.n")).alias("rows"))
    last = F.size(F.col("rows")[0].cells) - 1
    left = lambda k: F.array_min(F.transform("rows", lambda r: F.get(r.cells, k).x))
    right = lambda k: F.array_max(F.transform("rows", lambda r: F.get(r.cells, k).x_end))
    inner = F.transform(F.sequence(F.lit(1), last), lambda k: (right(k - 1) + left(k)) / 2)
    run = run.withColumn("xs", F.concat(F.array(left(F.lit(0))), inner, F.array(right(last))))
    parts = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: (F.get("rows", i - 1).y1 + F.get("rows", i).y0) / 2)
    run = run.withColumn("ys", F.concat(F.array(F.col("rows")[0].y0), parts, F.array(F.element_at("rows", -1).y1)))
    rows = run.select("page", F.col("rows")[0].num.alias("first"), "xs", "ys", F.posexplode("rows").alias("row", "r"))
    cells = rows.select("page", "first", "row", "xs", "ys", F.posexplode("r.cells").alias("col", "c"))
    return cells.select("page", "first", "row", "col", F.get("xs", "col").alias("x0"), F.get("ys", "row").alias("y0"), F.get("xs", F.col("col") + 1).alias("x1"), F.get("ys", F.col("row") + 1).alias("y1"), "c.text")
