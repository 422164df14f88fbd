"""Folds in order over sequences of any length, in Columns.

A fold goes from row to row, each step depending on the ones before. Where two
neighbouring values lie farther apart than any step reaches, nothing is carried
across. ``stretches`` finds these places and gives each stretch between them its
own key, so a fold over a page becomes many small ones, each over the sorted
array of one stretch.

Windows over a whole page would put it into one task. Values are therefore cut
into bands; a window runs inside a band, and what a band needs from the ones
before comes from a table with one row a band. ``running`` adds up and ``ranked``
numbers rows in the same way.

Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a band, in points: about the height of five lines.
BAND = 64.0


def stretches(rows: DataFrame, keys: list[str], value: str, reach: Column, name: str = "stretch", band: float = BAND) -> DataFrame:
    """``rows`` with the value that opens their stretch. A stretch begins where a value is more than the greatest ``reach`` of its keys above the one before."""
    rows = rows.withColumn("__band", F.floor(F.col(value) / band))
    inner, along = Window.partitionBy(*keys, "__band").orderBy(value), Window.partitionBy(*keys).orderBy("__band")
    edges = rows.groupBy(*keys, "__band").agg(F.max(value).alias("__high"), F.max(reach).alias("__own"))
    edges = edges.select(*keys, "__band", F.lag("__high").over(along).alias("__before"), F.max("__own").over(Window.partitionBy(*keys)).alias("__reach"))
    rows = rows.join(edges, [*keys, "__band"])
    gap = F.col(value) - F.coalesce(F.lag(value).over(inner), F.col("__before"))
    rows = rows.withColumn("__opens", F.when(F.coalesce(gap > F.col("__reach"), F.lit(True)), F.col(value)))
    rows = rows.withColumn("__last", F.last("__opens", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    carried = rows.groupBy(*keys, "__band").agg(F.max("__opens").alias("__open"))
    carried = carried.select(*keys, "__band", F.last("__open", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    rows = rows.join(carried, [*keys, "__band"]).withColumn(name, F.coalesce("__last", "__carried"))
    return rows.drop("__band", "__before", "__reach", "__opens", "__last", "__carried")


def running(rows: DataFrame, keys: list[str], order: list[str], weight: Column, name: str, band: float = BAND) -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows up to their own in ``order``, the first column of which is a number. Rows that tie may come either way."""
    rows = rows.withColumn("__band", F.floor(F.col(order[0]) / band)).withColumn("__w", weight)
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy(*keys, "__band").agg(F.sum("__w").alias("__n")).select(*keys, "__band", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum("__w").over(Window.partitionBy(*keys, "__band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, [*keys, "__band"]).withColumn(name, F.col("__before") + own).drop("__band", "__before", "__w")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, band: float = BAND) -> DataFrame:
    """``rows`` with their number from 0 in ``order``, the first column of which is a number."""
    return running(rows, keys, order, F.lit(1), name, band).withColumn(name, (F.col(name) - 1).cast("int"))


def previous(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str, band: float = BAND) -> DataFrame:
    """``rows`` with ``column``, which is never null, of the row before in ``order``, the first column of which is a number."""
    rows = rows.withColumn("__band", F.floor(F.col(order[0]) / band))
    edges = rows.groupBy(*keys, "__band").agg(F.max_by(column, F.struct(*order)).alias("__last"))
    edges = edges.select(*keys, "__band", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__band")).alias("__before"))
    own = F.lag(column).over(Window.partitionBy(*keys, "__band").orderBy(*order))
    return rows.join(edges, [*keys, "__band"]).withColumn(name, F.coalesce(own, F.col("__before"))).drop("__band", "__before")


def upper_medians(rows: DataFrame, keys: list[str], value: str, name: str, band: float = BAND) -> DataFrame:
    """``keys`` and the middle of ``value``, the higher of two."""
    some = ranked(rows.select(*keys, value), keys, [value], "__rank", band)
    middle = rows.groupBy(*keys).agg(F.floor(F.count("*") / 2).cast("int").alias("__rank"))
    return some.join(middle, [*keys, "__rank"]).select(*keys, F.col(value).alias(name))


def folded(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Column, step) -> DataFrame:
    """keys, ``items`` (structs of ``order`` and ``values``, sorted) and ``state`` after ``step(state, item)`` over them."""
    items = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return rows.groupBy(*keys).agg(items.alias("items")).withColumn("state", F.aggregate("items", start, step))


# text


def text_lines(spans: DataFrame) -> DataFrame:
    """page, line (from the top), span_id, size (dominant) and baseline of the line that each span is put into.

    A span joins the line being built if its baseline is near the reference of
    that line, the baseline of its largest span with text; one much smaller, as
    a raised figure is, may lie farther off.
    """
    rows = spans.select("page", "span_id", "x", "baseline", "size", F.length(F.trim("text")).alias("chars"))
    rows = stretches(rows, ["page"], "baseline", F.greatest(F.lit(2.0), F.col("size") * 0.5))
    none = F.lit(None).cast("double")

    def step(line: Column, span: Column) -> Column:
        small, large = F.least(span.size, line["size"]), F.greatest(span.size, line["size"])
        reach = F.when(small < large * 0.85, F.greatest(F.lit(2.0), large * 0.5)).otherwise(F.greatest(F.lit(1.6), small * 0.3))
        fresh = F.coalesce(F.abs(span.baseline - line.reference) > reach, F.lit(True))
        leads = fresh | ((span.chars > 0) & (span["size"] > line["size"]))
        k = line.k + fresh.cast("int")
        return F.struct(k.alias("k"), F.when(leads, span.baseline).otherwise(line.reference).alias("reference"), F.when(leads, span["size"]).otherwise(line["size"]).alias("size"), F.concat(line.made, F.array(k)).alias("made"))

    start = F.struct(F.lit(0).alias("k"), none.alias("reference"), none.alias("size"), F.array().cast("array<int>").alias("made"))
    made = folded(rows, ["page", "stretch"], ["baseline", "x", "span_id"], ["size", "chars"], start, step)
    parts = made.select("page", "stretch", F.explode(F.zip_with("items", "state.made", lambda i, k: F.struct(i.alias("i"), k.alias("k")))).alias("p")).select("page", "stretch", "p.k", "p.i.*")
    half = F.floor(F.col("size") * 2 + 0.5) / 2
    sizes = parts.groupBy("page", "stretch", "k", half.alias("half")).agg(F.sum(F.col("chars") + 1).alias("weight"), F.min(F.struct("x", "span_id")).alias("first"), F.collect_list(F.struct("span_id", "baseline", "size", "chars")).alias("spans"))
    lines = sizes.groupBy("page", "stretch", "k").agg(F.min_by("half", F.struct(-F.col("weight"), "first")).alias("size"), F.min("first.x").alias("x"), F.flatten(F.collect_list("spans")).alias("spans"))
    main = F.filter("spans", lambda s: (s.chars > 0) & (F.abs(s["size"] - F.col("size")) < 0.6))
    main = F.array_sort(F.transform(F.when(F.size(main) > 0, main).otherwise(F.col("spans")), lambda s: s.baseline))
    lines = lines.withColumn("baseline", F.get(main, F.floor(F.size(main) / 2).cast("int"))).withColumn("top", F.col("baseline") - F.col("size"))
    lines = ranked(lines, ["page"], ["top", "x", "stretch", "k"], "line")
    return lines.select("page", "line", F.explode("spans.span_id").alias("span_id"), "size", "baseline")


def text_groups(items: DataFrame) -> DataFrame:
    """page, line (from the top) and item_id: items joined to the first line whose first item is near enough in height."""
    rows = items.select("page", "item_id", "x", "y", "h", (-F.col("y")).alias("down"))
    rows = stretches(rows, ["page"], "down", F.greatest(F.lit(3.5), F.col("h") * 0.45))

    def step(state: Column, item: Column) -> Column:
        near = F.transform(state.heads, lambda g: F.abs(g.y - item.y) <= F.greatest(F.lit(3.5), g.h * 0.45))
        found = F.array_position(near, True).cast("int")
        fresh = found == 0
        heads = F.when(fresh, F.concat(state.heads, F.array(F.struct(item.y.alias("y"), item.h.alias("h"))))).otherwise(state.heads)
        return F.struct(heads.alias("heads"), F.concat(state.made, F.array(F.when(fresh, F.size(state.heads) + 1).otherwise(found))).alias("made"))

    start = F.struct(F.array().cast("array<struct<y:double,h:double>>").alias("heads"), F.array().cast("array<int>").alias("made"))
    made = folded(rows, ["page", "stretch"], ["down", "x", "item_id"], ["y", "h"], start, step)
    parts = made.select("page", "stretch", F.explode(F.zip_with("items", "state.made", lambda i, k: F.struct(i.alias("i"), k.alias("k")))).alias("p")).select("page", "stretch", "p.k", "p.i.*")
    lines = parts.groupBy("page", "stretch", "k").agg(F.min(F.struct("down", "x", "item_id")).alias("head"), F.collect_list("item_id").alias("ids"))
    lines = ranked(lines.select("page", "head.*", "ids"), ["page"], ["down", "x", "item_id"], "line")
    return lines.select("page", "line", F.explode("ids").alias("item_id"))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Hits (page, hit_id, x, y, w) that are not within a hair of an earlier one that stays, whatever their kind.

    Only hits near in height, place and width meet: stretches of one are cut
    into stretches of the next.
    """
    rows = stretches(hits.select("page", "hit_id", "x", "y", "w"), ["page"], "y", F.lit(1.5), "sy")
    rows = stretches(rows, ["page", "sy"], "x", F.lit(1.5), "sx")
    rows = stretches(rows, ["page", "sy", "sx"], "w", F.lit(2.0), "sw")

    def step(kept: Column, h: Column) -> Column:
        near = F.exists(kept, lambda u: (F.abs(u.x - h.x) < 1.5) & (F.abs(u.y - h.y) < 1.5) & (F.abs(u.w - h.w) < 2))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(h)))

    start = F.array().cast("array<struct<hit_id:bigint,x:double,y:double,w:double>>")
    return folded(rows, ["page", "sy", "sx", "sw"], ["hit_id"], ["x", "y", "w"], start, step).select("page", F.explode("state.hit_id").alias("hit_id"))


#: Fixed values of bands: lines of a page that has any, and of a band; the least gap in points, in leadings and in sizes;
#: how much of a size a leading counts at least; the part of the page for a header, and above a footer; and how much larger than the body.
LINES_OF_PAGE, LINES_OF_BAND, LEAST_GAP, LEADINGS, SIZES, OF_SIZE, TOP, BOTTOM, LARGER = 4, 3, 10.0, 2.2, 1.4, 0.3, 0.18, 0.82, 1.12


def bands(lines: DataFrame) -> DataFrame:
    """Lines (page, line_id, y0, y1, size, page_height) with band: header, body or footer.

    A header is up to three lines at the top of the page above the first gap
    that sets them apart, if they stand high enough and are not larger than the
    body; a footer likewise from the bottom.
    """
    order = ["y0", "line_id"]
    rows = ranked(previous(lines.select("page", "line_id", "y0", "y1", "size", "page_height"), ["page"], order, "y1", "above"), ["page"], order, "num")
    rows = rows.withColumn("gap", F.col("y0") - F.col("above"))
    pages = rows.groupBy("page").agg(F.count("*").alias("n"), F.max("page_height").alias("height"))
    pages = pages.join(upper_medians(rows, ["page"], "size", "body"), "page").join(upper_medians(rows.where("gap > -2"), ["page"], "gap", "leading"), "page", "left")
    leading = F.coalesce("leading", F.lit(0.0))
    pages = pages.withColumn("apart", F.greatest(F.lit(LEAST_GAP), F.greatest(leading, F.col("body") * OF_SIZE) * LEADINGS, F.col("body") * SIZES))
    near = rows.join(pages, "page").where((F.col("num") <= LINES_OF_BAND) | (F.col("num") >= F.col("n") - LINES_OF_BAND - 1))
    edges = near.groupBy("page", "n", "height", "body", "apart").agg(F.collect_list(F.struct("num", "y0", "y1", "size", "gap")).alias("rows"))

    def places(low, high):
        return F.transform(F.filter("rows", lambda r: (r.num >= low) & (r.num <= high) & (r.gap >= F.col("apart"))), lambda r: r.num)

    small = lambda inside: F.forall(F.filter("rows", inside), lambda r: r["size"] <= F.col("body") * LARGER)
    below = F.array_min(places(F.lit(1), F.least(F.lit(LINES_OF_BAND), F.col("n") - 1)))
    edges = edges.withColumn("i", below)
    high = F.exists("rows", lambda r: (r.num == F.col("i") - 1) & (r.y1 <= F.col("height") * TOP))
    edges = edges.withColumn("header_end", F.when((F.col("n") >= LINES_OF_PAGE) & F.col("i").isNotNull() & high & small(lambda r: r.num < F.col("i")), F.col("i")).otherwise(0))
    edges = edges.withColumn("j", F.array_max(places(F.greatest(F.col("header_end") + 1, F.col("n") - LINES_OF_BAND), F.col("n") - 1)))
    low = F.exists("rows", lambda r: (r.num == F.col("j")) & (r.y0 >= F.col("height") * BOTTOM))
    edges = edges.withColumn("footer_start", F.when((F.col("n") >= LINES_OF_PAGE) & F.col("j").isNotNull() & low & small(lambda r: r.num >= F.col("j")), F.col("j")).otherwise(F.col("n")))
    out = rows.join(edges.select("page", "header_end", "footer_start"), "page")
    band = F.when(F.col("num") < F.col("header_end"), "header").when(F.col("num") >= F.col("footer_start"), "footer").otherwise("body")
    return out.select("page", "line_id", band.alias("band"))
