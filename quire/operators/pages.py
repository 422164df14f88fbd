"""Page algebra: selections, ranges, plans, merges, labels, rotation, cropping.

Pages are rows keyed by document and page number from 1. Operators are joins
and projections; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import latin1, trimmed


def selection(text: Column, total: Column) -> Column:
    """Pages that "1-3, 5" names, from 0, sorted, each once. A bad part is skipped, a missing end is the start, a reversed range names none."""

    def number(part: Column) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(part, "^[ \t]*([+-]?[0-9]{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int")

    def pages(chunk: Column) -> Column:
        ends = F.split(trimmed(chunk), "-")
        a = number(F.try_element_at(ends, F.lit(1)))
        b = F.coalesce(number(F.try_element_at(ends, F.lit(2))), a)
        low, high = F.greatest(F.lit(1), a), F.least(total, b)
        return F.when(a.isNotNull() & (low <= high), F.sequence(low - 1, high - 1)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), pages))))


def selection_text(picked: Column) -> Column:
    """The shortest text for sorted distinct pages from 0."""
    # a run begins where the page before is not the one in the list before, and ends likewise
    edges = F.filter(picked, lambda p, i: (i == 0) | (F.get(picked, i - 1) < p - 1))
    ends = F.filter(picked, lambda p, i: F.coalesce(F.get(picked, i + 1) > p + 1, F.lit(True)))
    return F.array_join(F.zip_with(edges, ends, lambda a, b: F.when(a == b, (a + 1).cast("string")).otherwise(F.concat_ws("-", (a + 1).cast("string"), (b + 1).cast("string")))), ", ")


def fixed_ranges(total: Column, every: Column) -> Column:
    """Ranges of ``every`` pages, the last maybe shorter: array of (start, stop) from 1, both included."""
    starts = F.when(total > 0, F.sequence(F.lit(1), total, F.greatest(every, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda a: F.struct(a.alias("start"), F.least(total, a + F.greatest(every, F.lit(1)) - 1).alias("stop")))


def ordered_range(a: Column, b: Column) -> Column:
    """Both ends in order; null if it would begin before page 1."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low >= 1, F.struct(low.alias("start"), high.alias("stop")))


def clamped_range(first: Column, last: Column, total: Column) -> Column:
    """``first`` to ``last`` within the document; 0 as the last means the end. Null if the last comes before the first."""
    low = F.greatest(F.lit(1), F.least(F.when(F.coalesce(first, F.lit(0)) == 0, 1).otherwise(first), total))
    high = F.when(last > 0, F.least(last, total)).otherwise(total)
    return F.when(high >= low, F.struct(low.alias("start"), high.alias("stop")))


def split_pages(pages: DataFrame, ranges: DataFrame, doc: str, page: str) -> DataFrame:
    """Rows of ``pages`` for each of ``ranges`` (doc, ord, start, stop) over them; overlaps repeat pages, what is out of bounds is dropped."""
    r = ranges.select(F.col(doc), "ord", F.explode(F.when(F.col("start") <= F.col("stop"), F.sequence("start", "stop"))).alias(page))
    return r.join(pages, [doc, page])


def split_parts(pages: DataFrame, ranges: DataFrame, doc: str, page: str) -> DataFrame:
    """One row for each range: whether it has pages, how many, and the message."""
    counts = pages.groupBy(doc).agg(F.count("*").cast("int").alias("total"))
    n = split_pages(pages, ranges, doc, page).groupBy(doc, "ord").agg(F.count("*").cast("int").alias("n"))
    rows = ranges.join(counts, doc).join(n, [doc, "ord"], "left")
    found = F.coalesce("n", F.lit(0))
    plural = F.when(F.col("total") == 1, "").otherwise("s")
    message = F.when(found > 0, F.format_string("Pages %d-%d extracted", "start", "stop")).otherwise(F.format_string("Pages %d-%d are out of range (document has %d page%s).", "start", "stop", "total", plural))
    return rows.select(doc, "ord", (found > 0).alias("ok"), found.alias("n"), message.alias("message"))


def arranged(pages: DataFrame, plan: DataFrame, doc: str, page: str, turn: str = "turn") -> DataFrame:
    """Pages in the order of ``plan`` (doc, ord, source from 0, turn), repeats allowed; sources out of bounds are dropped."""
    p = plan.withColumn(page, F.col("source") + 1)
    rows = p.join(pages, [doc, page])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("ord"))).withColumn(turn, normal_rotation(F.col(turn)))


def without_pages(pages: DataFrame, drop: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages not listed in ``drop``; a document that would lose all keeps all."""
    kept = pages.join(drop.select(doc, page).distinct(), [doc, page], "left_anti")
    whole = pages.join(kept.select(doc).distinct(), doc, "left_anti")
    return kept.unionByName(whole)


def merged(*parts: DataFrame) -> DataFrame:
    """All pages of all parts, each with the number of its part; by part and then their own order they are one document."""
    rows = None
    for n, part in enumerate(parts):
        one = part.withColumn("part", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def normal_rotation(degrees: Column) -> Column:
    """The nearest quarter turn, 0 to 270; halves go up."""
    return F.pmod(F.floor(degrees / 90 + 0.5) * 90, F.lit(360)).cast("int")


def visible_size(width: Column, height: Column, rotation: Column) -> Column:
    turned = rotation.isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def visible_to_page(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    px = F.when(rotation == 90, width - y).when(rotation == 180, width - x).when(rotation == 270, y).otherwise(x)
    py = F.when(rotation == 90, x).when(rotation == 180, height - y).when(rotation == 270, height - x).otherwise(y)
    return F.struct(px.alias("x"), py.alias("y"))


def cropped(width: Column, height: Column, rotation: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """The crop box for insets as fractions of what is seen; null if too little would be left."""
    seen = visible_size(width, height, rotation)
    a = visible_to_page(left * seen["width"], bottom * seen["height"], width, height, rotation)
    b = visible_to_page(seen["width"] - right * seen["width"], seen["height"] - top * seen["height"], width, height, rotation)
    w, h = F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"])
    fits = (left + right < 0.95) & (top + bottom < 0.95) & (w >= 1) & (h >= 1)
    return F.when(fits, F.struct(F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"), w.alias("width"), h.alias("height")))


def page_label(form: Column, nth: Column, start_at: Column, numbered: Column) -> Column:
    """A page number: {n} counts from ``start_at``, {N} is the last number given out."""
    out = F.replace(form, F.lit("{n}"), (start_at + nth).cast("string"))
    return latin1(F.replace(out, F.lit("{N}"), (start_at + numbered - 1).cast("string")))


def running_text(form: Column, page: Column, total: Column) -> Column:
    """A header or footer: {n} is the page, {N} the number of pages."""
    return latin1(F.replace(F.replace(form, F.lit("{n}"), page.cast("string")), F.lit("{N}"), total.cast("string")))


def slots(width: Column, height: Column, size: Column, margin: Column) -> Column:
    """Where the six headers and footers of a page stand."""
    s, m = F.greatest(F.lit(6.0), F.least(F.lit(24.0), size)), F.greatest(F.lit(12.0), margin)
    rows = [(name, x, y) for name_y, y in (("header", height - m), ("footer", F.greatest(F.lit(4.0), m - s))) for name, x in ((f"{name_y}-left", m), (f"{name_y}-center", width / 2), (f"{name_y}-right", width - m))]
    return F.array(*(F.struct(F.lit(n).alias("slot"), x.alias("x"), y.alias("y")) for n, x, y in rows))


def keywords(text: Column, pattern: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(text, pattern), trimmed), lambda k: k != "")


def watermark_place(width: Column, height: Column, text_width: Column, size: Column, degrees: Column) -> Column:
    """Lower left corner of a text turned around the middle of the page."""
    a = F.radians(degrees)
    x = width / 2 - (text_width / 2) * F.cos(a) + (size / 2) * F.sin(a)
    y = height / 2 - (text_width / 2) * F.sin(a) - (size / 2) * F.cos(a)
    return F.struct(x.alias("x"), y.alias("y"))


def latest(events: DataFrame, key: str, order: str, most: int = 60) -> DataFrame:
    """Undo history: the last ``most`` snapshots of each document, newest first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("step", n).where(F.col("step") <= most)


def moved(items: DataFrame, key: str, place: str, chosen: Column, delta: int) -> DataFrame:
    """New order after the chosen item of each group moves by ``delta``; a move past an end does nothing."""
    w = Window.partitionBy(key)
    at = F.max(F.when(chosen, F.col(place))).over(w)
    last = F.max(place).over(w)
    to = at + delta
    fits = at.isNotNull() & (to >= 0) & (to <= last)
    shift = F.when(chosen, to).when((F.col(place) > at) & (F.col(place) <= to), F.col(place) - 1).when((F.col(place) < at) & (F.col(place) >= to), F.col(place) + 1).otherwise(F.col(place))
    return items.withColumn("moved", F.when(fits, shift).otherwise(F.col(place)).cast("int"))


def table_pages(rows: DataFrame, key: str, order: list[str], each: int) -> DataFrame:
    """Page number from 0 and line on the page for rows set ``each`` to a page."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(n / each).cast("int")).withColumn("line", (n % each).cast("int"))


def image_names(page: Column, total: Column, base: Column, kind: str) -> Column:
    return F.concat(base, F.lit("-"), F.call_function("lpad", page.cast("string"), F.length(total.cast("string")), F.lit("0")), F.lit(f".{kind}"))

