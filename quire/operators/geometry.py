"""Joins, windows and aggregates over what stands on a page: spans, rules, fills, links, boxes.

Tables are keyed by ``page``. Rectangles have x0, y0, x1, y1; spans have x,
x_end, baseline, size. Range joins are equi-joins on a page and a grid cell,
filtered afterwards, so no page's rows all meet each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import matches

#: Height of a grid row for range joins, in points.
CELL = 64


def cell(y: Column, size: int = CELL) -> Column:
    return F.floor(y / size).cast("int")


def cells(low: Column, high: Column, size: int = CELL) -> Column:
    """Grid rows that an interval touches."""
    return F.explode(F.sequence(cell(low, size), cell(F.greatest(low, high), size)))


def area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def decorated(spans: DataFrame, rules: DataFrame, most: int = 400) -> DataFrame:
    """Spans with underline and strike: whether a thin horizontal rule covers 60 % of them in the right band."""
    thin = rules.where("horizontal and thickness <= 2").withColumn("n", F.count("*").over(Window.partitionBy("page")))
    long = thin.where((F.col("n") <= most) | (F.col("end") - F.col("start") > 12))
    kept = long.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("rule_id"))).where((F.col("n") <= most) | (F.col("k") <= most))
    r = kept.select("page", "pos", "start", "end", cell(F.col("pos")).alias("g"))
    s = spans.where("x_end > x").withColumn("g", cells(F.col("baseline") - F.col("size") * 0.45, F.col("baseline") + F.col("size") * 0.26))
    off, over = F.col("pos") - F.col("baseline"), F.least("x_end", "end") - F.greatest("x", "start")
    under = (off > F.col("size") * 0.02) & (off < F.col("size") * 0.26)
    strike = (off < F.col("size") * -0.15) & (off > F.col("size") * -0.45)
    hits = s.join(r, ["page", "g"]).where((over >= (F.col("x_end") - F.col("x")) * 0.6) & (under | strike))
    flags = hits.groupBy("page", "span_id").agg(F.max(under).alias("underline"), F.max(strike).alias("strike"))
    return spans.join(flags, ["page", "span_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("underline", "strike")})


def shaded(lines: DataFrame, fills: DataFrame, slack: float = 2.0) -> DataFrame:
    """Lines (x0..y1) with the colour of the smallest fill around them that is not white."""
    box = ["x0", "y0", "x1", "y1"]
    # of fills in one place the first, and lines in one place, are judged once; a fill's rank is a number, as sums of fixed width need no sort
    f = fills.where("color <> 'FFFFFF'").groupBy("page", *box).agg(F.min("fill_id").alias("fill_id"), F.min_by("color", "fill_id").alias("color"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(size, "fill_id")))
    colors = f.select("page", "rank", F.col("color").alias("shading"))
    f = f.select("page", "rank", *[F.col(c).alias(f"f{c}") for c in box]).withColumn("g", cells(F.col("fy0") - slack, F.col("fy1") + slack))
    places = lines.select("page", *box).distinct()
    inside = (F.col("x0") >= F.col("fx0") - slack) & (F.col("x1") <= F.col("fx1") + slack) & (F.col("y0") >= F.col("fy0") - slack) & (F.col("y1") <= F.col("fy1") + slack)
    hits = places.withColumn("g", cell(F.col("y0"))).join(f, ["page", "g"]).where(inside)
    best = hits.groupBy("page", *box).agg(F.min("rank").alias("rank"))
    best = best.join(colors, ["page", "rank"]).drop("rank")
    return lines.join(best, ["page", *box], "left")


def linked(spans: DataFrame, links: DataFrame, slack: float = 1.0) -> DataFrame:
    """Spans with the url of the first link whose rectangle holds their middle."""
    cx, cy = (F.col("x") + F.col("x_end")) / 2, F.col("baseline") - F.col("size") * 0.3
    r = links.withColumn("g", cells(F.col("y0") - slack, F.col("y1") + slack))
    hits = spans.withColumn("g", cell(cy)).join(r, ["page", "g"]).where(cx.between(F.col("x0") - slack, F.col("x1") + slack) & cy.between(F.col("y0") - slack, F.col("y1") + slack))
    return spans.join(hits.groupBy("page", "span_id").agg(F.min_by("url", "ord").alias("link")), ["page", "span_id"], "left")


def banded(items: DataFrame, shows: DataFrame, window: float = 1.5) -> DataFrame:
    """Pairs of text items and show operators whose rounded rows are next to each other and whose x differ little."""
    near = items.withColumn("b", F.explode(F.array(*[F.floor(F.col("y") + 0.5).cast("long") + d for d in (-1, 0, 1)])))
    s = shows.withColumn("b", F.floor(F.col("sy") + 0.5).cast("long"))
    return near.join(s, ["page", "b"]).where(F.abs(F.col("x") - F.col("sx")) <= window).drop("b")


def overlap(a: str, b: str) -> Column:
    """Whether rectangles share more than an edge; columns are prefixed."""
    return (F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{a}x1") > F.col(f"{b}x0")) & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{a}y1") > F.col(f"{b}y0"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("page", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "page"])


def survivors(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words that no box overlaps."""
    b = prefixed(boxes.select("page", "x0", "y0", "x1", "y1"), "b_").withColumn("g", cells(F.col("b_y0"), F.col("b_y1")))
    w = words.withColumn("g", cells(F.col("y0"), F.col("y1"))).select("page", "g", "word_id", *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    return words.join(w.join(b, ["page", "g"]).where(overlap("w_", "b_")).select("page", "word_id").distinct(), ["page", "word_id"], "left_anti")


def in_slots(slots: DataFrame, spans: DataFrame, slack: float = 1.0) -> DataFrame:
    """Spans of each grid slot, by their middle."""
    cx = (F.col("x") + F.col("x_end")) / 2
    s = prefixed(slots, "s_").withColumn("g", cells(F.col("s_y0") - slack, F.col("s_y1") + slack))
    return spans.withColumn("g", cell(F.col("baseline"))).join(s, ["page", "g"]).where(cx.between(F.col("s_x0") - slack, F.col("s_x1") + slack) & F.col("baseline").between(F.col("s_y0") - slack, F.col("s_y1") + slack)).drop("g")


def clustered(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Groups of values no farther than ``tolerance`` from the one before, as their means."""
    w = Window.partitionBy(*keys).orderBy(value)
    opens = F.when(F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)) > tolerance, 1).otherwise(0)
    rows = values.withColumn("opens", opens)
    rows = rows.withColumn("grp", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "grp").agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(*keys, "grp", (F.col("total") / F.col("n")).alias("mean"), "n")


def gap_before(rows: DataFrame, keys: list[str], low: str, high: str, *order: str) -> DataFrame:
    """Adds gap: from the farthest end so far to where each row begins; null for the first."""
    w = Window.partitionBy(*keys).orderBy(low, *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max(high).over(w)).withColumn("gap", F.col(low) - F.col("reach"))


def gutters(lines: DataFrame, least: float = 16.0) -> DataFrame:
    """Empty stretches across the lines of each page that are wide enough for a gutter, with usable columns beside them."""
    page = lines.groupBy("page").agg(F.min("x0").alias("px0"), F.max("x1").alias("px1"))
    rows = gap_before(lines, ["page"], "x0", "x1", "line_id").where(F.col("gap") >= least).join(page, "page")
    side = F.greatest(F.lit(40.0), (F.col("px1") - F.col("px0")) * 0.12)
    return rows.where((F.col("reach") - F.col("px0") >= side) & (F.col("px1") - F.col("x0") >= side)).select("page", F.col("reach").alias("g0"), F.col("x0").alias("g1"))


def band_cut(lines: DataFrame) -> DataFrame:
    """Where each page is cut across first: before the line under its largest gap, if that is much larger than the leading."""
    w = Window.partitionBy("page").orderBy("y0", "line_id")
    lead = F.col("baseline") - F.lag("baseline").over(w)
    leading = lines.withColumn("lead", lead).where("lead > 0").groupBy("page").agg(upper_median("lead").alias("leading"))
    rows = gap_before(lines, ["page"], "y0", "y1", "line_id").join(leading, "page", "left").where(F.col("gap") > F.greatest(F.coalesce(F.col("leading"), F.lit(0.0)) * 1.9, F.lit(9.0)))
    return rows.groupBy("page").agg(F.max("gap").alias("gap"), F.min_by("line_id", F.struct(-F.col("gap"), "y0", "line_id")).alias("line_id"))


def upper_median(value: str) -> Column:
    """The middle value, the higher of two; null without any."""
    v = F.sort_array(F.collect_list(value))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def covered(rules: DataFrame, spans: DataFrame, snap: float = 2.5) -> DataFrame:
    """Whether the rules near ``pos`` together cover low to high, with 1.5 points of slack, for each row of ``spans``."""
    # rows of one place are judged once, and meet equal rules once, in rows of a grid
    place = ["page", "pos", "low", "high"]
    r = rules.select("page", F.col("pos").alias("at"), "start", "end").distinct().withColumn("g", cell(F.col("at")))
    p = spans.select(*place).distinct().withColumn("g", cells(F.col("pos") - snap, F.col("pos") + snap))
    near = p.join(r, ["page", "g"]).where((F.abs(F.col("at") - F.col("pos")) <= snap) & (F.col("end") > F.col("low") + 0.5) & (F.col("start") < F.col("high") - 0.5))
    near = near.select(*place, "start", "end").distinct()
    w = Window.partitionBy(*place).orderBy("start", "end")
    reach = F.greatest(F.col("low"), F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("low")))
    rows = near.withColumn("broken", (F.col("start") > reach + 1.5).cast("int"))
    rows = rows.withColumn("broken", F.max("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = rows.where("broken = 0").groupBy(*place).agg(F.max("end").alias("reach"))
    return spans.join(best, place, "left").withColumn("covered", F.coalesce(F.col("reach") >= F.col("high") - 1.5, F.lit(False)))


def segments(spans: DataFrame) -> DataFrame:
    """Spans of each line numbered by segment: a gap of over 6 points and 3.2 spaces opens another."""
    w = Window.partitionBy("page", "line").orderBy("x", "span_id")
    gap = F.col("x") - F.lag("x_end").over(w)
    opens = gap > F.greatest(F.lit(6.0), F.greatest(F.col("space"), F.lag("space").over(w)) * 3.2)
    rows = spans.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    return rows.withColumn("segment", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def style_runs(spans: DataFrame) -> DataFrame:
    """Neighbouring spans of one style as one text, with a space where the gap is almost one wide unless single letters are spaced out."""
    w = Window.partitionBy("page", "line").orderBy("x", "span_id")
    before, size, text = F.lag("style").over(w), F.lag("size").over(w), F.lag("text").over(w)
    opens = ~F.coalesce((before == F.col("style")) & (F.abs(size - F.col("size")) < 0.35), F.lit(False))
    gap = F.col("x") - F.lag("x_end").over(w)
    single = (F.length(F.trim(text)) <= 1) & (F.length(F.trim("text")) <= 1)
    spaced = ~single & (gap > F.greatest(F.lag("space").over(w), F.col("space")) * 0.85) & ~text.endswith(" ") & ~F.col("text").startswith(" ")
    rows = spans.withColumn("opens", opens.cast("int")).withColumn("glue", F.when(F.coalesce(spaced, F.lit(False)), " ").otherwise(""))
    rows = rows.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct("x", "span_id", F.when(F.col("opens") == 1, F.col("text")).otherwise(F.concat("glue", "text")).alias("t"))))
    return rows.groupBy("page", "line", "run").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"), F.min("x").alias("x"), F.max("x_end").alias("x_end"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines numbered by paragraph: one goes on while it is close below, of the same size and shade, and no list marker."""
    w = Window.partitionBy("page").orderBy("y0", "line_id")
    gap = F.col("y0") - F.lag("y1").over(w)
    goes = (gap <= F.col("size") * 0.6) & (F.abs(F.lag("size").over(w) - F.col("size")) < 0.6) & (F.lag("shade").over(w) == F.col("shade")) & ~F.col("marker")
    rows = lines.withColumn("opens", (~F.coalesce(goes, F.lit(False))).cast("int"))
    return rows.withColumn("paragraph", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def alignment(lines: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """How each paragraph is set between the edges of its column: left, right, center or justify."""
    left, right = F.max(F.abs(F.col("x0") - F.col("c0"))), F.max(F.abs(F.col("c1") - F.col("x1")))
    middle = F.max(F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("c0") + F.col("c1")) / 2))
    kind = F.when((left <= slack) & (right <= slack) & (F.count("*") > 1), "justify").when(left <= slack, "left").when(right <= slack, "right").when(middle <= slack, "center").otherwise("left")
    return lines.groupBy(*keys).agg(kind.alias("align"))


def column_alignment(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Alignment of table columns by the spread of the free space on either side."""
    left, right = F.max("left") - F.min("left"), F.max("right") - F.min("right")
    return cells_.groupBy(*keys).agg(F.when(right < left - 1, "right").when(F.abs(left - right) <= 1, "center").otherwise("left").alias("align"), left.alias("left_spread"), right.alias("right_spread"))


def weighted_mode(rows: DataFrame, keys: list[str], value: Column, weight: Column, order: str) -> DataFrame:
    """The value with most weight, the one seen first among equals, and its share."""
    sums = rows.groupBy(*keys, value.alias("mode")).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    total = F.sum("w").over(Window.partitionBy(*keys))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "first"))
    return sums.select(*keys, "mode", "w", (F.col("w") / total).alias("share"), best.alias("r")).where("r = 1").drop("r")


def bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def common_margins(pages: DataFrame) -> DataFrame:
    """Each page with the smallest margins among pages of its rounded size."""
    size = [F.floor(F.col(c) + 0.5).alias(f"r_{c}") for c in ("width", "height")]
    rows = pages.select("*", *size)
    least = rows.groupBy("r_width", "r_height").agg(*[F.min(c).alias(f"common_{c}") for c in ("left", "right", "top", "bottom")])
    return rows.join(least, ["r_width", "r_height"]).drop("r_width", "r_height")


def pixel_change(left: DataFrame, right: DataFrame, threshold: int = 48) -> DataFrame:
    """Share of pixels of two pages that differ: by more than ``threshold`` over all channels, or present on one side only."""
    l = left.select("page", "x", "y", F.struct("r", "g", "b").alias("l"))  # noqa: E741
    r = right.select("page", "x", "y", F.struct("r", "g", "b").alias("r_"))
    delta = sum((F.abs(F.col(f"l.{c}") - F.col(f"r_.{c}")) for c in "rgb"), F.lit(0))
    changed = F.col("l").isNull() | F.col("r_").isNull() | (delta > threshold)
    return l.join(r, ["page", "x", "y"], "full_outer").groupBy("page").agg(F.least(F.lit(1.0), F.count_if(changed) / F.count("*")).alias("change"))


def dominant_color(pixels: DataFrame, keys: list[str], levels: int = 24) -> DataFrame:
    """Mean colour of the fullest bucket, of ``levels`` steps a channel."""
    step = 256 / levels
    rows = pixels.withColumns({f"{c}b": F.floor(F.col(c) / step).cast("int") for c in "rgb"})
    sums = rows.groupBy(*keys, "rb", "gb", "bb").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "rb", "gb", "bb"))
    rows = sums.withColumn("k", best).where("k = 1")
    return rows.select(*keys, *[F.floor(F.col(c) / F.col("n") + 0.5).cast("int").alias(c) for c in "rgb"], "n")


def ink(luminance: Column) -> Column:
    """Opacity of a signature's pixel: none from 0.75 of full light, more below it, full from 0.35 under that."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.75 - luminance) / 0.35))


def scanned(pages: DataFrame) -> DataFrame:
    """Pages with almost no text under a picture of more than half their size."""
    return pages.withColumn("scanned", (F.col("chars") < 24) & (F.coalesce(F.col("picture"), F.lit(0.0)) >= F.col("width") * F.col("height") * 0.55))


def cover(page: Column, chars: Column, picture: Column) -> Column:
    """Whether a page is a cover: the first, with little text and a picture, or with nothing, or with a picture and some text."""
    return (page == 1) & (((chars <= 40) & picture) | ((chars == 0) & ~picture) | ((chars <= 800) & picture))


def bar_chart(fills: DataFrame) -> DataFrame:
    """Pages whose fills look like bars: at least four, of three or more widths or heights."""
    half = lambda a, b: F.floor((F.col(a) - F.col(b)) / 2 + 0.5)
    rows = fills.groupBy("page").agg(F.count("*").alias("n"), F.countDistinct(half("x1", "x0")).alias("widths"), F.countDistinct(half("y1", "y0")).alias("heights"))
    return rows.withColumn("bars", (F.col("n") >= 4) & ((F.col("widths") >= 3) | (F.col("heights") >= 3)))


def list_labels(items: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """Numbers of nested list items (ord, level): an item counts within its parent, deeper levels start afresh."""
    out = items
    for level in range(levels):
        upper = [f"c{i}" for i in range(level)]
        w = Window.partitionBy(*keys, *upper).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"c{level}", F.sum(F.when(F.col("level") == level, 1).otherwise(0)).over(w))
    parts = F.array(*[F.when(F.col("level") >= i, F.greatest(F.col(f"c{i}"), F.lit(1))) for i in range(levels)])
    return out.withColumn("label", F.array_join(F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: x.cast("string")), ".")).drop(*[f"c{i}" for i in range(levels)])


# phrases


def phrase_boxes(words: DataFrame, phrase: str, pad: float = 1.0) -> DataFrame:
    """page, x, y, width, height around every occurrence of a phrase, case aside, none within another.

    ``words`` has page, word_id, x, y, width, height and text. Words of one
    rounded height are a line, joined by spaces; of a word that the phrase
    covers in part, the box takes that part of its width.
    """
    needle = phrase.strip().lower()
    texts = F.transform("ws", lambda w: w["text"])
    lines = words.where("text <> ''").groupBy("page", F.floor(F.col("y") + 0.5).alias("level")).agg(F.array_sort(F.collect_list(F.struct("x", "word_id", "y", "width", "height", "text"))).alias("ws"))
    lines = lines.withColumn("joined", F.lower(F.array_join(texts, " "))).where(F.lit(needle != "") & F.contains("joined", F.lit(needle)))
    starts = F.transform("ws", lambda w, i: F.length(F.array_join(F.slice(texts, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0))
    hits = lines.withColumn("at", starts).select("page", F.arrays_zip("ws", "at").alias("ws"), F.explode(matches(F.col("joined"), re.escape(needle))).alias("hit"))
    start, stop = F.col("hit.start"), F.col("hit.stop")
    size = lambda w: F.length(w["ws"]["text"])
    under = F.filter("ws", lambda w: (w["at"] + size(w) > start) & (w["at"] < stop))
    edge = lambda w, at: w["ws"]["x"] + at * (w["ws"]["width"] / size(w))
    box = hits.select(
        "page",
        F.array_min(F.transform(under, lambda w: edge(w, F.greatest(F.lit(0), start - w["at"])))).alias("left"),
        F.array_max(F.transform(under, lambda w: edge(w, F.least(size(w), stop - w["at"])))).alias("right"),
        F.array_min(F.transform(under, lambda w: w["ws"]["y"])).alias("top"),
        F.array_max(F.transform(under, lambda w: w["ws"]["y"] + w["ws"]["height"])).alias("bottom"),
    )
    sized = (F.col("right") - F.col("left") + 2 * pad).alias("width"), (F.col("bottom") - F.col("top") + 2 * pad).alias("height")
    return box.where("right > left").select("page", (F.col("left") - pad).alias("x"), (F.col("top") - pad).alias("y"), *sized)
