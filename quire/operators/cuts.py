"""Pages cut across at their largest gaps, then down at their gutters, again and again.

The tree of parts is built a level at a time for all pages at once: a part is
known by its path, and each level is one pass of windows over (page, path). Parts
that cannot be cut, or lie ``DEEPEST`` levels deep, are leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.geometry import upper_median
from quire.sources.shared import written

#: Fixed values of cuts: how deep they go; leadings, and points at least, of a gap to cut across at; and of columns the
#: least gutter, width (points, and as a part of the page's), rows and page width.
DEEPEST, LEADINGS, LEAST_GAP, GUTTER, LEAST_COLUMN, COLUMN_SHARE, COLUMN_ROWS, COLUMN_PAGE = 5, 1.9, 9.0, 16.0, 40.0, 0.12, 4, 120.0
PART = ["page", "path"]


def parts(lines: DataFrame) -> DataFrame:
    """page, path, kind (across, down, leaf) and line_id (-1 but for leaves) of lines (page, line_id, x0, y0, x1, y1, baseline)."""
    rows = lines.select("page", F.lit("0").alias("path"), "line_id", "x0", "y0", "x1", "y1", "baseline")
    made = []
    for _ in range(DEEPEST + 1):
        cut = written(_cut(rows), "page-parts")
        leaves = cut.where("kind = 'leaf'").select(*PART, "kind", "line_id")
        nodes = cut.where("kind <> 'leaf'").select(*PART, "kind", F.lit(-1).cast("long").alias("line_id")).distinct()
        made += [leaves, nodes]
        rows = cut.where("kind <> 'leaf'").select("page", F.concat_ws(".", "path", F.col("child").cast("string")).alias("path"), "line_id", "x0", "y0", "x1", "y1", "baseline")
    made.append(rows.select(*PART, F.lit("leaf").alias("kind"), "line_id"))
    out = made[0]
    for part in made[1:]:
        out = out.union(part)
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` with the kind of their part, and the child that they go to."""
    down, right = Window.partitionBy(*PART).orderBy("y0", "line_id"), Window.partitionBy(*PART).orderBy("x0", "line_id")
    before, lead = (Window.unboundedPreceding, -1), F.col("baseline") - F.lag("baseline").over(down)
    seen = rows.withColumns({"lead": F.when(lead > 0, lead), "gap": F.col("y0") - F.max("y1").over(down.rowsBetween(*before)), "reach": F.max("x1").over(right.rowsBetween(*before))})
    gutter = F.when(F.col("x0") - F.col("reach") >= GUTTER, F.struct(F.col("reach").alias("a"), F.col("x0").alias("b")))
    found = seen.groupBy(*PART).agg(
        F.count("*").alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max(F.struct("gap", (-F.col("y0")).alias("up"), (-F.col("line_id")).alias("back"))).alias("best"),
        upper_median("lead").alias("leading"), F.array_sort(F.collect_list(gutter)).alias("gutters"),
    )
    across = (F.col("n") > 1) & (F.col("best.gap") > F.greatest(F.coalesce("leading", F.lit(0.0)) * LEADINGS, F.lit(LEAST_GAP)))
    width = F.col("right") - F.col("left")
    side = F.greatest(F.lit(LEAST_COLUMN), width * COLUMN_SHARE)
    usable = F.filter("gutters", lambda g: (g.a - F.col("left") >= side) & (F.col("right") - g.b >= side))
    middles = F.transform(usable, lambda g: (g.a + g.b) / 2)
    fits = (F.col("n") >= COLUMN_ROWS) & (width >= COLUMN_PAGE) & (F.size(middles) > 0)
    found = found.select(*PART, F.coalesce(across, F.lit(False)).alias("across"), fits.alias("fits"), "best", middles.alias("middles"))
    center = (F.col("x0") + F.col("x1")) / 2
    below = (F.col("y0") > -F.col("best.up")) | ((F.col("y0") == -F.col("best.up")) & (F.col("line_id") >= -F.col("best.back")))
    rows = rows.join(found, PART).withColumn("child", F.when(F.col("across"), below.cast("int")).when(F.col("fits"), F.size(F.filter("middles", lambda m: m < center))))
    columns = rows.where("fits AND NOT across").groupBy(*PART, "child").agg(F.count("*").alias("c"), F.max(F.size("middles")).alias("m"))
    columns = columns.groupBy(*PART).agg(((F.min("c") > 1) & (F.count("*") == F.max("m") + 1)).alias("good"))
    kind = F.when(F.col("across"), "across").when(F.coalesce("good", F.lit(False)), "down").otherwise("leaf")
    return rows.join(columns, PART, "left").select(*PART, "line_id", "x0", "y0", "x1", "y1", "baseline", kind.alias("kind"), "child")
