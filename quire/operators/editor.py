"""An editor's document: pages with annotations, their order, transforms, and table pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiplied(a: Column, b: Column) -> Column:
    """Product of two affine transforms of six numbers: first a, then b."""
    e = lambda m, i: F.element_at(m, i + 1)
    cells = [e(a, 2 * r) * e(b, c) + e(a, 2 * r + 1) * e(b, 2 + c) + (e(b, 4 + c) if r == 2 else F.lit(0.0)) for r in range(3) for c in range(2)]
    return F.array(*cells)


def inverted(m: Column) -> Column:
    """The transform back; null if there is none."""
    a, b, c, d, e, f = (F.element_at(m, i) for i in range(1, 7))
    det = a * d - b * c
    return F.when(F.abs(det) > 1e-12, F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det))


def moved_point(m: Column, x: Column, y: Column) -> Column:
    a, b, c, d, e, f = (F.element_at(m, i) for i in range(1, 7))
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def box_around(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The upright rectangle around a transformed one."""
    corners = [moved_point(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    ends = lambda f, k: f(*[c[k] for c in corners])
    return F.struct(ends(F.least, "x").alias("x0"), ends(F.least, "y").alias("y0"), ends(F.greatest, "x").alias("x1"), ends(F.greatest, "y").alias("y1"))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def annotated(pages: DataFrame, annotations: DataFrame, page: str, order: str, value: str) -> DataFrame:
    """Pages with their annotations in order; a page without any has an empty list."""
    own = annotations.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("annotations"))
    return pages.join(own, page, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(own.schema["annotations"].dataType)))


def without_page(pages: DataFrame, doc: str, page: str, gone: Column) -> DataFrame:
    """Pages without those marked; a document's only page stays."""
    left = F.count("*").over(Window.partitionBy(doc))
    return pages.withColumn("__left", left).where(~gone | (F.col("__left") == 1)).drop("__left")


def to_front(items: DataFrame, key: str, place: str, chosen: Column) -> DataFrame:
    """New stacking order with the chosen item on top, the others as they were."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(chosen.cast("int"), place))
    return items.withColumn("moved", n - 1)


def headed_pages(rows: DataFrame, key: str, order: list[str], header: str, text: str, each: int = 37) -> DataFrame:
    """Table rows ``each`` to a page with the header first on every page: key, page, line, text."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    body = rows.select(key, F.floor(n / each).cast("int").alias("page"), (n % each + 1).cast("int").alias("line"), F.col(text).alias("text"))
    return body.unionByName(body.select(key, "page").distinct().select(key, "page", F.lit(0).alias("line"), F.lit(header).alias("text")))


def longest(rules: DataFrame, upright: int = 60, level: int = 80) -> DataFrame:
    """The rules of each page that count: the longest of either direction."""
    n = F.row_number().over(Window.partitionBy("page", "horizontal").orderBy(F.desc(F.col("end") - F.col("start")), "rule_id"))
    return rules.withColumn("n", n).where(F.col("n") <= F.when(F.col("horizontal"), level).otherwise(upright)).drop("n")


def inherited(shapes: DataFrame, layout: DataFrame, master: DataFrame, page: str, value: str) -> DataFrame:
    """Placeholders with a value of their own, else that of the layout's placeholder of the same idx, else of its kind, else the master's of that kind.

    ``layout`` (page, ord, idx, kind, value) and ``master`` (page, ord, kind, value) may hold several alike; the first counts.
    """

    def first(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(page, key).agg(F.min_by(value, "ord").alias(name))

    out = shapes.join(first(layout, "idx", "by_idx"), [page, "idx"], "left").join(first(layout, "kind", "by_kind"), [page, "kind"], "left").join(first(master, "kind", "by_master"), [page, "kind"], "left")
    return out.withColumn(value, F.coalesce(value, "by_idx", "by_kind", "by_master")).drop("by_idx", "by_kind", "by_master")
