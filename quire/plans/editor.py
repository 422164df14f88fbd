"""Queries over an editor's document, with their SQL. Orders are pages, their line items annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import editor as E
from quire.plans import geometry as G
from quire.sources.tables import table

#: A catalogue of tools with their categories.
CATALOGUE = (("merge", ("organize",)), ("split", ("organize",)), ("compress", ("optimize",)), ("redact", ("edit", "security")), ("protect", ("security",)), ("summarize", ("ai", "convert")), ("compare", ("edit", "ai")))


def editor_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"), F.col("l_partkey").cast("string").alias("value"))
    return E.annotated(orders, items, "page", "ord", "value").select("page", F.array_join("annotations", ",").alias("annotations"))


def editor_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, m, to = F.col("size"), F.col("m"), F.col("to")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    a = F.array(size / 8, F.lit(0.5), F.lit(-0.25), size / 16, F.col("p_partkey").cast("double"), F.lit(3.0))
    b = F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(10.0), size)
    # each step in columns of its own: written into one another, they would grow with the product of their sizes
    p = p.withColumns({"a": a, "b": b}).withColumn("m", E.multiplied(F.col("a"), F.col("b")))
    p = p.withColumns({"back": E.inverted(m), "to": E.moved_point(m, F.lit(2.0), F.lit(6.0)), "box": E.box_around(m, F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(4.0))})
    back, box = E.moved_point(F.col("back"), to["x"], to["y"]), F.col("box")
    return p.select("p_partkey", F.element_at(m, 1).alias("a"), F.element_at(m, 6).alias("f"), *[box[c].alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(back["x"], 6).alias("back_x"), F.round(E.clamped(size, 6.0, 24.0), 3).alias("clamped"))


def editor_removed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return E.without_page(rows, "l_orderkey", "l_linenumber", F.col("l_quantity") > 30)


def editor_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("place"))
    return E.to_front(rows, "c_nationkey", "place", F.col("place") % 10 == 3)


def table_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return E.headed_pages(rows, "c_nationkey", ["c_custkey"], "Customer", "c_name")


def longest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.longest(G._view(spark, sf_dir, G.RULES)).select("page", "rule_id")


def tool_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of the category that each order asks for; one order in 7 asks for all."""
    tools = spark.createDataFrame([(n, list(c)) for n, c in CATALOGUE], "name string, categories array<string>")
    names = sorted({c for _, own in CATALOGUE for c in own})
    asked = F.try_element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % (len(names) + 1) + 1).cast("int"))
    wanted = tools.select("name", "categories", F.explode(F.concat("categories", F.array(F.lit("all")))).alias("asked"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(asked, F.lit("all")).alias("asked"))
    return rows.join(F.broadcast(wanted), "asked").select("o_orderkey", "asked", "name", F.array_join("categories", ",").alias("categories"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of events; what is no JSON is an empty object."""
    props = F.from_json("props", "k long")
    rows = table(spark, sf_dir, "events").select("event_type", F.coalesce(props["k"], F.lit(0)).alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page from the top and the left."""
    lines = G._view(spark, sf_dir, G.LINES)
    return lines.select("page", "line_id", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "line_id")).alias("n"))


def slide_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as shapes of slides, orders as the layouts, suppliers as the masters."""
    shapes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey", F.col("l_linenumber").cast("long").alias("idx"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("x"))
    layout = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("page"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 9).alias("idx"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("R").alias("kind"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("x")).where("page % 3 > 0 and x is not null")
    master = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_suppkey").alias("ord"), F.lit("N").alias("kind"), F.col("s_acctbal").alias("x"))
    return E.inherited(shapes, layout, master, "page", "x").select("page", "l_orderkey", "idx", "kind", "x")


QUERIES = {f.__name__: f for f in (editor_annotations, editor_transforms, editor_removed_pages, editor_front, table_with_headers, longest_rules, tool_catalogue, event_properties, reading_order, slide_placeholders)}
SQL = {
    "editor_annotations": "WITH a AS (SELECT l_orderkey AS page, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) AS a FROM lineitem GROUP BY 1) SELECT o_orderkey AS page, coalesce(a, '') AS annotations FROM orders LEFT JOIN a ON o_orderkey = page",
    "editor_transforms": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_size / 8 AS a, 0.5::DOUBLE AS b, -0.25::DOUBLE AS c, p_size / 16 AS d, p_partkey::DOUBLE AS e, 3.0::DOUBLE AS f FROM part),
m AS (SELECT p_partkey, s, -b AS a, a AS b, -d AS c, c AS d, -f + 10 AS e, e + s AS f FROM p),
k AS (SELECT *, unnest([0.0, 0.0, 8.0, 8.0])::DOUBLE AS x, unnest([0.0, 4.0, 0.0, 4.0])::DOUBLE AS y FROM m)
SELECT p_partkey, any_value(a) AS a, any_value(f) AS f, min(a * x + c * y + e) AS x0, min(b * x + d * y + f) AS y0, max(a * x + c * y + e) AS x1, max(b * x + d * y + f) AS y1, CASE WHEN abs(any_value(a * d - b * c)) > 1e-12 THEN 2.0::DOUBLE END AS back_x, greatest(6.0::DOUBLE, least(24.0::DOUBLE, any_value(s))) AS clamped FROM k GROUP BY p_partkey""",
    "editor_removed_pages": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE l_quantity <= 30 OR n = 1",
    "editor_front": "SELECT c_nationkey, c_custkey AS place, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 10 = 3, c_custkey) - 1 AS INTEGER) AS moved FROM customer",
    "table_with_headers": "WITH r AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer) SELECT c_nationkey, CAST(n // 37 AS INTEGER) AS page, CAST(n % 37 + 1 AS INTEGER) AS line, c_name AS text FROM r UNION ALL SELECT DISTINCT c_nationkey, CAST(n // 37 AS INTEGER), 0, 'Customer' FROM r",
    "longest_rules": f"WITH r AS ({G.RULES}), n AS (SELECT *, row_number() OVER (PARTITION BY page, horizontal ORDER BY \"end\" - \"start\" DESC, rule_id) AS n FROM r) SELECT page, rule_id FROM n WHERE n <= CASE WHEN horizontal THEN 80 ELSE 60 END",
    "tool_catalogue": "WITH t(name, categories) AS (VALUES " + ", ".join(f"('{n}', '{','.join(c)}')" for n, c in CATALOGUE) + f"), o AS (SELECT o_orderkey, coalesce({sorted({c for _, own in CATALOGUE for c in own})}[o_orderkey % {len({c for _, own in CATALOGUE for c in own}) + 1} + 1], 'all') AS asked FROM orders) SELECT o_orderkey, asked, name, categories FROM o JOIN t ON asked = 'all' OR list_contains(string_split(categories, ','), asked)",
    "event_properties": "SELECT event_type, count(*) AS n, CAST(sum(coalesce(CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT), 0)) AS BIGINT) AS k FROM events GROUP BY event_type",
    "reading_order": f"WITH l AS ({G.LINES}) SELECT page, line_id, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, line_id) AS INTEGER) AS n FROM l",
    "slide_placeholders": """WITH l AS (SELECT o_custkey % 100 + 1 AS page, o_orderkey AS ord, o_orderkey % 9 AS idx, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'R' END AS kind, o_totalprice AS x FROM orders WHERE (o_custkey % 100 + 1) % 3 > 0 AND o_orderkey % 5 > 0),
a AS (SELECT page, idx, arg_min(x, ord) AS x FROM l GROUP BY page, idx), b AS (SELECT page, kind, arg_min(x, ord) AS x FROM l GROUP BY page, kind)
SELECT l_suppkey AS page, l_orderkey, l_linenumber::BIGINT AS idx, l_returnflag AS kind, coalesce(CASE WHEN l_discount > 0.05::DOUBLE THEN l_quantity END, a.x, b.x, CASE WHEN l_returnflag = 'N' THEN s_acctbal END) AS x
FROM lineitem LEFT JOIN a ON l_suppkey = a.page AND l_linenumber = a.idx LEFT JOIN b ON l_suppkey = b.page AND l_returnflag = b.kind LEFT JOIN supplier ON l_suppkey = s_suppkey""",
}
