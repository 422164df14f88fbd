"""Queries over page algebra, with their SQL. Orders are documents, their line items pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import pages as P
from quire.sources.tables import table

#: Page selections as users write them, sound and unsound.
SELECTIONS = ("1-3, 5, 8-10", "5-3", "x,2", "4-", "-3", " 2 - 4 ", "", "1,1,2", "9-99", "0-2", "7")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages numbered 1.. in each order, whatever the line numbers."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _pages(spark, sf_dir).withColumn("page", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("l_orderkey")).cast("int"))


def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a selection made of each order's numbers names, of 10 to 14."""
    written = F.element_at(F.array(*map(F.lit, SELECTIONS)), (F.col("o_orderkey") % len(SELECTIONS) + 1).cast("int"))
    text = F.concat(written, F.lit(","), F.col("o_custkey") % 13, F.lit(" - "), F.col("o_orderkey") % 17)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", P.selection(text, (F.col("o_custkey") % 5 + 10).cast("int")).alias("p"))
    return rows.select("o_orderkey", F.array_join("p", ",").alias("pages"), P.selection_text(F.col("p")).alias("again"))


def page_selection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each order with a discount, as text."""
    picked = _numbered(spark, sf_dir).where("l_discount >= 0.05").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("page") - 1)).alias("p"))
    return picked.select("l_orderkey", P.selection_text(F.col("p")).alias("pages"))


def page_fixed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").cast("int").alias("total"), (F.max("l_suppkey") % 3 + 1).cast("int").alias("every"))
    return sizes.select("l_orderkey", F.posexplode(P.fixed_ranges(F.col("total"), F.col("every"))).alias("ord", "r")).select("l_orderkey", "ord", "r.start", "r.stop")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    r = P.ordered_range((F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 7).cast("int"))
    return rows.select("l_orderkey", "ord", r.alias("r")).where("r is not null").select("l_orderkey", "ord", "r.start", "r.stop")


def page_custom_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _numbered(spark, sf_dir).select("l_orderkey", "page", "l_partkey")
    return P.split_pages(pages, _ranges(spark, sf_dir), "l_orderkey", "page").select("l_orderkey", "ord", "page", "l_partkey")


def page_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_parts(_numbered(spark, sf_dir).select("l_orderkey", "page"), _ranges(spark, sf_dir), "l_orderkey", "page")


def page_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").cast("int").alias("total"), (F.max("l_partkey") % 5).cast("int").alias("first"), (F.max("l_suppkey") % 6).cast("int").alias("last"))
    r = P.clamped_range(F.col("first"), F.col("last"), F.col("total"))
    return sizes.select("l_orderkey", r["start"].alias("start"), r["stop"].alias("stop"))


def page_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = (F.col("l_quantity") * 37 - 500).cast("double")
    return _numbered(spark, sf_dir).select("l_orderkey", "page", P.normal_rotation(turn).alias("rotation"), F.pmod(P.normal_rotation(turn) + 90, F.lit(360)).cast("int").alias("turned"))


def page_arranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the order of a plan with repeats and sources that do not exist."""
    pages = _numbered(spark, sf_dir)
    plan = pages.select("l_orderkey", F.col("page").alias("ord"), (F.col("l_partkey") % (F.col("total") + 1)).cast("int").alias("source"), (F.col("l_suppkey") % 4 * 90).alias("turn"))
    return P.arranged(pages.select("l_orderkey", "page", F.col("l_partkey").alias("content")), plan, "l_orderkey", "page").select("l_orderkey", "place", "page", "content", "turn")


def page_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _numbered(spark, sf_dir).select("l_orderkey", "page", "l_quantity")
    return P.without_pages(pages, pages.where("l_quantity > 20"), "l_orderkey", "page")


def page_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, then all suppliers, as pages of one file."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("content"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_name").alias("content"))
    return P.merged(a, b).select("part", "page", "content")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _numbered(spark, sf_dir)
    low, high = F.lit(2), F.col("total")
    label = P.page_label(F.lit("– {n} of {N} é"), F.col("page") - low, F.lit(5), high - low + 1)
    return pages.where(F.col("page") >= low).select("l_orderkey", "page", label.alias("label"))


def page_running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _numbered(spark, sf_dir).withColumn("s", F.explode(P.slots(F.lit(612.0), F.lit(792.0), F.col("l_quantity"), F.col("l_quantity") * 2)))
    return pages.select("l_orderkey", "page", "s.slot", "s.x", "s.y", P.running_text(F.lit("Page {n} of {N}"), F.col("page"), F.col("total")).alias("label"))


def page_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotation = (F.col("l_linenumber") % 4 * 90).cast("int")
    q = F.col("l_quantity")
    box = P.cropped(F.lit(600.0), F.lit(800.0), rotation, q / 64, q / 128, q / 256, F.lit(0.125))
    return _numbered(spark, sf_dir).select("l_orderkey", "page", *[box[c].alias(c) for c in ("x", "y", "width", "height")])


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.lit(" "), F.col("p_name"), F.lit(" ;, "), F.col("p_brand"), F.lit(","), F.col("p_type"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.keywords(words), "|").alias("keywords"), F.size(P.keywords(words, "[,; \t]+")).alias("repaired"))


def page_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.watermark_place(F.lit(600.0), F.lit(800.0), F.col("l_quantity") * 8, F.lit(48.0), F.col("l_linenumber") * 15.0)
    return _numbered(spark, sf_dir).select("l_orderkey", "page", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return P.latest(events, "user_id", "event_id", 60).select("user_id", "event_id", "event_type", "step")


def page_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _numbered(spark, sf_dir).select("l_orderkey", (F.col("page") - 1).alias("place"), "l_quantity", "l_partkey")
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "place"))
    items = items.withColumn("n", first)
    return P.moved(items, "l_orderkey", "place", F.col("n") == 1, 2).select("l_orderkey", "place", "l_partkey", "moved")


def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as table pages of 37 rows and text pages of 42 lines, by nation."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    a = P.table_pages(rows, "c_nationkey", ["c_custkey"], 37)
    b = P.table_pages(rows, "c_nationkey", ["c_custkey"], 42).select("c_custkey", F.col("page").alias("text_page"), F.col("line").alias("text_line"))
    return a.join(b, "c_custkey").select("c_nationkey", "c_custkey", "page", "line", "text_page", "text_line")


def page_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each order again behind itself, and the pages after it moved on."""
    pages = _numbered(spark, sf_dir).select("l_orderkey", "page", "l_partkey")
    again = pages.where("page = 1").withColumn("copy", F.lit(True))
    rows = pages.withColumn("copy", F.lit(False)).unionByName(again)
    return rows.select("l_orderkey", (F.col("page") + F.when((F.col("page") > 1) | F.col("copy"), 1).otherwise(0)).alias("page"), "l_partkey", "copy")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("l_orderkey", "page", P.image_names(F.col("page"), F.col("total") * 100, F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")), "png").alias("name"))


N = "n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS page, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS total FROM lineitem)"
RANGES = f"{N}, ranges AS (SELECT l_orderkey, page AS ord, CAST(least(l_partkey % 9, l_suppkey % 7) AS INTEGER) AS start, CAST(greatest(l_partkey % 9, l_suppkey % 7) AS INTEGER) AS stop FROM n WHERE least(l_partkey % 9, l_suppkey % 7) >= 1)"
ROT = "CAST(((floor((l_quantity * 37 - 500) / 90 + 0.5) * 90) % 360 + 360) % 360 AS INTEGER)"
RUNS = "runs AS (SELECT {k}, min(page) AS a, max(page) AS b FROM (SELECT {k}, page, page - row_number() OVER (PARTITION BY {k} ORDER BY page) AS g FROM picked) GROUP BY {k}, g)"
TEXT = "string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a)"
SEL = ", ".join(f"'{s}'" for s in SELECTIONS)
QUERIES = {f.__name__: f for f in (page_selections, page_selection_texts, page_fixed_ranges, page_custom_ranges, page_split, page_split_parts, page_clamped, page_rotation, page_arranged, page_removed, page_merged, page_labels, page_running_text, page_crops, page_metadata, page_watermarks, page_history, page_moves, page_of_rows, page_duplicates, page_images)}
SQL = {
    "page_selections": f"""WITH s AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 + 10 AS INTEGER) AS total, [{SEL}][o_orderkey % {len(SELECTIONS)} + 1] || ',' || (o_custkey % 13) || ' - ' || (o_orderkey % 17) AS s FROM orders), c AS (SELECT id, total, unnest(string_split(s, ',')) AS c FROM s),
e AS (SELECT id, total, try_cast(nullif(regexp_extract(string_split(trim(c), '-')[1], '^[ \\t]*([+-]?[0-9]+)', 1), '') AS INTEGER) AS a, try_cast(nullif(regexp_extract(coalesce(string_split(trim(c), '-')[2], ''), '^[ \\t]*([+-]?[0-9]+)', 1), '') AS INTEGER) AS b FROM c),
picked AS (SELECT DISTINCT id, unnest(range(greatest(1, a), least(total, coalesce(b, a)) + 1)) AS page FROM e WHERE a IS NOT NULL), {RUNS.format(k='id')},
t AS (SELECT id, {TEXT} AS again FROM runs GROUP BY id), l AS (SELECT id, string_agg((page - 1)::VARCHAR, ',' ORDER BY page) AS pages FROM picked GROUP BY id)
SELECT s.id AS o_orderkey, coalesce(pages, '') AS pages, coalesce(again, '') AS again FROM s LEFT JOIN t ON s.id = t.id LEFT JOIN l ON s.id = l.id""",
    "page_selection_texts": f"WITH {N}, picked AS (SELECT l_orderkey, page FROM n WHERE l_discount >= 0.05), {RUNS.format(k='l_orderkey')} SELECT l_orderkey, {TEXT} AS pages FROM runs GROUP BY l_orderkey",
    "page_fixed_ranges": "WITH s AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS total, CAST(max(l_suppkey) % 3 + 1 AS INTEGER) AS every FROM lineitem GROUP BY l_orderkey), r AS (SELECT l_orderkey, total, every, unnest(range(1, total + 1, every)) AS start FROM s) SELECT l_orderkey, CAST((start - 1) // every AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, CAST(least(total, start + every - 1) AS INTEGER) AS stop FROM r",
    "page_custom_ranges": f"WITH {RANGES} SELECT * FROM ranges",
    "page_split": f"WITH {RANGES} SELECT r.l_orderkey, r.ord, n.page, n.l_partkey FROM ranges r JOIN n ON r.l_orderkey = n.l_orderkey AND n.page BETWEEN r.start AND r.stop",
    "page_split_parts": f"WITH {RANGES}, c AS (SELECT l_orderkey, max(total) AS total FROM n GROUP BY l_orderkey), x AS (SELECT r.*, c.total, CAST(greatest(0, least(c.total, r.stop) - r.start + 1) AS INTEGER) AS k FROM ranges r JOIN c ON r.l_orderkey = c.l_orderkey) SELECT l_orderkey, ord, k > 0 AS ok, k AS n, CASE WHEN k > 0 THEN format('Pages {{}}-{{}} extracted', start, stop) ELSE format('Pages {{}}-{{}} are out of range (document has {{}} page{{}}).', start, stop, total, CASE WHEN total = 1 THEN '' ELSE 's' END) END AS message FROM x",
    "page_clamped": "WITH s AS (SELECT l_orderkey, count(*) AS total, max(l_partkey) % 5 AS f, max(l_suppkey) % 6 AS l FROM lineitem GROUP BY l_orderkey), x AS (SELECT l_orderkey, greatest(1, least(CASE WHEN f = 0 THEN 1 ELSE f END, total)) AS a, CASE WHEN l > 0 THEN least(l, total) ELSE total END AS b FROM s) SELECT l_orderkey, CASE WHEN b >= a THEN CAST(a AS INTEGER) END AS start, CASE WHEN b >= a THEN CAST(b AS INTEGER) END AS stop FROM x",
    "page_rotation": f"WITH {N} SELECT l_orderkey, page, {ROT} AS rotation, ({ROT} + 90) % 360 AS turned FROM n",
    "page_arranged": f"WITH {N}, plan AS (SELECT l_orderkey, page AS ord, l_partkey % (total + 1) AS source, l_suppkey % 4 * 90 AS turn FROM n) SELECT p.l_orderkey, CAST(row_number() OVER (PARTITION BY p.l_orderkey ORDER BY p.ord) AS INTEGER) AS place, n.page, n.l_partkey AS content, CAST(p.turn AS INTEGER) AS turn FROM plan p JOIN n ON p.l_orderkey = n.l_orderkey AND n.page = p.source + 1",
    "page_removed": f"WITH {N} SELECT l_orderkey, page, l_quantity FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS low FROM n) WHERE l_quantity <= 20 OR low > 20",
    "page_merged": "SELECT 0 AS part, p_partkey AS page, p_name AS content FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier",
    "page_labels": f"WITH {N} SELECT l_orderkey, page, ' ' || (page + 3) || ' of ' || (total + 3) || ' é' AS label FROM n WHERE page >= 2",
    "page_running_text": f"WITH {N}, s AS (SELECT *, greatest(6.0, least(24.0, l_quantity))::DOUBLE AS sz, greatest(12.0, l_quantity * 2)::DOUBLE AS m FROM n), k AS (SELECT *, unnest(['left', 'center', 'right']) AS h FROM s), v AS (SELECT *, unnest(['header', 'footer']) AS v FROM k) SELECT l_orderkey, page, v || '-' || h AS slot, CASE h WHEN 'left' THEN m WHEN 'center' THEN 306.0::DOUBLE ELSE 612.0::DOUBLE - m END AS x, CASE v WHEN 'header' THEN 792.0::DOUBLE - m ELSE greatest(4.0::DOUBLE, m - sz) END AS y, 'Page ' || page || ' of ' || total AS label FROM v",
    "page_crops": f"""WITH {N}, i AS (SELECT *, CAST(l_linenumber % 4 * 90 AS INTEGER) AS rot, l_quantity / 64 AS l, l_quantity / 128 AS r, l_quantity / 256 AS t, 0.125::DOUBLE AS b FROM n),
v AS (SELECT *, CASE WHEN rot IN (90, 270) THEN 800.0::DOUBLE ELSE 600.0::DOUBLE END AS w, CASE WHEN rot IN (90, 270) THEN 600.0::DOUBLE ELSE 800.0::DOUBLE END AS h FROM i),
c AS (SELECT *, l * w AS x0, w - r * w AS x1, b * h AS y0, h - t * h AS y1 FROM v),
p AS (SELECT *, CASE rot WHEN 90 THEN 600 - y0 WHEN 180 THEN 600 - x0 WHEN 270 THEN y0 ELSE x0 END AS ax, CASE rot WHEN 90 THEN x0 WHEN 180 THEN 800 - y0 WHEN 270 THEN 800 - x0 ELSE y0 END AS ay, CASE rot WHEN 90 THEN 600 - y1 WHEN 180 THEN 600 - x1 WHEN 270 THEN y1 ELSE x1 END AS bx, CASE rot WHEN 90 THEN x1 WHEN 180 THEN 800 - y1 WHEN 270 THEN 800 - x1 ELSE y1 END AS ey FROM c),
q AS (SELECT *, l + r < 0.95::DOUBLE AND t + b < 0.95::DOUBLE AND abs(bx - ax) >= 1 AND abs(ey - ay) >= 1 AS fits FROM p)
SELECT l_orderkey, page, CASE WHEN fits THEN least(ax, bx) END AS x, CASE WHEN fits THEN least(ay, ey) END AS y, CASE WHEN fits THEN abs(bx - ax) END AS width, CASE WHEN fits THEN abs(ey - ay) END AS height FROM q""",
    "page_metadata": "WITH m AS (SELECT p_partkey, ' ' || p_name || ' ;, ' || p_brand || ',' || p_type || ' ' AS k FROM part) SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(k, '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords, CAST(len(list_filter(string_split_regex(k, '[,; \\t]+'), lambda x: x <> '')) AS INTEGER) AS repaired FROM m",
    "page_watermarks": f"WITH {N} SELECT l_orderkey, page, round(300 - l_quantity * 4 * cos(radians(l_linenumber * 15.0::DOUBLE)) + 24 * sin(radians(l_linenumber * 15.0::DOUBLE)), 3) AS x, round(400 - l_quantity * 4 * sin(radians(l_linenumber * 15.0::DOUBLE)) - 24 * cos(radians(l_linenumber * 15.0::DOUBLE)), 3) AS y FROM n",
    "page_history": "SELECT * FROM (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS step FROM events) WHERE step <= 60",
    "page_moves": f"""WITH {N}, i AS (SELECT l_orderkey, page - 1 AS place, l_partkey, total - 1 AS last, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, page) = 1 AS c FROM n),
a AS (SELECT *, max(CASE WHEN c THEN place END) OVER (PARTITION BY l_orderkey) AS pos FROM i)
SELECT l_orderkey, place, l_partkey, CAST(CASE WHEN pos + 2 > last THEN place WHEN c THEN pos + 2 WHEN place > pos AND place <= pos + 2 THEN place - 1 ELSE place END AS INTEGER) AS moved FROM a""",
    "page_of_rows": "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer) SELECT c_nationkey, c_custkey, CAST(n // 37 AS INTEGER) AS page, CAST(n % 37 AS INTEGER) AS line, CAST(n // 42 AS INTEGER) AS text_page, CAST(n % 42 AS INTEGER) AS text_line FROM r",
    "page_duplicates": f"WITH {N} SELECT l_orderkey, CASE WHEN page > 1 THEN page + 1 ELSE page END AS page, l_partkey, false AS copy FROM n UNION ALL SELECT l_orderkey, 2, l_partkey, true FROM n WHERE page = 1",
    "page_images": f"WITH {N} SELECT l_orderkey, page, 'order-' || l_orderkey || '-' || lpad(page::VARCHAR, CAST(length((total * 100)::VARCHAR) AS INTEGER), '0') || '.png' AS name FROM n",
}
