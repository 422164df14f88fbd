"""Queries over page geometry, with their SQL. Suppliers are pages; line items, orders and parts stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import geometry as G
from quire.operators.graph import chains
from quire.sources.tables import table

#: The same derivation of page content from the tables, for Spark and DuckDB.
SPANS = """SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS span_id, l_quantity * 10 AS x, l_quantity * 10 + 20 + l_partkey % 60 AS x_end,
CAST(l_orderkey % 700 AS DOUBLE) AS baseline, CAST(8 + l_linenumber AS DOUBLE) AS size, CAST(2 + l_linenumber % 3 AS DOUBLE) AS space, l_orderkey % 50 AS line,
l_returnflag AS style, concat(l_returnflag, CAST(l_partkey AS VARCHAR(20))) AS text
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber)"""
RULES = """SELECT o_custkey % 100 + 1 AS page, o_orderkey AS rule_id, o_orderkey % 3 <> 0 AS horizontal, CAST(o_orderkey * 7 % 700 AS DOUBLE) AS pos, CAST(o_custkey % 300 AS DOUBLE) AS "start",
CAST(o_custkey % 300 + 100 + o_orderkey % 200 AS DOUBLE) AS "end", CAST(o_orderkey % 4 AS DOUBLE) AS thickness FROM orders"""
FILLS = """SELECT p_partkey % 100 + 1 AS page, p_partkey AS fill_id, CAST(p_size * 4 AS DOUBLE) AS x0, CAST(p_partkey * 13 % 500 AS DOUBLE) AS y0, CAST(p_size * 4 + 100 + p_partkey % 300 AS DOUBLE) AS x1,
CAST(p_partkey * 13 % 500 + 50 + p_partkey % 200 AS DOUBLE) AS y1, CASE WHEN p_partkey % 5 = 0 THEN 'FFFFFF' ELSE p_brand END AS color FROM part"""
LINES = """SELECT c_nationkey AS page, c_custkey AS line_id, CAST(c_custkey * 11 % 400 AS DOUBLE) AS x0, CAST(c_custkey * 11 % 400 + 30 + c_custkey % 90 AS DOUBLE) AS x1, CAST(c_custkey * 17 % 780 AS DOUBLE) AS y0,
CAST(c_custkey * 17 % 780 + 10 AS DOUBLE) AS y1, CAST(c_custkey * 17 % 780 + 8 AS DOUBLE) AS baseline, CAST(9 + c_custkey % 3 AS DOUBLE) AS size, c_mktsegment AS shade, c_custkey % 7 = 0 AS marker FROM customer"""


def _view(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    names = ("lineitem", "orders", "part", "customer")
    query = query.replace("VARCHAR(20)", "STRING").replace('"', "`")
    for n in names:
        query = query.replace(f"FROM {n}", f"FROM {{{n}}}")
    used = {n: table(spark, sf_dir, n) for n in names if f"{{{n}}}" in query}
    return spark.sql(query, **used)


def geo_decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decorated(_view(spark, sf_dir, SPANS), _view(spark, sf_dir, RULES)).select("page", "span_id", "underline", "strike")


def geo_shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shaded(_view(spark, sf_dir, LINES), _view(spark, sf_dir, FILLS)).select("page", "line_id", "shading")


def geo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _view(spark, sf_dir, FILLS).select("page", F.col("fill_id").alias("ord"), "x0", "y0", "x1", "y1", F.concat(F.lit("http://x/"), F.col("fill_id").cast("string")).alias("url"))
    return G.linked(_view(spark, sf_dir, SPANS), links).select("page", "span_id", "link")


def geo_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _view(spark, sf_dir, SPANS)
    items = spans.where("style = 'A'").select("page", F.col("span_id").alias("a"), "x", F.col("baseline").alias("y"))
    shows = spans.where("style <> 'A'").select("page", F.col("span_id").alias("b_id"), F.col("x").alias("sx"), (F.col("baseline") + 0.25).alias("sy"))
    return G.banded(items, shows).select("page", "a", "b_id")


def geo_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _view(spark, sf_dir, LINES).withColumnRenamed("line_id", "word_id")
    return G.survivors(words, _view(spark, sf_dir, FILLS)).select("page", "word_id")


def geo_touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to rebuild, as they have a box, and pages to copy."""
    pages, boxes = _view(spark, sf_dir, LINES).select("page").distinct(), _view(spark, sf_dir, FILLS).where("color = 'FFFFFF'")
    return pages.join(boxes, "page", "left_semi").withColumn("rebuilt", F.lit(True)).union(pages.join(boxes, "page", "left_anti").withColumn("rebuilt", F.lit(False)))


def geo_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _view(spark, sf_dir, FILLS).select("page", "fill_id", "x0", "y0", "x1", "y1")
    return G.in_slots(slots, _view(spark, sf_dir, SPANS)).groupBy("page", "s_fill_id").agg(F.count("*").alias("n"), F.min("span_id").alias("first"))


def geo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustered(_view(spark, sf_dir, RULES), ["page"], "pos", 2.5).select("page", "grp", "mean", "n")


def geo_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set in columns 100 wide, 40 of which are taken."""
    lines = _view(spark, sf_dir, LINES).withColumn("x0", F.expr("floor(x0 / 100) * 100D + x0 % 40")).withColumn("x1", F.col("x0") + 10)
    return G.gutters(lines)


def geo_band_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set in bands 100 high, 60 of which are taken."""
    lines = _view(spark, sf_dir, LINES).withColumn("y0", F.expr("floor(y0 / 100) * 100D + y0 % 60"))
    return G.band_cut(lines.withColumns({"y1": F.col("y0") + 10, "baseline": F.col("y0") + 8}))


def geo_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gap_before(_view(spark, sf_dir, LINES), ["page"], "y0", "y1", "line_id").select("page", "line_id", "gap")


def geo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _view(spark, sf_dir, FILLS).select("page", F.col("fill_id").alias("span_id"), F.col("y0").alias("pos"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    return G.covered(_view(spark, sf_dir, RULES).where("horizontal"), wanted).select("page", "span_id", "covered")


def geo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.segments(_view(spark, sf_dir, SPANS)).select("page", "line", "span_id", "segment")


def geo_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.style_runs(_view(spark, sf_dir, SPANS))


def geo_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paragraphs(_view(spark, sf_dir, LINES)).select("page", "line_id", "paragraph")


def geo_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _view(spark, sf_dir, LINES).withColumn("c0", F.lit(0.0)).withColumn("c1", F.lit(500.0)).withColumn("par", F.col("line_id") % 40)
    lines = lines.withColumn("x0", F.when(F.col("par") % 3 == 0, F.lit(1.0)).otherwise(F.col("x0"))).withColumn("x1", F.when(F.col("par") % 4 == 0, F.lit(499.0)).otherwise(F.col("x1")))
    return G.alignment(lines, ["par"])


def geo_column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _view(spark, sf_dir, LINES).select("page", (F.col("line_id") % 4).alias("column"), F.col("x0").alias("left"), (500 - F.col("x1")).alias("right"))
    return G.column_alignment(cells, ["page", "column"])


def geo_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant size of each line of spans: most characters, sizes rounded to a half."""
    return G.weighted_mode(_view(spark, sf_dir, SPANS), ["page", "line"], F.floor(F.col("size") * 2 + 0.5) / 2, F.length("text") + 1, "span_id").select("page", "line", F.col("mode").alias("size"), "w")


def geo_page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter turn that most of a page's text has, if four fifths of it do."""
    turn = F.when(F.col("span_id") % 9 == 0, 90).otherwise(0)
    rows = G.weighted_mode(_view(spark, sf_dir, SPANS), ["page"], turn, F.length("text"), "span_id")
    return rows.select("page", F.when(F.col("share") >= 0.8, F.col("mode")).otherwise(0).alias("turn"))


def geo_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPANS).groupBy("page").agg(G.upper_median("x").alias("x"), G.upper_median("baseline").alias("baseline"))


def geo_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(_view(spark, sf_dir, FILLS), ["page"])


def geo_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _view(spark, sf_dir, LINES).groupBy("page").agg(F.min("x0").alias("left"), (500 - F.max("x1")).alias("right"), F.min("y0").alias("top"), (800 - F.max("y1")).alias("bottom"))
    pages = pages.withColumn("width", F.lit(500) + F.col("page") % 3 * 0.4).withColumn("height", F.lit(800.0))
    return G.common_margins(pages).select("page", "common_left", "common_right", "common_top", "common_bottom")


PIXELS = """SELECT l_suppkey % 20 AS page, l_orderkey % 40 AS x, l_partkey % 30 AS y, CAST(max(l_quantity) * 5 AS INTEGER) AS r, CAST(min(l_quantity) * 5 AS INTEGER) AS g, CAST(max(l_linenumber) * 30 AS INTEGER) AS b FROM lineitem WHERE {w} GROUP BY 1, 2, 3"""


def geo_pixel_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_view(spark, sf_dir, PIXELS.format(w=w)) for w in ("l_returnflag = 'A'", "l_returnflag = 'R'"))
    return G.pixel_change(left, right)


def geo_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_pixel_change(spark, sf_dir).where(F.col("change") > 0.002).select("page")


def geo_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominant_color(_view(spark, sf_dir, PIXELS.format(w="true")), ["page"])


def geo_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = (F.col("r") * 2 + F.col("g") * 5 + F.col("b")) / 2048
    return _view(spark, sf_dir, PIXELS.format(w="true")).select("page", "x", "y", F.round(G.ink(light), 9).alias("ink"))


def geo_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which every ninth line has three characters and the others none."""
    text = _view(spark, sf_dir, LINES).groupBy("page").agg(F.sum(F.when(F.col("line_id") % 9 == 0, 3).otherwise(0)).alias("chars"))
    pictures = _view(spark, sf_dir, FILLS).groupBy("page").agg(F.max(G.area()).alias("picture"))
    pages = text.join(pictures, "page", "left").withColumn("width", F.lit(300.0)).withColumn("height", F.lit(400.0))
    rows = G.scanned(pages)
    return rows.select("page", "scanned", G.cover(F.col("page"), F.col("chars"), F.col("picture").isNotNull()).alias("cover"))


def geo_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bar_chart(_view(spark, sf_dir, FILLS).where("color <> 'FFFFFF'"))


def geo_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.col("span_id") % 13 - 6
    return _view(spark, sf_dir, SPANS).where(F.abs(angle) < 4).groupBy("page").agg(F.count("*").alias("n"))


def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") * 7 % 5 % 3).cast("int").alias("level"))
    return G.list_labels(rows, ["user_id"]).select("user_id", "ord", "level", "label")


def style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles that stand on others, root first; a style in a circle ends where it meets itself."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 97 == 0, F.col("p_partkey") + 1).otherwise(F.floor(F.col("p_partkey") / 3)).alias("base"))
    return chains(rows)


_near = "abs(x - sx) <= 1.5 AND abs(floor(baseline + 0.5) - floor(sy + 0.5)) <= 1"
#: Two words, the second of them cut, as they stand in many documents.
PHRASE_PART = "the wa"


def geo_phrase_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set twelve words to a line, the words of a line a little up and down."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(T.words(F.col("text"))).alias("i", "text"))
    placed = words.select("page", F.col("i").alias("word_id"), F.expr("i % 12 * 50D").alias("x"), F.expr("floor(i / 12) * 14D + i % 3 * 0.125D").alias("y"), (F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("height"), "text")
    return G.phrase_boxes(placed, PHRASE_PART)


QUERIES = {f.__name__: f for f in (geo_phrase_boxes, geo_decorations, geo_shading, geo_links, geo_band_join, geo_survivors, geo_touched_pages, geo_slots, geo_clusters, geo_gutters, geo_band_cuts, geo_spacing, geo_coverage, geo_segments, geo_runs, geo_paragraphs, geo_alignment, geo_column_alignment, geo_font_sizes, geo_page_turns, geo_medians, geo_bounds, geo_margins, geo_pixel_change, geo_changed_pages, geo_colors, geo_signature, geo_page_kinds, geo_bars, geo_horizontal, list_numbers, style_chains)}
_S, _R, _F, _L = f"s AS ({SPANS})", f"r AS ({RULES})", f"f AS ({FILLS})", f"l AS ({LINES})"
_P = lambda name, w: f"{name} AS ({PIXELS.format(w=w)})"
_change = f"WITH {_P('a', chr(108) + '_returnflag = ' + chr(39) + 'A' + chr(39))}, {_P('b', chr(108) + '_returnflag = ' + chr(39) + 'R' + chr(39))}, j AS (SELECT page, a.r IS NULL OR b.r IS NULL OR abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 48 AS c FROM a FULL JOIN b USING (page, x, y)), c AS (SELECT page, least(1.0::DOUBLE, count(*) FILTER (coalesce(c, true)) / count(*)) AS change FROM j GROUP BY page)"
SQL = {
    "geo_phrase_boxes": f"""WITH w AS (SELECT doc_id AS page, unnest(range(len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[^{T.BLANKS}]+') AS p FROM documents)),
o AS (SELECT *, i // 12 AS line, sum(length(t) + 1) OVER (PARTITION BY page, i // 12 ORDER BY i) - length(t) - 1 AS off, i % 12 * 50e0 AS x, i // 12 * 14e0 + i % 3 * 0.125e0 AS y FROM w),
l AS (SELECT page, line, string_split(lower(string_agg(t, ' ' ORDER BY i)), '{PHRASE_PART}') AS p FROM o GROUP BY page, line),
h AS (SELECT page, line, k, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {len(PHRASE_PART)} AS start FROM (SELECT *, unnest(range(1, len(p))) AS k FROM l)),
b AS (SELECT o.page, o.line, k, min(x + greatest(0, start - off) * 5) AS l, max(x + least(length(t), start + {len(PHRASE_PART)} - off) * 5) AS r, min(y) AS t, max(y + 10) AS b FROM h JOIN o ON o.page = h.page AND o.line = h.line AND off + length(t) > start AND off < start + {len(PHRASE_PART)} GROUP BY o.page, o.line, k)
SELECT page, l - 1 AS x, t - 1 AS y, r - l + 2 AS width, b - t + 2 AS height FROM b""",
    "geo_decorations": f"""WITH {_S}, {_R}, t AS (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM r WHERE horizontal AND thickness <= 2), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rule_id) AS k FROM t WHERE n <= 400 OR "end" - "start" > 12),
h AS (SELECT s.page, s.span_id, max(pos - baseline > 0.02::DOUBLE * size AND pos - baseline < 0.26::DOUBLE * size) AS u, max(pos - baseline < -0.15::DOUBLE * size AND pos - baseline > -0.45::DOUBLE * size) AS k FROM s JOIN k ON s.page = k.page AND (n <= 400 OR k.k <= 400) AND x_end > x AND least(x_end, "end") - greatest(x, "start") >= (x_end - x) * 0.6::DOUBLE GROUP BY s.page, s.span_id)
SELECT s.page, s.span_id, coalesce(u, false) AS underline, coalesce(k, false) AS strike FROM s LEFT JOIN h ON s.page = h.page AND s.span_id = h.span_id""",
    "geo_shading": f"WITH {_L}, {_F}, h AS (SELECT l.page, line_id, arg_min(color, ((f.x1 - f.x0) * (f.y1 - f.y0)) * 1000000 + fill_id) AS shading FROM l JOIN f ON l.page = f.page AND color <> 'FFFFFF' AND l.x0 >= f.x0 - 2 AND l.x1 <= f.x1 + 2 AND l.y0 >= f.y0 - 2 AND l.y1 <= f.y1 + 2 GROUP BY ALL) SELECT l.page, l.line_id, shading FROM l LEFT JOIN h ON l.page = h.page AND l.line_id = h.line_id",
    "geo_links": f"WITH {_S}, {_F}, h AS (SELECT s.page, span_id, min(fill_id) AS o FROM s JOIN f ON s.page = f.page AND (x + x_end) / 2 BETWEEN x0 - 1 AND x1 + 1 AND baseline - size * 0.3::DOUBLE BETWEEN y0 - 1 AND y1 + 1 GROUP BY ALL) SELECT s.page, s.span_id, 'http://x/' || o AS link FROM s LEFT JOIN h ON s.page = h.page AND s.span_id = h.span_id",
    "geo_band_join": f"WITH {_S}, q AS (SELECT page, span_id AS b_id, x AS sx, baseline + 0.25::DOUBLE AS sy FROM s WHERE style <> 'A') SELECT s.page, s.span_id AS a, b_id FROM s JOIN q ON s.page = q.page AND {_near} WHERE style = 'A'",
    "geo_survivors": f"WITH {_L}, {_F} SELECT page, line_id AS word_id FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page = l.page AND l.x0 < f.x1 AND l.x1 > f.x0 AND l.y0 < f.y1 AND l.y1 > f.y0)",
    "geo_touched_pages": f"WITH {_L}, {_F} SELECT DISTINCT page, page IN (SELECT page FROM f WHERE color = 'FFFFFF') AS rebuilt FROM l",
    "geo_slots": f"WITH {_S}, {_F} SELECT s.page, fill_id AS s_fill_id, count(*) AS n, min(span_id) AS first FROM s JOIN f ON s.page = f.page AND (x + x_end) / 2 BETWEEN x0 - 1 AND x1 + 1 AND baseline BETWEEN y0 - 1 AND y1 + 1 GROUP BY ALL",
    "geo_clusters": f"WITH {_R}, g AS (SELECT page, pos, CASE WHEN coalesce(pos - lag(pos) OVER (PARTITION BY page ORDER BY pos), 0) > 2.5 THEN 1 ELSE 0 END AS o FROM r), s AS (SELECT page, pos, CAST(sum(o) OVER (PARTITION BY page ORDER BY pos) AS BIGINT) AS grp FROM g) SELECT page, grp, sum(pos) / count(*) AS mean, count(*) AS n FROM s GROUP BY page, grp",
    "geo_gutters": f"WITH {_L}, n AS (SELECT page, line_id, floor(x0 / 100) * 100 + x0 % 40 AS x0, floor(x0 / 100) * 100 + x0 % 40 + 10 AS x1 FROM l), p AS (SELECT page, min(x0) AS p0, max(x1) AS p1 FROM n GROUP BY page), g AS (SELECT page, x0, max(x1) OVER (PARTITION BY page ORDER BY x0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n) SELECT g.page, reach AS g0, x0 AS g1 FROM g JOIN p ON g.page = p.page WHERE x0 - reach >= 16 AND reach - p0 >= greatest(40, (p1 - p0) * 0.12::DOUBLE) AND p1 - x0 >= greatest(40, (p1 - p0) * 0.12::DOUBLE)",
    "geo_band_cuts": f"WITH {_L}, k AS (SELECT page, line_id, floor(y0 / 100) * 100 + y0 % 60 AS y0, floor(y0 / 100) * 100 + y0 % 60 + 10 AS y1, floor(y0 / 100) * 100 + y0 % 60 + 8 AS baseline FROM l), n AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, baseline - lag(baseline) OVER (PARTITION BY page ORDER BY y0, line_id) AS lead FROM k), m AS (SELECT page, list_sort(list(lead))[len(list(lead)) // 2 + 1] AS typical FROM n WHERE lead > 0 GROUP BY page), c AS (SELECT n.page, line_id, y0, y0 - reach AS gap, row_number() OVER (PARTITION BY n.page ORDER BY y0 - reach DESC, y0, line_id) AS k FROM n LEFT JOIN m ON n.page = m.page WHERE y0 - reach > greatest(coalesce(typical, 0) * 1.9::DOUBLE, 9)) SELECT page, gap, line_id FROM c WHERE k = 1",
    "geo_spacing": f"WITH {_L} SELECT page, line_id, y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM l",
    "geo_coverage": f"""WITH {_R}, {_F}, n AS (SELECT DISTINCT f.page, fill_id, f.x0 AS low, f.x1 AS high, "start", "end" FROM f JOIN r ON f.page = r.page AND horizontal AND abs(pos - y0) <= 2.5 AND "end" > x0 + 0.5 AND "start" < x1 - 0.5),
w AS (SELECT *, greatest(low, coalesce(max("end") OVER (PARTITION BY page, fill_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low)) AS reach FROM n),
b AS (SELECT *, max(CASE WHEN "start" > reach + 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, fill_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS broken FROM w),
x AS (SELECT page, fill_id, max("end") AS reach FROM b WHERE broken = 0 GROUP BY ALL) SELECT f.page, f.fill_id AS span_id, coalesce(x.reach >= f.x1 - 1.5, false) AS covered FROM f LEFT JOIN x ON f.page = x.page AND f.fill_id = x.fill_id""",
    "geo_segments": f"WITH {_S}, g AS (SELECT *, coalesce(x - lag(x_end) OVER w > greatest(6, greatest(space, lag(space) OVER w) * 3.2::DOUBLE), false) AS o FROM s WINDOW w AS (PARTITION BY page, line ORDER BY x, span_id)) SELECT page, line, span_id, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x, span_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g",
    "geo_runs": f"""WITH {_S}, g AS (SELECT *, NOT coalesce(lag(style) OVER w = style AND abs(lag(size) OVER w - size) < 0.35, false) AS o, coalesce(NOT (length(lag(text) OVER w) <= 1 AND length(text) <= 1) AND x - lag(x_end) OVER w > greatest(lag(space) OVER w, space) * 0.85::DOUBLE, false) AS sp FROM s WINDOW w AS (PARTITION BY page, line ORDER BY x, span_id)),
n AS (SELECT *, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x, span_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g) SELECT page, line, run, string_agg(CASE WHEN NOT o AND sp THEN ' ' ELSE '' END || text, '' ORDER BY x, span_id) AS text, min(x) AS x, max(x_end) AS x_end FROM n GROUP BY page, line, run""",
    "geo_paragraphs": f"WITH {_L}, g AS (SELECT *, NOT coalesce(y0 - lag(y1) OVER w <= size * 0.6::DOUBLE AND abs(lag(size) OVER w - size) < 0.6 AND lag(shade) OVER w = shade AND NOT marker, false) AS o FROM l WINDOW w AS (PARTITION BY page ORDER BY y0, line_id)) SELECT page, line_id, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM g",
    "geo_alignment": f"WITH {_L}, a AS (SELECT line_id % 40 AS par, CASE WHEN line_id % 40 % 3 = 0 THEN 1 ELSE x0 END AS x0, CASE WHEN line_id % 40 % 4 = 0 THEN 499 ELSE x1 END AS x1 FROM l), m AS (SELECT par, max(abs(x0)) AS l, max(abs(500 - x1)) AS r, max(abs((x0 + x1) / 2 - 250)) AS c, count(*) AS n FROM a GROUP BY par) SELECT par, CASE WHEN l <= 2 AND r <= 2 AND n > 1 THEN 'justify' WHEN l <= 2 THEN 'left' WHEN r <= 2 THEN 'right' WHEN c <= 2 THEN 'center' ELSE 'left' END AS align FROM m",
    "geo_column_alignment": f"WITH {_L}, c AS (SELECT page, line_id % 4 AS \"column\", max(x0) - min(x0) AS ls, max(500 - x1) - min(500 - x1) AS rs FROM l GROUP BY 1, 2) SELECT page, \"column\", CASE WHEN rs < ls - 1 THEN 'right' WHEN abs(ls - rs) <= 1 THEN 'center' ELSE 'left' END AS align, ls AS left_spread, rs AS right_spread FROM c",
    "geo_font_sizes": f"WITH {_S}, g AS (SELECT page, line, floor(size * 2 + 0.5) / 2 AS z, CAST(sum(length(text) + 1) AS BIGINT) AS w, min(span_id) AS f FROM s GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY w DESC, f) AS k FROM g) SELECT page, line, z AS size, w FROM k WHERE k = 1",
    "geo_page_turns": f"WITH {_S}, g AS (SELECT page, CASE WHEN span_id % 9 = 0 THEN 90 ELSE 0 END AS t, sum(length(text)) AS w, min(span_id) AS f FROM s GROUP BY 1, 2), k AS (SELECT *, w / sum(w) OVER (PARTITION BY page) AS share, row_number() OVER (PARTITION BY page ORDER BY w DESC, f) AS k FROM g) SELECT page, CASE WHEN share >= 0.8 THEN t ELSE 0 END AS turn FROM k WHERE k = 1",
    "geo_medians": f"WITH {_S} SELECT page, list_sort(list(x))[count(*) // 2 + 1] AS x, list_sort(list(baseline))[count(*) // 2 + 1] AS baseline FROM s GROUP BY page",
    "geo_bounds": f"WITH {_F} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f GROUP BY page",
    "geo_margins": f"WITH {_L}, p AS (SELECT page, min(x0) AS l, 500 - max(x1) AS r, min(y0) AS t, 800 - max(y1) AS b, floor(500 + page % 3 * 0.4::DOUBLE + 0.5) AS w FROM l GROUP BY page) SELECT page, min(l) OVER q AS common_left, min(r) OVER q AS common_right, min(t) OVER q AS common_top, min(b) OVER q AS common_bottom FROM p WINDOW q AS (PARTITION BY w)",
    "geo_pixel_change": f"{_change} SELECT page, change FROM c",
    "geo_changed_pages": f"{_change} SELECT page FROM c WHERE change > 0.002",
    "geo_colors": f"WITH {_P('p', 'true')}, s AS (SELECT page, floor(r / (256 / 24::DOUBLE)) AS rb, floor(g / (256 / 24::DOUBLE)) AS gb, floor(b / (256 / 24::DOUBLE)) AS bb, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM p GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, rb, gb, bb) AS k FROM s) SELECT page, CAST(floor(r / n + 0.5) AS INTEGER) AS r, CAST(floor(g / n + 0.5) AS INTEGER) AS g, CAST(floor(b / n + 0.5) AS INTEGER) AS b, n FROM k WHERE k = 1",
    "geo_signature": f"WITH {_P('p', 'true')} SELECT page, x, y, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.75::DOUBLE - (r * 2 + g * 5 + b) / 2048) / 0.35::DOUBLE)), 9) AS ink FROM p",
    "geo_page_kinds": f"WITH {_L}, {_F}, t AS (SELECT page, sum(CASE WHEN line_id % 9 = 0 THEN 3 ELSE 0 END) AS chars FROM l GROUP BY page), p AS (SELECT page, max((x1 - x0) * (y1 - y0)) AS picture FROM f GROUP BY page) SELECT t.page, chars < 24 AND coalesce(picture, 0) >= 300.0::DOUBLE * 400 * 0.55::DOUBLE AS scanned, t.page = 1 AND ((chars <= 40 AND picture IS NOT NULL) OR (chars = 0 AND picture IS NULL) OR (chars <= 800 AND picture IS NOT NULL)) AS cover FROM t LEFT JOIN p ON t.page = p.page",
    "geo_bars": f"WITH {_F}, g AS (SELECT page, count(*) AS n, count(DISTINCT floor((x1 - x0) / 2 + 0.5)) AS widths, count(DISTINCT floor((y1 - y0) / 2 + 0.5)) AS heights FROM f WHERE color <> 'FFFFFF' GROUP BY page) SELECT *, n >= 4 AND (widths >= 3 OR heights >= 3) AS bars FROM g",
    "geo_horizontal": f"WITH {_S} SELECT page, count(*) AS n FROM s WHERE abs(span_id % 13 - 6) < 4 GROUP BY page",
    "list_numbers": """WITH e AS (SELECT user_id, event_id AS ord, CAST(event_id * 7 % 5 % 3 AS INTEGER) AS level FROM events),
a AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c0 FROM e),
b AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, c0 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c1 FROM a),
c AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, c0, c1 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c2 FROM b)
SELECT user_id, ord, level, greatest(c0, 1) || CASE WHEN level >= 1 THEN '.' || greatest(c1, 1) ELSE '' END || CASE WHEN level >= 2 THEN '.' || greatest(c2, 1) ELSE '' END AS label FROM c""",
    "style_chains": """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 1 ELSE p_partkey // 3 END AS base FROM part),
chain(id, pos, depth, path) AS (SELECT id, base, 0, '/' || id || '/' FROM p UNION ALL SELECT c.id, s.base, c.depth + 1, c.path || s.id || '/' FROM chain c JOIN p s ON c.pos = s.id WHERE c.depth < 20 AND instr(c.path, '/' || s.id || '/') = 0)
SELECT id, max(depth) AS depth, arg_max(path, depth) AS path FROM chain GROUP BY id""",
}
