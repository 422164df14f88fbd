"""Queries over spreadsheet operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import sheets as S
from quire.sources.tables import table


def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written by each part, of which three in seven are none: in small letters, without row, without column."""
    letters, digits = S.column_letters((F.col("p_partkey") * 7) % 18_000), (F.col("p_size") + 1).cast("string")
    way, ref = F.col("p_partkey") % 7, F.concat(letters, digits)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(way == 1, F.lower(ref)).when(way == 2, letters).when(way == 3, digits).otherwise(ref).alias("ref"))
    r = S.reference(F.col("ref"))
    return rows.select("p_partkey", "ref", r["row"].alias("row"), r["col"].alias("col"))


def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.column_letters((F.col("p_partkey") * 9) % 18_000).alias("name"))


def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders as serial numbers and back; one order in five has one of the first hundred, around the day that never was."""
    serial = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 100 + 1).otherwise(F.datediff(F.col("o_orderdate"), F.lit("1899-12-31").cast("date")) + 1)
    return table(spark, sf_dir, "orders").select(serial.cast("double").alias("serial")).select("serial", S.serial_date(F.col("serial")).cast("string").alias("day"))


def serial_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.col("o_orderkey") % 60_000 + F.floor(F.col("o_totalprice")) % 1024 / 1024.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(S.serial_instant(serial), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


CODES = tuple(S.BUILTIN.values()) + ('"d"0', "yyyy", '[h]:mm', "0.00E+00", "[Red]0", "")


def date_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the code of each part, one of those above behind its own text, is one of dates."""
    code = F.concat(F.element_at(F.array(*map(F.lit, CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int")), F.lit('"'), F.col("p_name"), F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), S.is_date_code(code).alias("is_date"))


def fixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest formats as expressions: 0.00, #,##0.00, #,##0 and 0%."""
    v = F.col("o_totalprice") - 200_000
    sign = F.when(v < 0, "-").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.concat(sign, x).alias(n) for n, x in (("fixed", S.fixed(v, 2)), ("grouped", S.grouped(S.fixed(v, 2))), ("whole", S.grouped(S.fixed(v, 0))), ("percent", F.concat(S.fixed(v / 1024, 0), F.lit("%"))))])


def cell_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices under every built-in format."""
    codes = F.array(*map(F.lit, CODES))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 1000).alias("v"), F.element_at(codes, (F.col("o_orderkey") % len(CODES) + 1).cast("int")).alias("code"))
    return rows.select("o_orderkey", "code", S.format_cell("v", "code").alias("text"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("s", "inlineStr", "str", "b", "e", "n", "n")))
    raws = F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.lit(None).cast("string"), (F.col("l_linenumber") % 2).cast("string"), F.lit(None).cast("string"), F.col("l_quantity").cast("string"), F.lit("x"))
    i = (F.col("l_suppkey") % 7 + 1).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.element_at(kinds, i).alias("kind"), F.element_at(raws, i).alias("raw"), (F.col("l_partkey") % 5).alias("style_id"))


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells; shared strings are the names of the even parts."""
    shared = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("raw"), F.col("p_name").alias("shared"))
    rows = _cells(spark, sf_dir).join(shared, "raw", "left")
    c = S.cell_text(F.col("kind"), F.col("raw"), F.col("shared"), F.col("style_id"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "kind", c["text"].alias("text"), c["number"].alias("number"))


def cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = spark.createDataFrame([(0, 0, 0), (1, 1, 2), (2, 9, 1), (3, 2, 9)], "style_id long, font_id int, fill_id int").coalesce(1)
    fonts = spark.createDataFrame([(0, False), (1, True), (2, True)], "font_id int, bold boolean").coalesce(1)
    fills = spark.createDataFrame([(1, "FF0000"), (2, "00FF00")], "fill_id int, color string").coalesce(1)
    return S.styled(_cells(spark, sf_dir), styles, fonts, fills).groupBy("style_id", "bold", "color").agg(F.count("*").alias("n"))


def cell_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    cells = items.select(F.col("l_orderkey").alias("sheet"), (F.col("l_partkey") % 6).cast("int").alias("row"), (F.col("l_suppkey") % 5).cast("int").alias("col")).distinct()
    merges = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("sheet"), (F.col("l_partkey") % 4).cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"), (F.col("l_quantity") % 3 + 1).cast("int").alias("rows"), F.lit(2).alias("cols"))
    return S.merge_cells(cells, merges, ["sheet"]).select("sheet", "row", "col", "anchor_row", "anchor_col")


def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a grid: revenue of each ship year by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_quantity")
    return rows.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))


def sheet_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_discount") > 0.01, F.col("l_quantity") * 6)).alias("w"), F.count_if(F.col("l_discount") <= 0.01).alias("none"))
    s = S.sheet_scale(F.concat(F.col("w"), F.array_repeat(F.lit(None).cast("double"), F.col("none").cast("int"))))
    return widths.select("l_orderkey", F.round(s["natural"], 6).alias("natural"), s["landscape"].alias("landscape"), F.round(s["scale"], 9).alias("scale"))


def column_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the columns of a table from its longest texts."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(F.length("c_name")).alias("chars"), F.max("c_acctbal").alias("points"))
    return rows.select("c_nationkey", S.char_width(F.col("chars")).cast("double").alias("points"), S.chars_of(F.col("points")).alias("chars"))


def theme_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.lpad(F.hex((F.col("p_partkey") * 7919) % 16_777_216), 6, "0")
    tint = (F.col("p_size") - 25) / 64
    c = S.hex_rgb(F.concat(F.lit("#"), rgb))
    return table(spark, sf_dir, "part").select("p_partkey", rgb.alias("rgb"), S.tinted(rgb, tint).alias("tinted"), F.round(c[0], 6).alias("red"), F.round(c[2], 6).alias("blue"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one long sheet for each flag, with a note beyond the limit."""
    w = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), (F.row_number().over(w) - 1).alias("row"), F.lit(0).alias("col"), F.col("l_partkey").cast("string").alias("text"))
    return S.limited(rows, ["sheet"])


def sheet_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation stacked on a sheet: the assistant's are tables of as many rows as they have lines."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "table").otherwise("paragraph").alias("kind"), F.size(F.split("text", "\n")).alias("rows"), "text")
    return S.stacked(rows, ["conv_id"]).select("conv_id", "ord", "kind", "first_row")


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type")
    return S.unique_names(rows, ["p_brand"], "p_partkey", "p_type").select("p_brand", "p_partkey", "unique_name")


_L = "CASE WHEN {m} < 26 THEN chr(CAST(65 + {m} AS INTEGER)) WHEN {m} < 702 THEN chr(CAST(65 + ({m} - 26) // 26 AS INTEGER)) || chr(CAST(65 + ({m} - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + ({m} - 702) // 676 AS INTEGER)) || chr(CAST(65 + (({m} - 702) // 26) % 26 AS INTEGER)) || chr(CAST(65 + ({m} - 702) % 26 AS INTEGER)) END"
_FIX2 = "(n // 100) || '.' || lpad((n % 100)::VARCHAR, 2, '0')"
_CODES = ", ".join("'{}'".format(c.replace("'", "''")) for c in CODES)
CELLS = "cells AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey % 5 AS style_id, ['s', 'inlineStr', 'str', 'b', 'e', 'n', 'n'][l_suppkey % 7 + 1] AS kind, [l_partkey::VARCHAR, l_returnflag, NULL, (l_linenumber % 2)::VARCHAR, NULL, l_quantity::VARCHAR, 'x'][l_suppkey % 7 + 1] AS raw FROM lineitem)"
QUERIES = {f.__name__: f for f in (cell_references, column_names, serial_dates, serial_instants, date_codes, fixed_formats, cell_formats, cell_types, cell_styles, cell_merges, cell_grid, sheet_scales, column_sizes, theme_tints, sheet_rows, sheet_stack, sheet_names)}


def _format_sql() -> str:
    """Prices under every built-in format, an expression for each."""

    def number(places: int, grouped: bool = False, times: int = 1) -> str:
        scaled = f"CAST(floor(abs(v * {times}) * {10**places} + 2.220446049250313e-16 + 0.5e0) AS BIGINT)"
        whole = f"format('{{:,}}', {scaled} // {10**places})" if grouped else f"CAST({scaled} // {10**places} AS VARCHAR)"
        return whole + (f" || '.' || lpad(CAST({scaled} % {10**places} AS VARCHAR), {places}, '0')" if places else "")

    signed = lambda text: f"CASE WHEN v < 0 THEN '-' ELSE '' END || {text}"
    either = lambda text, end: f"CASE WHEN v < 0 THEN '(' || {text} || ')' ELSE {text} || '{end}' END"
    general = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(CAST(round(v, 10 - CAST(floor(log10(abs(v))) AS INTEGER)) AS VARCHAR), '0'), '.') END"
    date = lambda shape: f"CASE WHEN v < 0 THEN {general} ELSE strftime(t, '{shape}') END"
    texts = {
        0: general, 1: signed(number(0)), 2: signed(number(2)), 3: signed(number(0, True)), 4: signed(number(2, True)), 9: signed(number(0, times=100)) + " || '%'", 10: signed(number(2, times=100)) + " || '%'",
        11: signed(number(2)) + " || 'E+'", 12: signed(number(0)) + " || ' /'", 13: signed(number(0)) + " || ' /'", 14: date("%m-%d-%y"), 15: date("%-d-%b-%y"), 16: date("%-d-%b"), 17: date("%b-%y"),
        18: date("%-I:%M %p"), 19: date("%-I:%M:%S %p"), 20: date("%-H:%M"), 21: date("%-H:%M:%S"), 22: date("%-m/%-d/%y %-H:%M"), 37: either(number(0, True), " "), 38: either(number(0, True), " "),
        39: either(number(2, True), ""), 40: either(number(2, True), ""), 45: date("%M:%S"), 46: f"CASE WHEN v < 0 THEN {general} ELSE CAST(CAST(floor(v * 24) AS BIGINT) AS VARCHAR) || strftime(t, ':%M:%S') END", 47: date("%M%S.0"),
        48: signed(number(1)) + " || 'E+'", 49: general,
    }
    others = {'"d"0': signed("'d' || " + number(0)), "yyyy": date("%Y"), "[h]:mm": f"CASE WHEN v < 0 THEN {general} ELSE CAST(CAST(floor(v * 24) AS BIGINT) AS VARCHAR) || strftime(t, ':%M') END", "[Red]0": signed(number(0)), "": general}
    cases = " ".join(f"WHEN '{code}' THEN {text}" for code, text in [*((S.BUILTIN[k], t) for k, t in texts.items()), *others.items()])
    codes = ", ".join(f"'{c}'" for c in CODES)
    return f"""WITH c AS (SELECT o_orderkey, o_totalprice - 1000 AS v, [{codes}][o_orderkey % {len(CODES)} + 1] AS code FROM orders),
d AS (SELECT *, TIMESTAMP '1899-12-31' + to_days(CAST(floor(v) - CAST(floor(v) > 59 AS INTEGER) AS INTEGER)) + to_milliseconds(CAST(floor((v - floor(v)) * 86400000 + 0.5e0) AS BIGINT)) AS t FROM c)
SELECT o_orderkey, code, CASE code {cases} END AS text FROM d"""


SQL = {
    "cell_formats": _format_sql(),
    "cell_references": f"WITH r AS (SELECT p_partkey, {_L.format(m='(p_partkey * 7 % 18000)')} || (p_size + 1) AS ref FROM part), q AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN lower(ref) WHEN 2 THEN regexp_replace(ref, '[0-9]', '', 'g') WHEN 3 THEN regexp_replace(ref, '[A-Z]', '', 'g') ELSE ref END AS ref FROM r), s AS (SELECT *, regexp_extract(ref, '^([A-Z]+)[0-9]+$', 1) AS l, regexp_extract(ref, '^[A-Z]+([0-9]+)$', 1) AS d FROM q) SELECT p_partkey, ref, CASE WHEN l <> '' THEN CAST(d AS INTEGER) - 1 END AS \"row\", CASE WHEN l <> '' THEN CAST(list_reduce(list_prepend(0, list_transform(string_split(l, ''), lambda c: ascii(c) - 64)), lambda a, c: a * 26 + c) - 1 AS INTEGER) END AS col FROM s",
    "column_names": f"SELECT p_partkey, {_L.format(m='(p_partkey * 9 % 18000)')} AS name FROM part",
    "serial_dates": "WITH s AS (SELECT CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 100 + 1 ELSE date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE)) + 1 END AS DOUBLE) AS serial FROM orders) SELECT serial, CAST(DATE '1899-12-31' + CAST(CASE WHEN serial > 59 THEN serial - 1 ELSE serial END AS INTEGER) AS VARCHAR) AS day FROM s",
    "serial_instants": "WITH s AS (SELECT o_orderkey, o_orderkey % 60000 AS w, CAST(floor(o_totalprice) AS BIGINT) % 1024 / 1024.0::DOUBLE AS f FROM orders) SELECT o_orderkey, strftime(TIMESTAMP '1899-12-31' + to_milliseconds(CAST(CASE WHEN w > 59 THEN w - 1 ELSE w END * 86400000 + floor(f * 86400000 + 0.5) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%g') AS \"at\" FROM s",
    "date_codes": f"WITH c AS (SELECT p_partkey AS id, [{_CODES}][p_partkey % {len(CODES)} + 1] || chr(34) || p_name || chr(34) AS code FROM part), b AS (SELECT id, code, regexp_replace(regexp_replace(replace(replace(replace(code, '[h]', '<h>'), '[hh]', '<hh>'), '[m]', '<m>'), '\\[[^\\]]*\\]', '', 'g'), '\"[^\"]*\"', '', 'g') AS bare FROM c) SELECT id AS p_partkey, code, regexp_matches(bare, '(?i)(^|[^\\\\])[ymdhs]') AND NOT regexp_matches(bare, '(?i)e\\+') AS is_date FROM b",
    "fixed_formats": f"WITH v AS (SELECT o_orderkey, o_totalprice - 200000 AS v FROM orders), n AS (SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END AS s, CAST(floor(abs(v) * 100 + 0.5) AS BIGINT) AS n, CAST(floor(abs(v) + 0.5) AS BIGINT) AS w, CAST(floor(abs(v / 1024) + 0.5) AS BIGINT) AS p FROM v) SELECT o_orderkey, s || {_FIX2} AS fixed, s || format('{{:,}}', n // 100) || '.' || lpad((n % 100)::VARCHAR, 2, '0') AS grouped, s || format('{{:,}}', w) AS whole, s || p || '%' AS percent FROM n",
    "cell_types": f"WITH {CELLS}, sh AS (SELECT p_partkey::VARCHAR AS k, p_name FROM part WHERE p_partkey % 2 = 0) SELECT l_orderkey, l_linenumber, l_extendedprice, kind, CASE kind WHEN 's' THEN coalesce(p_name, '') WHEN 'inlineStr' THEN coalesce(raw, '') WHEN 'str' THEN coalesce(raw, '') WHEN 'b' THEN CASE WHEN raw = '1' THEN 'TRUE' ELSE 'FALSE' END WHEN 'e' THEN coalesce(raw, '#ERROR') END AS text, CASE WHEN kind = 'n' THEN try_cast(raw AS DOUBLE) END AS number FROM cells LEFT JOIN sh ON raw = k",
    "cell_styles": f"WITH {CELLS}, st(style_id, font_id, fill_id) AS (VALUES (0, 0, 0), (1, 1, 2), (2, 9, 1), (3, 2, 9)), f(font_id, bold) AS (VALUES (0, false), (1, true), (2, true)), c(fill_id, color) AS (VALUES (1, 'FF0000'), (2, '00FF00')) SELECT cells.style_id, coalesce(bold, false) AS bold, coalesce(color, 'none') AS color, count(*) AS n FROM cells LEFT JOIN st ON cells.style_id = st.style_id LEFT JOIN f ON st.font_id = f.font_id LEFT JOIN c ON st.fill_id = c.fill_id GROUP BY ALL",
    "cell_merges": "WITH c AS (SELECT DISTINCT l_orderkey AS sheet, CAST(l_partkey % 6 AS INTEGER) AS r, CAST(l_suppkey % 5 AS INTEGER) AS c FROM lineitem), m AS (SELECT l_orderkey AS sheet, CAST(l_partkey % 4 AS INTEGER) AS mr, CAST(l_suppkey % 3 AS INTEGER) AS mc, CAST(CAST(l_quantity AS BIGINT) % 3 + 1 AS INTEGER) AS h FROM lineitem WHERE l_linenumber = 1), j AS (SELECT c.sheet, c.r, c.c, m.mr, m.mc, row_number() OVER (PARTITION BY c.sheet, c.r, c.c ORDER BY m.mr DESC, m.mc DESC, m.h DESC) AS k FROM c LEFT JOIN m ON c.sheet = m.sheet AND c.r BETWEEN m.mr AND m.mr + m.h - 1 AND c.c BETWEEN m.mc AND m.mc + 1) SELECT sheet, r AS \"row\", c AS col, mr AS anchor_row, mc AS anchor_col FROM j WHERE k = 1",
    "cell_grid": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) FILTER (l_returnflag = 'A') AS \"A\", sum(l_quantity) FILTER (l_returnflag = 'N') AS \"N\", sum(l_quantity) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1",
    "sheet_scales": "WITH n AS (SELECT l_orderkey, sum(CASE WHEN l_discount > 0.01::DOUBLE THEN l_quantity * 6 ELSE 48 END) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(n, 6) AS natural, n > 523.28::DOUBLE AS landscape, round(greatest(0.4::DOUBLE, least(1.0::DOUBLE, CASE WHEN n > 523.28::DOUBLE THEN 769.89::DOUBLE ELSE 523.28::DOUBLE END / greatest(1.0::DOUBLE, n))), 9) AS scale FROM n",
    "column_sizes": "SELECT c_nationkey, floor(max(length(c_name)) * 7 + 5.5) * 72 / 96 AS points, CAST(least(80, greatest(6, floor(max(c_acctbal) / 5.25::DOUBLE + 0.5))) AS INTEGER) AS chars FROM customer GROUP BY c_nationkey",
    "theme_tints": "WITH r AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v, (p_size - 25) / 64 AS t FROM part), p AS (SELECT *, unnest([0, 1, 2]) AS i, unnest([v // 65536, v // 256 % 256, v % 256]) AS c FROM r), q AS (SELECT *, CAST(greatest(0, least(255, floor(CASE WHEN t < 0 THEN c * (1 + t) ELSE c + (255 - c) * t END + 0.5))) AS BIGINT) AS x FROM p) SELECT p_partkey, upper(string_agg(printf('%02x', c::BIGINT), '' ORDER BY i)) AS rgb, upper(string_agg(printf('%02x', x), '' ORDER BY i)) AS tinted, round(max(CASE WHEN i = 0 THEN c / 255 END), 6) AS red, round(max(CASE WHEN i = 2 THEN c / 255 END), 6) AS blue FROM q GROUP BY p_partkey",
    "sheet_rows": "WITH r AS (SELECT l_returnflag AS sheet, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_partkey::VARCHAR AS text FROM lineitem) SELECT sheet, CAST(n AS INTEGER) AS \"row\", 0 AS col, text FROM r WHERE n < 10000 UNION ALL SELECT sheet, 10000, 0, format('Showing the first {} of {} rows.', 10000, max(n) + 1) FROM r GROUP BY sheet HAVING max(n) >= 10000",
    "sheet_stack": "WITH b AS (SELECT conv_id, turn AS ord, CASE WHEN role = 'assistant' THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN role = 'assistant' THEN len(string_split(text, chr(10))) + 1 WHEN trim(text) = '' THEN 0 ELSE 1 END AS n FROM conversations) SELECT conv_id, ord, kind, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first_row FROM b",
    "sheet_names": "WITH n AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS n FROM part) SELECT p_brand, p_partkey, CASE WHEN n = 1 THEN p_type ELSE substring(p_type, 1, 28) || ' ' || n END AS unique_name FROM n",
}
