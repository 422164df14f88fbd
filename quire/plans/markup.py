"""Queries over HTML, Markdown and CSV, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import elements as E
from quire.sources import markup as M
from quire.sources.tables import table

B = T.BLANK


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", M.page_text(F.col("html")).alias("text"))


def html_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.explode(M.page_words(F.col("html"))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def html_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.replace(F.col("html"), F.lit("<p>"), F.lit('<p onclick="x()" ONLOAD=y>'))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.safe(page)).alias("digest"))


def html_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's address is a public one; in five of seven it is changed to one that is not."""
    way, page, url = F.col("page_id") % 7, F.col("page_id").cast("string"), F.col("url")
    kinds = (F.concat(F.lit("ftp://a.b/"), page), F.concat(F.lit("http://localhost/"), page), F.concat(F.lit("https://printer.local/"), page), F.concat(url, F.repeat(F.lit("x"), 2100)), F.concat(F.lit("nonsense"), page))
    for k, changed in enumerate(kinds, 1):
        url = F.when(way == k, changed).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", M.public_url(url).alias("public"))


#: Parts of every page's markup and what they become, by the remainder of the page's id by seven, so that text is hidden and pages are broken.
STYLED = (
    ("<nav>", "<nav hidden>", 0), ("<ul>", "<ul style='display: none'>", 1), ('<div class="ad">', '<div class="ad" style="visibility:hidden">a<b style="visibility: visible">b</b>', 2), ("<article>", '<article style="font-size:0"><i style="font-size:12px">shown</i>', 3),
    ("<footer>", "<footer STYLE=opacity:0><u>under</u>", 4), ("<br>", '<p style="color:red; display:none !important">left open', 5), ("<h1>", '<h1 title="a > b" style="page-break-before:always">', 6), ("</b>", "</b></i><li style=display:none>x<li>y", 6), ("</h1>", "</h1><hr style='break-after: page'>2 < 3", 5),
)


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    for old, new, n in STYLED:
        page = F.when(F.col("page_id") % 7 == n, F.replace(page, F.lit(old), F.lit(new))).otherwise(page)
    return table(spark, sf_dir, "pages").select("page_id", page.alias("html"))


def html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page on the grid."""
    return E.html_pages(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


def html_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen of pages with styles set in them."""
    return E.shown(_styled(spark, sf_dir), "page_id", F.col("html"))


def html_styled_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.html_pages(_styled(spark, sf_dir), "page_id", F.col("html"))


#: Turns the lines of a document into every kind of block, by their number.
KINDS = ("# {}", "## {}", "### {}", "- {}", "  2. {}", "```", "{}", "", "{}", "* {}", "```py", "plain {}")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*map(F.lit, KINDS))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.replace(F.element_at(forms, i % len(KINDS) + 1), F.lit("{}"), x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.markdown_blocks(_markdown(spark, sf_dir), "doc_id", "text")


def markdown_as_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.markdown_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand as CSV files, read back."""
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit(' ""')), F.lit('"')), F.concat(F.col("p_type"), F.lit(' "a,b"')))
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("text"))
    return M.csv_cells(files, "p_brand", "text")


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as rows of words: short rows are filled up."""
    return M.csv_cells(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").groupBy("doc_id").agg(F.max("row").alias("rows"), F.max("col").alias("columns"), F.count_if(F.col("text") == "").alias("blank"))


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n")).alias("n", "line"))
    return rows.select("doc_id", "n", F.length("line").alias("size"), F.floor(F.col("n") / 42).cast("int").alias("page"))


_STRIP = "{x}"
for _n in M.SKIPPED:
    _STRIP = f"regexp_replace(regexp_replace({_STRIP}, '(?is)<{_n}(?:[ \\t\\r\\n/][^>]*)?>.*?</{_n}[ \\t\\r\\n]*>', ' ', 'g'), '(?is)<{_n}(?:[ \\t\\r\\n/][^>]*)?>', ' ', 'g')"
_SAFE = "{x}"
for _n in M.UNSAFE:
    _SAFE = f"regexp_replace(regexp_replace({_SAFE}, '(?is)<{_n}(?:[ \\t\\r\\n/][^>]*)?>.*?</{_n}[ \\t\\r\\n]*>', ' ', 'g'), '(?is)<{_n}(?:[ \\t\\r\\n/][^>]*)?>', ' ', 'g')"
_DEC = "regexp_replace(" + _STRIP.replace("{x}", "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')") + ", '<[^>]*>', ' ', 'g')"
for _a, _b in M.ENTITIES:
    _DEC = f"replace({_DEC}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
TEXT = f"regexp_replace(regexp_replace({_DEC}, '{B}+', ' ', 'g'), '^{B}+|{B}+$', '', 'g')"


def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(names: tuple[str, ...]) -> str:
    return "name IN (" + ", ".join(map(_string, names)) + ")"


_DECODED = "tok"
for _a, _b in M.ENTITIES:
    _DECODED = f"replace({_DECODED}, {_string(_a)}, {_string(_b)})"
_CHANGED = "html"
for _a, _b, _n in STYLED:
    _CHANGED = f"CASE WHEN page_id % 7 = {_n} THEN replace({_CHANGED}, {_string(_a)}, {_string(_b)}) ELSE {_CHANGED} END"
_TO_HERE = "ORDER BY pos, late ROWS UNBOUNDED PRECEDING"
_LATER = "ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _shown(pages: str) -> str:
    """The windows of ``elements.shown`` over ``pages`` (page_id, html), as common tables up to ``seen``."""
    style = lambda p: f"regexp_matches(style, {_string(p)})"
    return f"""body AS (SELECT page_id, {_STRIP.replace('{x}', "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')")} AS x FROM ({pages})),
tok AS (SELECT page_id, unnest(range(len(p))) AS pos, unnest(p) AS tok FROM (SELECT page_id, regexp_extract_all(x, {_string(E.TOKEN.replace('++', '+').replace('*+', '*'))}) AS p FROM body)),
kind AS (SELECT *, CASE WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' WHEN tok = '<' OR tok NOT LIKE '<%' THEN 'text' END AS kind, lower(regexp_extract(tok, {_string(E.NAME)}, 1)) AS name FROM tok),
tags AS (SELECT *, CASE WHEN kind = 'open' THEN {' || '.join(f'regexp_extract(tok, {_string(E.STYLE)}, {i})' for i in (1, 2, 3))} ELSE '' END AS style, kind = 'open' AND NOT {_in(E.VOID)} AS opens FROM kind WHERE kind IS NOT NULL),
sums AS (SELECT *, CASE WHEN opens THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END AS step, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS total FROM tags),
lows AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY page_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM sums),
levels AS (SELECT *, CASE WHEN opens THEN total - low WHEN step = -1 AND total >= low THEN total - low + 1 END AS level FROM lows),
pairs AS (SELECT *, CASE WHEN opens THEN lead(pos) OVER (PARTITION BY page_id, name, level ORDER BY pos) END AS own FROM levels),
depths AS (SELECT *, sum(CASE WHEN own IS NOT NULL THEN 1 WHEN step = -1 AND level IS NOT NULL THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS around FROM pairs),
outers AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY page_id, around ORDER BY pos) AS o, min(pos) FILTER (kind = 'open') OVER (PARTITION BY page_id, name {_LATER}) AS same, min(pos) FILTER (kind = 'open' AND {_in(E.BLOCKS)}) OVER (PARTITION BY page_id {_LATER}) AS block FROM depths),
ended AS (SELECT *, CASE WHEN o > pos THEN o END AS outr, CASE WHEN NOT opens THEN NULL WHEN name = 'p' THEN least(coalesce(own, outr), block) WHEN own IS NULL AND {_in(E.LEFT_OPEN)} THEN least(outr, same) ELSE coalesce(own, outr) END AS stop FROM outers),
said AS (SELECT page_id, pos, 1 AS late, CASE WHEN kind = 'text' THEN tok END AS tok, stop, style, kind <> 'text' AND {_in(E.LINES)} AS line, CASE WHEN kind = 'open' AND {style(E.BEFORE)} THEN 1 ELSE 0 END AS page,
  CASE WHEN opens AND ({style(E.NONE)} OR regexp_matches(regexp_replace(tok, {_string(E.QUOTED)}, '""', 'g'), {_string(E.HIDDEN)})) THEN 1 END AS gone,
  CASE WHEN opens AND {style(E.UNSEEN)} THEN 0 WHEN opens AND {style(E.SEEN)} THEN 1 END AS seen, CASE WHEN opens AND {style(E.NO_SIZE)} THEN 0 WHEN opens AND {style(E.SIZE)} THEN 1 END AS sized, CASE WHEN opens THEN CAST(NOT {style(E.CLEAR)} AS INTEGER) END AS solid FROM ended),
both_ AS (SELECT page_id, pos, late, tok, line, page, gone, seen, sized, solid, {', '.join(f'CASE WHEN {k} IS NOT NULL THEN 1 ELSE 0 END AS d_{k}' for k in ('gone', 'seen', 'sized', 'solid'))} FROM said
  UNION ALL SELECT page_id, stop, 0, NULL, line, CASE WHEN {style(E.AFTER)} THEN 1 ELSE 0 END, NULL, NULL, NULL, NULL, {', '.join(f'CASE WHEN {k} IS NOT NULL THEN -1 ELSE 0 END' for k in ('gone', 'seen', 'sized', 'solid'))} FROM said WHERE stop IS NOT NULL),
held AS (SELECT *, {', '.join(f'sum(d_{k}) OVER (PARTITION BY page_id {_TO_HERE}) AS l_{k}' for k in ('gone', 'seen', 'sized', 'solid'))}, sum(CAST(line AS INTEGER)) OVER (PARTITION BY page_id {_TO_HERE}) AS block, sum(page) OVER (PARTITION BY page_id {_TO_HERE}) AS breaks FROM both_),
inner_ AS (SELECT *, {', '.join(f'CASE WHEN l_{k} > 0 THEN last_value({k} IGNORE NULLS) OVER (PARTITION BY page_id, l_{k} {_TO_HERE}) END AS i_{k}' for k in ('seen', 'sized', 'solid'))} FROM held),
seen AS (SELECT page_id, pos, block, breaks, regexp_replace(regexp_replace({_DECODED}, '{B}+', ' ', 'g'), '^{B}+|{B}+$', '', 'g') AS text FROM inner_ WHERE tok IS NOT NULL AND l_gone = 0 AND coalesce(i_seen, 1) = 1 AND coalesce(i_sized, 1) = 1 AND coalesce(i_solid, 1) = 1)"""


def _grid(pages: str) -> str:
    """Words of each block go to the line at hand while they fit; the last piece of the joined text is that line."""
    return f"""WITH {_shown(pages)}, b AS (SELECT page_id, block, breaks, min(pos) AS n, string_split(string_agg(text, ' ' ORDER BY pos), ' ') AS words FROM seen WHERE text <> '' GROUP BY ALL),
l AS (SELECT page_id, n, breaks, string_split(list_reduce(words, lambda a, w: a || CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= {E.WIDTH} THEN ' ' ELSE chr(10) END || w), chr(10)) AS p FROM b),
k AS (SELECT page_id, n, breaks, unnest(range(len(p))) AS k, unnest(p) AS text FROM l),
i AS (SELECT *, row_number() OVER w - 1 AS line, count(*) OVER (PARTITION BY page_id) AS lines, breaks > coalesce(lag(breaks) OVER w, 0) AS asked FROM k WINDOW w AS (PARTITION BY page_id ORDER BY n, k)),
f AS (SELECT *, coalesce(max(line) FILTER (asked) OVER (PARTITION BY page_id ORDER BY line), 0) AS begun FROM i),
t AS (SELECT *, CASE WHEN (line - begun) % {E.PAGE_LINES} = 0 THEN line END AS top FROM f),
u AS (SELECT *, top IS NOT NULL AND coalesce(max(top) OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {E.PAGE_LINES} < lines, false) AS turns FROM t)
SELECT page_id, CAST(count_if(turns) OVER (PARTITION BY page_id ORDER BY line) AS INTEGER) AS page, CAST(line AS INTEGER) AS line, text FROM u"""


_FORMS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
BLOCKS = f"""raw AS (SELECT doc_id, n, x AS raw, starts_with(regexp_replace(x, '^{B}+', ''), '```') AS fence FROM (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM md))),
runs AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM raw),
c0 AS (SELECT *, run - CASE WHEN fence AND run % 2 = 0 THEN 1 ELSE 0 END AS block FROM runs WHERE run % 2 = 1 OR fence),
code AS (SELECT doc_id, min(n) AS n, 'code' AS kind, coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT fence), '') AS text FROM c0 GROUP BY doc_id, block HAVING max(run) > min(block) OR count(*) FILTER (NOT fence) > 0),
pl AS (SELECT doc_id, n, CASE WHEN regexp_matches(raw, '^{B}*$') THEN 'blank' WHEN starts_with(raw, '### ') THEN 'h3' WHEN starts_with(raw, '## ') THEN 'h2' WHEN starts_with(raw, '# ') THEN 'h1' WHEN regexp_matches(raw, '^{B}*[-*+]{B}+') OR regexp_matches(raw, '^{B}*[0-9]+\\.{B}+') THEN 'li' ELSE 'p' END AS kind, raw FROM runs WHERE run % 2 = 0 AND NOT fence),
pt AS (SELECT doc_id, n, kind, CASE kind WHEN 'blank' THEN NULL WHEN 'h3' THEN regexp_replace(substring(raw, 5), '^{B}+|{B}+$', '', 'g') WHEN 'h2' THEN regexp_replace(substring(raw, 4), '^{B}+|{B}+$', '', 'g') WHEN 'h1' THEN regexp_replace(substring(raw, 3), '^{B}+|{B}+$', '', 'g') WHEN 'li' THEN regexp_replace(raw, '^{B}*(?:[-*+]|[0-9]+\\.){B}+', '') ELSE regexp_replace(raw, '^{B}+|{B}+$', '', 'g') END AS text FROM pl),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS ord, kind, text FROM (SELECT * FROM pt UNION ALL SELECT * FROM code))"""
QUERIES = {f.__name__: f for f in (html_text, html_words, html_safe, html_urls, html_layout, html_shown, html_styled_layout, markdown_blocks, markdown_as_is, csv_cells, csv_ragged, plain_lines)}
SQL = {
    "csv_cells": """WITH l AS (SELECT p_brand, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey || ',"' || replace(p_name, ' ', ' ""') || '",' || p_type || ' "a,b"') - 1 AS n FROM part)
SELECT p_brand, CAST(n AS INTEGER) AS row, CAST(unnest([0, 1, 2]) AS INTEGER) AS col, unnest([CAST(p_partkey AS VARCHAR), replace(p_name, ' ', ' "'), p_type || ' a,b']) AS text FROM l""",
    # an even number of quotes stands before each comma and line end that parts cells
    "csv_ragged": f"""WITH q AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '"') AS p FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN x WHEN i > 1 AND i < len(p) AND x = '' THEN '"' ELSE replace(replace(x, ',', chr(1)), chr(10), chr(2)) END), '') AS t FROM q),
r AS (SELECT doc_id, string_split(row, chr(1)) AS cells FROM (SELECT doc_id, unnest(string_split(t, chr(2))) AS row FROM j) WHERE regexp_matches(row, '[^{T.BLANKS}\\x01]'))
SELECT doc_id, CAST(count(*) - 1 AS INTEGER) AS rows, CAST(max(len(cells)) - 1 AS INTEGER) AS columns, CAST(sum(len(list_filter(cells, lambda c: c = ''))) + count(*) * max(len(cells)) - sum(len(cells)) AS BIGINT) AS blank FROM r GROUP BY doc_id""",
    "html_text": f"SELECT page_id, {TEXT} AS text FROM pages",
    "html_shown": f"WITH {_shown(f'SELECT page_id, {_CHANGED} AS html FROM pages')} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS n, CAST(block AS BIGINT) AS block, CAST(breaks AS BIGINT) AS breaks, text FROM seen WHERE text <> ''",
    "html_layout": _grid("SELECT page_id, html FROM pages"),
    "html_styled_layout": _grid(f"SELECT page_id, {_CHANGED} AS html FROM pages"),
    "html_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split({TEXT}, ' ')) AS word FROM pages) WHERE word <> '' GROUP BY word",
    "html_safe": "SELECT page_id, md5(regexp_replace(" + _SAFE.replace("{x}", "replace(html, '<p>', '<p onclick=\"x()\" ONLOAD=y>')") + ", '(?i)[ \\t\\r\\n]on[a-z]+[ \\t\\r\\n]*=[ \\t\\r\\n]*(?:\"[^\"]*\"|''[^'']*''|[^ \\t\\r\\n>]+)', '', 'g')) AS digest FROM pages",
    "html_urls": "WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'ftp://a.b/' || page_id WHEN 2 THEN 'http://localhost/' || page_id WHEN 3 THEN 'https://printer.local/' || page_id WHEN 4 THEN url || repeat('x', 2100) WHEN 5 THEN 'nonsense' || page_id ELSE url END AS url FROM pages), h AS (SELECT page_id, url, lower(regexp_extract(url, '^(?i:https?)://([^/:?#]+)', 1)) AS host FROM u) SELECT page_id, length(url) <= 2048 AND host <> '' AND host <> 'localhost' AND NOT ends_with(host, '.local') AS public FROM h",
    "markdown_blocks": f"WITH md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: replace({_FORMS}[(i - 1) % {len(KINDS)} + 1], '{{}}', x)), chr(10)) AS text FROM documents), {BLOCKS} SELECT * FROM blocks",
    "markdown_as_is": f"WITH md AS (SELECT doc_id, text FROM documents), {BLOCKS} SELECT kind, count(*) AS n FROM blocks GROUP BY kind",
    "plain_lines": "WITH l AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS p FROM documents)) SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(line) AS INTEGER) AS size, CAST(n // 42 AS INTEGER) AS page FROM l",
}
