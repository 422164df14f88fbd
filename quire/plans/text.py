"""Queries over the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.tables import table

B = T.BLANK
PHRASE = "the and"


def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"))


def str_word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every conversation turn with their places."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.word_offsets(F.col("text"))).alias("w"))
    return rows.select("conv_id", "turn", "w.value", "w.start", "w.stop")


def str_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.phrase_count(T.normalized(F.col("text")), PHRASE).alias("n"))


def str_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(T.normalized(F.col("text")))).alias("n", "chunk"))
    return rows.select("doc_id", "n", "chunk")


def str_markdown_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("**"), F.col("p_brand"), F.lit("** is *"), F.col("p_type"), F.lit("*, see [`"), F.col("p_name"), F.lit("`](http://x/"), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.plain_markdown(marked).alias("plain"))


def str_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("“"), F.col("c_name"), F.lit("”— "), F.col("c_mktsegment"), F.lit("… ​→"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.folded(made).alias("folded"), T.latin1(made).alias("latin1"))


def str_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.trim(F.regexp_replace("p_brand", "(.)", "$1 "))
    return table(spark, sf_dir, "part").select("p_partkey", T.closed_up(spaced, F.col("p_size")).alias("heading"))


def str_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.rejoined(F.split(F.regexp_replace("text", "([a-z])([a-z]{3}) ", "$1-\n$2 "), "\n"))).alias("digest"))


def str_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.groupBy("doc_id").agg(F.count_if(T.list_marker(F.col("w"))).alias("markers"), F.count_if(T.page_reference(F.col("w"))).alias("references"), F.count_if(T.plain_number(F.col("w")).isNotNull()).alias("numbers"))


def str_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.format_number("o_totalprice", 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.plain_number(cents).alias("number"), T.plain_number(F.concat(cents, F.lit("x"))).alias("none"))


def str_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escaped(F.col("html"))).alias("digest"))


def str_sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.sheet_name(F.concat_ws("/", "p_brand", "p_type", "p_name"), F.col("p_partkey")).alias("sheet"), T.sheet_name(F.lit("?*"), F.col("p_partkey")).alias("spare"))


def str_field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", F.lit("form"), F.col("c_mktsegment"), F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.field_label(name).alias("label"))


def str_font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ABCDEF+"), F.element_at(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % len(FONTS) + 1).cast("int")))
    f = T.font_name(raw)
    return table(spark, sf_dir, "part").select("p_partkey", f["family"].alias("family"), f["bold"].alias("bold"), f["italic"].alias("italic"), T.font_family(raw).alias("kind"))


def str_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") + F.col("p_partkey") % 900
    kinds = ("lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "decimal", "bullet")
    return table(spark, sf_dir, "part").select("p_partkey", *[T.list_number(F.lit(k), n).alias(k) for k in kinds])


def str_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * 37).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_size(n).alias("size"), T.renamed(F.concat(F.lit("scan "), F.col("o_orderkey").cast("string"), F.lit(".PDF")), "redacted").alias("name"))


def text_layer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 code units of invisible text; characters outside the basic plane are dropped."""
    plain = F.regexp_replace("text", "[^\\x{0}-\\x{ffff}]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.hex(F.encode(plain, "UTF-16BE"))).alias("digest"), F.length(plain).alias("units"))


FONTS = ("TimesNewRoman-BoldItalic", "Calibri,Bold", "CourierNew", "ArialNarrow_Italic", "GeorgiaPro", "HelveticaNeue-Light", "Consolas")
_part = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (CAST(floor(n / 1024 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(n / 1024 * 10 + 0.5) AS BIGINT) % 10) || ' KB' ELSE (CAST(floor(n / 1048576 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(n / 1048576 * 10 + 0.5) AS BIGINT) % 10) || ' MB' END"
_rom = "||".join("[" + ",".join(f"'{d}'" for d in digits) + f"][(n // {unit}) % 10 + 1]" for unit, digits in T.ROMAN.items())
_let = "CASE WHEN m < 26 THEN chr(CAST(65 + m AS INTEGER)) WHEN m < 702 THEN chr(CAST(65 + (m - 26) // 26 AS INTEGER)) || chr(CAST(65 + (m - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + (m - 702) // 676 AS INTEGER)) || chr(CAST(65 + ((m - 702) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (m - 702) % 26 AS INTEGER)) END"
_fold = "x"
for _code, _plain in T.FOLDED.items():
    _fold = f"replace({_fold}, chr({_code}), '{_plain.replace(chr(39), chr(39) * 2)}')"
_esc = "regexp_replace(html, '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]', '', 'g')"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _esc = f"replace({_esc}, '{_a}', '{_b}')"
_norm = f"regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^{B}+|{B}+$', '', 'g')"

#: Folders of parts in packages, and targets of their links.
FOLDERS = ("", "word", "ppt/slides", "xl/worksheets/more")
TARGETS = ("{}.xml", "../media/{}.png", "/docProps/{}.xml", "./a/./{}.xml", "../../../{}.xml", "a/b/../../c//{}.xml", "..", "a/..")


def str_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    target = F.replace(pick(TARGETS, F.col("p_partkey")), F.lit("{}"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.resolved_path(pick(FOLDERS, F.floor(F.col("p_partkey") / len(TARGETS))), target).alias("path"))


QUERIES = {f.__name__: f for f in (str_paths, str_normalize, str_word_offsets, str_phrase_counts, str_word_chunks, str_markdown_inline, str_folded, str_headings, str_rejoined, str_markers, str_numbers, str_escaped, str_sheet_names, str_field_labels, str_font_names, str_list_numbers, str_sizes, text_layer_codes)}
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
SQL = {
    "str_paths": f"""WITH m AS (SELECT p_partkey, {_list(FOLDERS)}[p_partkey // {len(TARGETS)} % {len(FOLDERS)} + 1] AS f, replace({_list(TARGETS)}[p_partkey % {len(TARGETS)} + 1], '{{}}', p_brand) AS t FROM part),
s AS (SELECT p_partkey, string_split(CASE WHEN starts_with(t, '/') THEN t ELSE f || '/' || t END, '/') AS p FROM m)
SELECT p_partkey, list_reduce(list_prepend('', p), lambda path, name: CASE WHEN name IN ('', '.') THEN path WHEN name = '..' THEN regexp_replace(path, '/?[^/]*$', '') WHEN path = '' THEN name ELSE path || '/' || name END) AS path FROM s""",
    "text_layer_codes": "WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, ''), lambda c: c <> '' AND unicode(c) < 65536) AS c FROM conversations) SELECT conv_id, turn, md5(array_to_string(list_transform(c, lambda x: printf('%04X', unicode(x))), '')) AS digest, CAST(len(c) AS INTEGER) AS units FROM p",
    "str_normalize": f"SELECT doc_id, md5({_norm}) AS digest FROM documents",
    "str_word_offsets": f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^{T.BLANKS}]+') AS m, string_split_regex(text, '[^{T.BLANKS}]+') AS b FROM conversations),
f AS (SELECT conv_id, turn, unnest(range(len(m))) AS i, m, b FROM w),
x AS (SELECT conv_id, turn, i, m[i + 1] AS value, length(b[i + 1]) AS gap, length(m[i + 1]) AS size FROM f),
y AS (SELECT *, sum(gap + size) OVER (PARTITION BY conv_id, turn ORDER BY i) AS stop FROM x)
SELECT conv_id, turn, value, CAST(stop - size AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM y""",
    "str_phrase_counts": f"SELECT doc_id, CAST((length(lower({_norm})) - length(replace(lower({_norm}), '{PHRASE}', ''))) / {len(PHRASE)} AS INTEGER) AS n FROM documents",
    "str_word_chunks": f"""WITH t AS (SELECT doc_id, {_norm} AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '[^{T.BLANKS}]+') AS w FROM t WHERE length(t) >= 8),
c AS (SELECT doc_id, list_filter(list_transform(range(0, len(w), 12), lambda i: array_to_string(w[i + 1 : i + 18], ' ')), lambda s: length(s) >= 8) AS c FROM w)
SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS n, unnest(c) AS chunk FROM c""",
    "str_markdown_inline": "WITH m AS (SELECT p_partkey, '**' || p_brand || '** is *' || p_type || '*, see [`' || p_name || '`](http://x/' || p_partkey || ')' AS t FROM part) SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '\\*(.+?)\\*', '\\1', 'g'), '`(.+?)`', '\\1', 'g'), '\\[(.+?)\\]\\((.+?)\\)', '\\1', 'g') AS plain FROM m",
    "str_folded": f"WITH m AS (SELECT c_custkey, '“' || c_name || '”— ' || c_mktsegment || '… ' || chr(8203) || '→' AS x FROM customer) SELECT c_custkey, {_fold} AS folded, regexp_replace(x, '[^\\x{{20}}-\\x{{7e}}\\x{{a0}}-\\x{{ff}}]', '', 'g') AS latin1 FROM m",
    "str_headings": f"WITH m AS (SELECT p_partkey, p_size, trim(regexp_replace(p_brand, '(.)', '\\1 ', 'g')) AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(t, '^(?:[^{T.BLANKS}] )+[^{T.BLANKS}]$') AND p_size >= 14 AND length(t) >= 7 THEN replace(t, ' ', '') ELSE t END AS heading FROM m",
    "str_rejoined": "WITH m AS (SELECT doc_id, regexp_replace(text, '([a-z])([a-z]{3}) ', '\\1-' || chr(10) || '\\2 ', 'g') AS t FROM documents), j AS (SELECT doc_id, list_reduce(list_prepend('', string_split(t, chr(10))), lambda acc, line: CASE WHEN acc = '' THEN line WHEN regexp_matches(acc, '[a-z][-\\x{2010}\\x{ad}]$') AND regexp_matches(line, '^[a-z]') THEN regexp_replace(acc, '[-\\x{2010}\\x{ad}]$', '') || line ELSE acc || ' ' || line END) AS t FROM m) SELECT doc_id, md5(t) AS digest FROM j",
    "str_markers": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{T.BLANKS}]+')) AS w FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(w, '{T.LIST_MARKER}')) AS markers, count(*) FILTER (regexp_matches(w, '{T.PAGE_REFERENCE}')) AS \"references\", count(*) FILTER (regexp_matches(w, '{T.PLAIN_NUMBER}') AND length(w) < 16) AS numbers FROM w GROUP BY doc_id",
    "str_numbers": f"WITH m AS (SELECT o_orderkey, format('{{:,.2f}}', o_totalprice) AS t FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(t, '{T.PLAIN_NUMBER}') AND length(t) < 16 THEN CAST(replace(t, ',', '') AS DOUBLE) END AS number, CAST(NULL AS DOUBLE) AS none FROM m",
    "str_escaped": f"SELECT page_id, md5({_esc}) AS digest FROM pages",
    "str_sheet_names": "WITH m AS (SELECT p_partkey, regexp_replace(substring(regexp_replace(p_brand || '/' || p_type || '/' || p_name, '[\\\\/*?:\\[\\]]', ' ', 'g'), 1, 31), '^ +| +$', '', 'g') AS s FROM part) SELECT p_partkey, CASE WHEN s = '' THEN 'Sheet' || p_partkey ELSE s END AS sheet, 'Sheet' || p_partkey AS spare FROM m",
    "str_field_labels": "SELECT c_custkey, trim(replace(replace(c_name, '#', '_'), '_', ' ')) AS label FROM customer",
    "str_font_names": "WITH m AS (SELECT p_partkey, [" + ", ".join(f"'{f}'" for f in FONTS) + f"][p_partkey % {len(FONTS)} + 1] AS f FROM part), b AS (SELECT *, string_split_regex(f, '[-_,]')[1] AS base, lower(f) AS low FROM m) SELECT p_partkey, trim(regexp_replace(regexp_replace(base, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' +', ' ', 'g')) AS family, regexp_matches(low, 'bold|black|heavy|semibold|demi') AS bold, regexp_matches(low, 'italic|oblique') AS italic, CASE WHEN regexp_matches(low, '{T.MONO}') THEN 'mono' WHEN regexp_matches(low, '{T.SERIF}') THEN 'serif' ELSE 'sans' END AS kind FROM b",
    "str_list_numbers": f"WITH m AS (SELECT p_partkey, p_size + p_partkey % 900 AS n, greatest(p_size + p_partkey % 900, 1) - 1 AS m FROM part) SELECT p_partkey, lower({_let}) AS \"lowerLetter\", {_let} AS \"upperLetter\", lower({_rom}) AS \"lowerRoman\", {_rom} AS \"upperRoman\", CAST(n AS VARCHAR) AS decimal, '' AS bullet FROM m",
    "str_sizes": f"WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS n FROM orders) SELECT o_orderkey, {_part} AS size, 'scan ' || o_orderkey || '-redacted.pdf' AS name FROM m",
}
