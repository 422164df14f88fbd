"""Removal of lines that are boilerplate of their site.

A line, without spaces at its ends, is boilerplate of a site if it stands in
more than ``percent`` of the site's pages and in at least ``min_pages`` of
them; with 2, the default, a line is only left alone for being on one page.
Pages lose every such line; lines of nothing but spaces stay. With
``keep_pages`` a page made of nothing but boilerplate is kept whole, for use
before document de-duplication, which settles copies of pages.

All work is in DataFrame functions. Lines are counted by two 64-bit hashes, one
count for each page, summed before the shuffle, so neither a large site nor a
common line meets in one task, and no text is shuffled. The boilerplate of one
site numbers less than 100 / percent times its mean lines a page. It is joined
to the pages by broadcast while it is small in all, else by site and a salt.

A null text stays null, with 0 lines; an empty one has 1 line. A text may be of
any length that a row can hold. A page without a site has nothing to be compared
with and stays as it is. Repeated rows count as pages of their own. A line at
exactly the ratio stays. An empty table gives an empty result. Columns of the
input pass through; one named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import numbered, pick, position, stored

#: Boilerplate lines of all sites that may be broadcast, at about 50 bytes each.
BROADCAST_LINES = 100_000
#: Parts that the pages of one site are dealt into when they are not.
SALTS = 64


def line_key(line: Column) -> Column:
    """Two independent hashes of a line without the spaces at its ends."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(F.lit(7), bare).alias("y"))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", percent: float = 8.0, min_pages: int = 2) -> DataFrame:
    """host, x, y (hashes), n (pages with the line) and pages (of the host) for each boilerplate line."""
    pages = pick(df, {"host": host_col, "text": text_col}).where("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), line_key)
    lines = pages.where("text is not null").select("host", F.explode(F.array_distinct(keys)).alias("k"))
    counts = lines.groupBy("host", "k.x", "k.y").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") * 100 > F.lit(float(percent)) * F.col("pages"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", percent: float = 8.0, min_pages: int = 2, broadcast_lines: int = BROADCAST_LINES, keep_pages: bool = False) -> DataFrame:
    """``df`` with boilerplate lines taken out of its text, and n_lines, n_dropped."""
    found = stored(boilerplate(df, host_col, text_col, percent, min_pages).select("host", "x", "y"), "boilerplate")
    small = found.count() <= broadcast_lines
    lists = found.groupBy("host").agg(F.collect_list(F.struct("x", "y")).alias("list")).withColumnRenamed("host", "__host")

    kept_at = [i for i, n in enumerate(df.columns) if n.lower() not in ("n_lines", "n_dropped")]
    names = [df.columns[i] for i in kept_at]
    pages = numbered(numbered(df).select(*[f"_{i}" for i in kept_at]))
    host, text = f"_{position(names, host_col)}", f"_{position(names, text_col)}"
    if small:
        joined = pages.join(F.broadcast(lists), F.col(host) == F.col("__host"), "left")
    else:
        lists = lists.select("__host", "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        salted = pages.withColumn("__own", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = salted.join(lists, (F.col(host) == F.col("__host")) & (F.col("__own") == F.col("__salt")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter("__lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("list"), line_key(x)))
    joined = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("list").isNotNull(), kept))
    left = F.exists("__kept", lambda x: F.trim(x) != "") if keep_pages else F.lit(True)
    joined = joined.withColumn("__cut", F.coalesce(left & (F.size("__kept") < F.size("__lines")), F.lit(False)))
    out = [F.when(F.col("__cut"), F.array_join("__kept", "\n")).otherwise(F.col(c)) if c == text else F.col(c) for c in pages.columns]
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines"))
    dropped = F.when(F.col("__cut"), F.size("__lines") - F.size("__kept")).otherwise(0)
    return joined.select(*[c.alias(n) for c, n in zip(out, names, strict=True)], n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


#: The same over ``documents`` with their sources as sites.
SQL = """
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line),
boiler AS (
  SELECT c.source, list(c.line) AS found FROM counts c JOIN totals t ON c.source = t.source
  WHERE c.n >= 2 AND c.n * 100 > CAST(8 AS DOUBLE) * t.pages GROUP BY c.source),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS whole,
    CASE WHEN b.found IS NOT NULL THEN list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(b.found, trim(x, ' '))) END AS kept
  FROM documents d LEFT JOIN boiler b ON d.source = b.source),
judged AS (
  SELECT *, coalesce(len(kept) < len(whole), false) AS changed FROM cut)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(whole) AS BIGINT) END AS n_lines,
  CASE WHEN changed THEN CAST(len(whole) - len(kept) AS BIGINT) ELSE 0 END AS n_dropped,
  sha256(CASE WHEN changed THEN array_to_string(kept, chr(10)) ELSE text END) AS kept_sha256
FROM judged
"""
