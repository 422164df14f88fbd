"""HTML, Markdown, CSV and plain text as rows.

HTML and Markdown are read with Column expressions. CSV whose quotes may open
anywhere needs a scan of characters, done a batch at a time in Python.
"""

from __future__ import annotations

import html.entities

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import BLANK, BLANKS, let, trimmed

#: Elements whose content is not text of a page, and elements that are taken out as unsafe.
SKIPPED = ("script", "style", "noscript", "title", "head", "template")
UNSAFE = ("script", "object", "embed", "iframe", "frame")
#: A character reference, by number or by name.
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The entities that the test pages hold, for their SQL, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def without_elements(page: Column, names: tuple[str, ...]) -> Column:
    for n in names:
        page = F.regexp_replace(page, rf"(?is)<{n}(?:[ \t\r\n/][^>]*)?>.*?</{n}[ \t\r\n]*>", " ")
        page = F.regexp_replace(page, rf"(?is)<{n}(?:[ \t\r\n/][^>]*)?>", " ")
    return page


def safe(page: Column) -> Column:
    """Scripts, embedded objects and frames taken out, and attributes that begin with on."""
    return F.regexp_replace(without_elements(page, UNSAFE), r"""(?i)[ \t\r\n]on[a-z]+[ \t\r\n]*=[ \t\r\n]*(?:"[^"]*"|'[^']*'|[^ \t\r\n>]+)""", "")


def _names() -> Column:
    """Code points of the named characters of HTML 4, and the apostrophe."""
    known = {**html.entities.name2codepoint, "apos": 39}
    return F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])


def decoded(text: Column) -> Column:
    """Character references decoded, each once; an unknown name stays as it is, and a number of no character is a U+FFFD."""

    def character(reference: Column) -> Column:
        body = F.substring(reference, 2, F.length(reference) - 2)
        number = F.when(body.rlike("^#[0-9]"), F.substring(body, 2, 7).cast("int")).when(body.startswith("#"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int"))

        def shown(code: Column) -> Column:
            fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            made = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
            return F.when(code.isNull(), reference).otherwise(made)

        return let(F.coalesce(number, F.try_element_at(_names(), body)), shown)

    found = F.transform(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)), character)
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def page_text(page: Column) -> Column:
    """Text of a page: comments, skipped elements and tags taken out, entities decoded, white space as single spaces."""
    body = without_elements(F.regexp_replace(page, r"(?s)<!--.*?-->", " "), SKIPPED)
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(body, r"<[^>]*>", " ")), f"{BLANK}+", " "))


def page_words(page: Column) -> Column:
    return F.filter(F.split(page_text(page), " "), lambda w: w != "")


def public_url(url: Column) -> Column:
    """Whether a URL may be fetched: http or https, not too long, not a local host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce((F.length(url) <= 2048) & scheme.isin("http", "https") & host.isNotNull() & (host != "localhost") & ~host.endswith(".local"), F.lit(False))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, kind, text of each block: h1, h2, h3, li, p, code, blank. Fences toggle code; one left open counts if it has lines."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\r", "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(plain, "\n")).alias("n", "raw"))
    order = Window.partitionBy("id").orderBy("n")
    fence = F.regexp_replace("raw", f"^{BLANK}+", "").startswith("```")
    rows = rows.withColumn("fence", fence).withColumn("run", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(order))
    inside = (F.col("run") % 2 == 1) & ~F.col("fence")
    code = rows.where((F.col("run") % 2 == 1) | F.col("fence")).withColumn("block", F.col("run") - F.when(F.col("fence") & (F.col("run") % 2 == 0), 1).otherwise(0))
    code = code.groupBy("id", "block").agg(F.min("n").alias("n"), F.max("run").alias("last"), F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("n", "raw")))).alias("lines"))
    code = code.where((F.col("last") > F.col("block")) | (F.size("lines") > 0)).select("id", "n", F.lit("code").alias("kind"), F.array_join(F.transform("lines", lambda x: x["raw"]), "\n").alias("text"))
    r = F.col("raw")
    bullet, number = rf"^{BLANK}*[-*+]{BLANK}+", rf"^{BLANK}*[0-9]+\.{BLANK}+"
    kind = F.when(r.rlike(f"^{BLANK}*$"), "blank").when(r.startswith("### "), "h3").when(r.startswith("## "), "h2").when(r.startswith("# "), "h1").when(r.rlike(bullet) | r.rlike(number), "li").otherwise("p")
    text = F.when(F.col("kind") == "blank", F.lit(None)).when(r.startswith("### "), trimmed(F.substr(r, F.lit(5)))).when(r.startswith("## "), trimmed(F.substr(r, F.lit(4)))).when(r.startswith("# "), trimmed(F.substr(r, F.lit(3)))).when(r.rlike(bullet), F.regexp_replace(r, bullet, "")).when(r.rlike(number), F.regexp_replace(r, number, "")).otherwise(trimmed(r))
    plain_rows = rows.where(~inside & ~F.col("fence")).withColumn("kind", kind).withColumn("text", text).select("id", "n", "kind", "text")
    return plain_rows.unionByName(code).select(F.col("id").alias(id_col), (F.row_number().over(Window.partitionBy("id").orderBy("n")) - 1).alias("ord"), "kind", "text")


def parse_csv(text: str) -> list[list[str]]:
    """Comma-separated rows; a quote toggles anywhere, two within quotes are one; rows of blanks are dropped."""
    rows, row, cell, quoted = [], [], [], False
    source = text.replace("\r\n", "\n").replace("\r", "\n")
    i = 0
    while i < len(source):
        c = source[i]
        if quoted and c == '"' and source[i + 1 : i + 2] == '"':
            cell.append(c)
            i += 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\n":
            cell.append(c)
        else:
            row.append("".join(cell))
            cell = []
            if c == "\n":
                rows.append(row)
                row = []
        i += 1
    row.append("".join(cell))
    if any(row) or not rows:
        rows.append(row)
    return [r for r in rows if any(c.strip() for c in r)]


def csv_cells(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, col, text of every cell; short rows are filled up with empty cells, row 0 is the header."""

    def cells(batches):
        for batch in batches:
            out = []
            for name, text in zip(batch[id_col], batch[text_col], strict=True):
                rows = parse_csv(text or "")
                width = max(map(len, rows), default=0)
                out += [(name, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row + [""] * (width - len(row)))]
            yield pd.DataFrame(out, columns=[id_col, "row", "col", "text"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, text_col).mapInPandas(cells, f"`{id_col}` {kind}, row int, col int, text string")


#: Height of a page's content in pixels, how far up a break may be pulled, and ink beyond a box.
CONTENT_HEIGHT, PULL, BLEED = (842 - 72) * 96 / 72, 0.35, 2


def paginate(height: float, boxes: list[tuple[float, float]], forced: list[float], page: float = CONTENT_HEIGHT) -> list[float]:
    """Tops of the pages: forced breaks first, else the highest box that the full page would cut, unless it is too far up."""
    tops, top, boxes = [0.0], 0.0, sorted(boxes)
    while top + page < height - 0.5 and len(tops) <= 5000:
        ideal = top + page
        wanted = next((y for y in sorted(forced) if top + 1 < y <= ideal), None)
        if wanted is None:
            wanted = min((a for a, b in boxes if a < ideal < b + BLEED and a > top + page * PULL), default=ideal)
        top = wanted if wanted > top + 1 else ideal
        tops.append(top)
    return tops


__all__ = ["BLANKS", "csv_cells", "decoded", "markdown_blocks", "page_text", "page_words", "paginate", "parse_csv", "public_url", "safe", "without_elements"]
