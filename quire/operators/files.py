"""Checks and policies for uploaded files, and names and messages for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import human_size, tenth

MAX_BYTES = 100 * 1024 * 1024
#: Presets of the compression engine.
PRESETS = (("low", "/printer", 300, 300, 600, 0.15), ("recommended", "/ebook", 200, 200, 300, 0.35), ("extreme", "/screen", 100, 100, 300, 0.55))
#: Kinds of upload: extensions, least and most files.
FEATURES = {"merge": (("pdf",), 2, 20), "images": (("jpg", "jpeg", "png"), 1, 20), "word": (("doc", "docx"), 1, 1), "sheet": (("xls", "xlsx", "xlsm", "csv"), 1, 1), "any": (("pdf",), 1, 1)}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def accepted(files: DataFrame, key: str, feature: str, most: int = MAX_BYTES) -> DataFrame:
    """Files of each upload with whether they are taken: of the right kind, not too large, not beyond the number allowed."""
    kinds, least, top = FEATURES[feature]
    fit = extension(F.col("name")).isin(*kinds) & (F.col("size") <= most)
    n = F.sum(fit.cast("int")).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(fit.cast("int")).over(Window.partitionBy(key))
    return files.withColumn("accepted", fit & (n <= top)).withColumn("enough", total >= least)


def file_kind(content: Column) -> Column:
    """What a file's first bytes say it is: pdf, package, encrypted (an old container), jpeg, png, or unknown; too short is empty."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "package").when(head == "D0CF11E0A1B11AE1", "encrypted").when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png").otherwise("unknown")
    return F.when(F.length(content) < 8, "empty").otherwise(kind)


def compression_result(before: Column, after: Column) -> Column:
    """(kept, size, percent, message): the original stays if the result is no smaller."""
    size = F.least(before, after)
    percent = (before - size) * 100 / before
    reduced = F.concat(F.lit("Reduced by "), tenth(percent), F.lit("% ("), human_size(before), F.lit(" to "), human_size(size), F.lit(")"))
    message = F.when(percent < 0.5, F.concat(F.lit("Already small: kept at "), human_size(size))).otherwise(reduced)
    return F.struct((after >= before).alias("kept"), size.alias("size"), percent.alias("percent"), message.alias("message"))


def ocr_needed(chars: Column) -> Column:
    return chars < 24


def kept_words(words: DataFrame, least: float = 40.0) -> DataFrame:
    """Recognised words that are sure enough and not blank, on pages that have almost no text of their own."""
    return words.where(ocr_needed(F.col("native_chars")) & (F.col("confidence") >= least) & (F.trim("text") != ""))


def ocr_counts(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages recognised, pages left as they are, and words found."""
    need = ocr_needed(F.col("native_chars"))
    found = kept_words(words).groupBy("page").agg(F.count("*").alias("n"))
    rows = pages.join(found, "page", "left")
    return rows.agg(F.count_if(need).alias("recognised"), F.count_if(~need).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))


def filled(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Form fields with new values, except those that may only be read; fields without a page come last."""
    new = values.withColumnRenamed("value", "new_value")
    rows = fields.join(new, [*keys, "name"], "left")
    value = F.when(F.col("read_only") | F.col("new_value").isNull(), F.col("value")).otherwise(F.col("new_value"))
    return rows.withColumn("value", value).withColumn("order", F.coalesce("page", F.lit(1_000_000))).drop("new_value")


#: How thick a drawn rule may be, in English Metric Units, and what its wrapping is set to.
HAIRLINE = 12700
WRAPPING = (("<wp:wrapNone/>", "<wp:wrapTopAndBottom/>"), ('behindDoc="0"', 'behindDoc="1"'), ('<w10:wrap type="none"/>', '<w10:wrap type="topAndBottom"/>'))
_DRAWING = "mc:AlternateContent"


def repaired_rules(xml: Column) -> Column:
    """The XML of a word-processor document whose drawn hairlines keep text above and below them; all else stays as it is."""

    def mended(block: Column) -> Column:
        out = F.regexp_replace(block, "z-index:([0-9])", r"z-index:-$1")
        for old, new in WRAPPING:
            # the first one only
            out = F.regexp_replace(out, rf"(?s)^(.*?)\Q{old}\E", f"$1{new}")
        thick = F.regexp_extract(block, '<wp:extent cx="[0-9]+" cy="([0-9]+)"', 1)
        thin = F.contains(block, F.lit("<wp:wrapNone/>")) & (thick != "") & (F.try_to_number(thick, F.lit("9" * 38)) <= HAIRLINE)
        return F.when(thin, out).otherwise(block)

    def piece(text: Column) -> Column:
        # what ends in one block, after what stands before it
        at = F.instr(text, f"<{_DRAWING}>")
        return F.when((at > 0) & text.endswith(f"</{_DRAWING}>"), F.concat(F.substring(text, F.lit(1), at - 1), mended(F.substring(text, at, F.length(text))))).otherwise(text)

    return F.array_join(F.transform(F.split(xml, f"(?<=</{_DRAWING}>)"), piece), "")


#: How a document's XML shows the end of its first page, and what is put there where nothing shows it.
PAGE_END, RENDERED_END = r'<w:br\b[^>]*w:type="page"[^/]*/>', r"<w:lastRenderedPageBreak\b"
SECTION_END = r"<w:p\b.*?<w:sectPr\b.*?</w:sectPr>.*?</w:p>"
NEW_PAGE = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'


def pinned_cover(xml: Column, paragraph: Column) -> Column:
    """The XML of a word-processor document with ``paragraph`` in place of its first page.

    The first page ends before the paragraph of the first page break, else of
    the first break as rendered, else at the first paragraph where sections
    follow, else before the last section's properties. A document that shows no
    end gets the paragraph on a page of its own; one without a body stays.
    """
    body = r"(?s)^(.*?<w:body(?:\s[^>]*)?>)(.*)$"
    head, rest = F.regexp_extract(xml, body, 1), F.regexp_extract(xml, body, 2)

    def last(text: Column, tag: str) -> Column:
        """The characters before the last such tag, or null."""
        back = F.instr(F.reverse(text), tag[::-1])
        return F.when(back > 0, F.length(text) - back + 1 - len(tag))

    def paragraph_of(mark: str) -> Column:
        return F.when(rest.rlike(mark), last(F.regexp_extract(rest, f"(?s)^(.*?){mark}", 1), "<w:p"))

    page, rendered, final = paragraph_of(PAGE_END), paragraph_of(RENDERED_END), last(rest, "<w:sectPr")
    section = F.when(rest.rlike(f"(?s){SECTION_END}"), F.length(F.regexp_extract(rest, f"(?s)^(.*?){SECTION_END}", 1)))
    single = ~rest.rlike(PAGE_END) & ~F.substring(rest, F.lit(1), final).rlike(RENDERED_END)
    end = F.coalesce(page, F.when(rendered > 0, rendered), F.when(section < final, section), F.when(single, final))
    kept = F.when(end.isNotNull(), F.substring(rest, end + 1, F.length(rest))).otherwise(F.concat(F.lit(NEW_PAGE), rest))
    return F.when(head == "", xml).otherwise(F.concat(head, paragraph, kept))


def next_link(relations: Column) -> Column:
    """The first id of the form rId1, rId2, ... after all in a part's relationships."""
    numbers = F.transform(F.regexp_extract_all(relations, F.lit(r'\bId="rId([0-9]+)"'), F.lit(1)), lambda n: n.cast("long"))
    return F.concat(F.lit("rId"), (F.coalesce(F.array_max(numbers), F.lit(0)) + 1).cast("string"))
