"""Elements of HTML pages as rows, and the text that a reader of the page sees.

The stack of open elements is said in windows. Within the tags of one name, a
running count of opened less closed ones gives each tag a level, and at its level
an element is followed by its own end tag. What text inherits from the elements
around it works the same way: among the elements that say something of a
property, the last one opened at the level that holds at the text is the
innermost that is still open.

Rows of one page meet in one task; pages are dealt out by id, once for all
windows. No Python runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import BLANK, trimmed
from quire.sources.markup import CONTENT_HEIGHT, SKIPPED, decoded, without_elements

#: Fixed values of HTML: elements without content, those that may be left open until the next of their name, those that
#: end an open paragraph, and those that begin and end a line of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
LEFT_OPEN = ("li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot")
BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
)
LINES = (*BLOCKS, *LEFT_OPEN, "br", "body", "caption")
#: A tag with its quoted values, text, or a < that begins no tag; and the white space and names within a tag.
TOKEN = r"""<[/!?A-Za-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
NAME = r"^</?([A-Za-z][^ \t\r\n\f/>]*)"
STYLE = r"""(?i)[ \t\r\n\f"']style[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n\f>"']+))"""
HIDDEN = r"""(?i)[ \t\r\n\f"']hidden(?:[ \t\r\n\f=/>]|$)"""
QUOTED = r""""[^"]*"|'[^']*'"""
#: Characters of a line of the grid, and pixels of its height.
WIDTH, LINE = 80, 20.0
PAGE_LINES = int(CONTENT_HEIGHT // LINE)


def declares(name: str, values: str) -> str:
    """Pattern of a style that says ``name: value``, value one of ``values``."""
    return rf"(?i)(?:^|;)[ \t\r\n\f]*{name}[ \t\r\n\f]*:[ \t\r\n\f]*(?:{values})[ \t\r\n\f]*(?:![^;]*)?(?:;|$)"


NONE = declares("display", "none")
UNSEEN, SEEN = declares("visibility", "hidden|collapse"), declares("visibility", "visible")
NO_SIZE, SIZE = declares("font-size", r"0+(?:\.0*)?[a-z%]*"), declares("font-size", r"[0-9.]*[1-9][0-9.]*(?:px|pt|pc|in|cm|mm|q|rem|vw|vh)|(?:xx?-)?(?:small|large)|medium|xxx-large")
CLEAR = declares("opacity", r"0+(?:\.0*)?%?")
BEFORE, AFTER = declares("(?:page-)?break-before", "page|always"), declares("(?:page-)?break-after", "page|always")


def tokens(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, pos, tok, kind (open, close, text), name and style of each tag and text; comments and skipped elements are taken out."""
    body = without_elements(F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?s)<!--.*?-->", " "), SKIPPED)
    # one exchange serves every window below, as they all have the id among their keys
    rows = pages.select(F.col(id_col).alias("id"), body.alias("body")).repartition("id").select("id", F.posexplode(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    t = F.col("tok")
    kind = F.when(t.rlike("^<[A-Za-z]"), "open").when(t.rlike("^</[A-Za-z]"), "close").when((t == "<") | ~t.startswith("<"), "text")
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("name", F.lower(F.regexp_extract("tok", NAME, 1)))
    style = F.when(F.col("kind") == "open", F.concat(*[F.regexp_extract("tok", STYLE, i) for i in (1, 2, 3)])).otherwise("")
    return rows.withColumn("style", style)


def ended(rows: DataFrame) -> DataFrame:
    """``tokens`` with end, the place before which an open element ends; null for other rows and for one open to the end.

    An end tag without its element counts for nothing. An element without its
    end tag ends with the innermost one around it that has one, or at the next
    of its name where HTML lets it; a paragraph ends at the next block at the
    latest.
    """
    opens = (F.col("kind") == "open") & ~F.col("name").isin(*VOID)
    named = Window.partitionBy("id", "name").orderBy("pos")
    step = F.when(opens, 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("step", step).withColumn("sum", F.sum("step").over(named))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(named.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("low", F.coalesce("low", F.lit(0)))
    level = F.when(F.col("opens"), F.col("sum") - F.col("low")).when((F.col("step") == -1) & (F.col("sum") >= F.col("low")), F.col("sum") - F.col("low") + 1)
    rows = rows.withColumn("level", level)
    own = F.when(F.col("opens"), F.lead("pos").over(Window.partitionBy("id", "name", "level").orderBy("pos")))
    rows = rows.withColumn("own", own)
    # the innermost element around that has an end tag
    known = F.col("own").isNotNull()
    matched = F.when(known, 1).when((F.col("step") == -1) & F.col("level").isNotNull(), -1).otherwise(0)
    rows = rows.withColumn("around", F.sum(matched).over(Window.partitionBy("id").orderBy("pos")))
    outer = F.last(F.when(known, F.col("own")), ignorenulls=True).over(Window.partitionBy("id", "around").orderBy("pos"))
    later = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("outer", outer).withColumn("outer", F.when(F.col("outer") > F.col("pos"), F.col("outer")))
    rows = rows.withColumn("same", F.min(F.when(F.col("kind") == "open", F.col("pos"))).over(later(["id", "name"])))
    rows = rows.withColumn("block", F.min(F.when((F.col("kind") == "open") & F.col("name").isin(*BLOCKS), F.col("pos"))).over(later(["id"])))
    end = F.when(F.col("name") == "p", F.least(F.coalesce("own", "outer"), "block")).when(F.col("own").isNull() & F.col("name").isin(*LEFT_OPEN), F.least("outer", "same")).otherwise(F.coalesce("own", "outer"))
    return rows.withColumn("end", F.when(F.col("opens"), end)).select("id", "pos", "tok", "kind", "name", "style", "opens", "end")


def shown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, n, block, breaks, text: the text that is seen, in order.

    ``n`` numbers the pieces of a page from 0; ``block`` changes where a line
    begins, ``breaks`` counts the page breaks asked for so far. Hidden are
    elements with ``hidden`` or ``display: none`` and all within them, text
    whose innermost word on visibility hides it, text of size 0, and text
    directly in an element of opacity 0. Style sheets are not read, only styles
    of elements. Null pages, and pages without text, have no rows; repeated
    rows of one id are read as one page's pieces, so ids must be unique.
    """
    rows = ended(tokens(pages, id_col, html_col))
    s, opens = F.col("style"), F.col("opens")
    bare = F.regexp_replace("tok", QUOTED, '""')
    rows = rows.withColumns({
        "gone": opens & (s.rlike(NONE) | bare.rlike(HIDDEN)),
        "seen": F.when(opens & s.rlike(UNSEEN), 0).when(opens & s.rlike(SEEN), 1),
        "sized": F.when(opens & s.rlike(NO_SIZE), 0).when(opens & s.rlike(SIZE), 1),
        "solid": F.when(opens, F.when(s.rlike(CLEAR), 0).otherwise(1)),
        "line": (F.col("kind") != "text") & F.col("name").isin(*LINES),
        "page": F.when((F.col("kind") == "open") & s.rlike(BEFORE), 1).otherwise(0),
    })
    said = {"gone": F.when(F.col("gone"), 1), "seen": F.col("seen"), "sized": F.col("sized"), "solid": F.col("solid")}
    rows = rows.withColumns({f"v_{k}": v for k, v in said.items()})
    keep = ["id", "pos", "late", "text", "line", "page", *(f"{p}_{k}" for k in said for p in "vd")]
    own = rows.withColumns({"late": F.lit(1), "text": F.when(F.col("kind") == "text", F.col("tok")), **{f"d_{k}": F.when(F.col(f"v_{k}").isNotNull(), 1).otherwise(0) for k in said}})
    # the end of an element comes before the tag or text that stands there
    ends = rows.where("end is not null").withColumns({"pos": F.col("end"), "late": F.lit(0), "text": F.lit(None).cast("string"), "page": F.when(s.rlike(AFTER), 1).otherwise(0), **{f"d_{k}": F.when(F.col(f"v_{k}").isNotNull(), -1).otherwise(0) for k in said}, **{f"v_{k}": F.lit(None).cast("int") for k in said}})
    both = own.select(*keep).unionByName(ends.select(*keep)).repartition("id")
    order = Window.partitionBy("id").orderBy("pos", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({**{f"l_{k}": F.sum(f"d_{k}").over(order) for k in said}, "block": F.sum(F.col("line").cast("int")).over(order), "breaks": F.sum("page").over(order)})
    inner = {k: F.last(f"v_{k}", ignorenulls=True).over(Window.partitionBy("id", f"l_{k}").orderBy("pos", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)) for k in ("seen", "sized", "solid")}
    both = both.withColumns({f"i_{k}": F.when(F.col(f"l_{k}") > 0, v) for k, v in inner.items()})
    visible = (F.col("l_gone") == 0) & (F.coalesce("i_seen", F.lit(1)) == 1) & (F.coalesce("i_sized", F.lit(1)) == 1) & (F.coalesce("i_solid", F.lit(1)) == 1)
    plain = trimmed(F.regexp_replace(decoded(F.col("text")), f"{BLANK}+", " "))
    kept = both.where(F.col("text").isNotNull() & visible).withColumn("text", plain).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    return kept.select(F.col("id").alias(id_col), n.alias("n"), "block", "breaks", "text")


def filled(text: Column) -> Column:
    """Lines of words parted by single blanks, none wider than the grid unless it is one word."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(a: Column, w: Column) -> Column:
        fits = F.length(a["line"]) + 1 + F.length(w) <= WIDTH
        begun = F.struct(F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))).alias("done"), w.alias("line"))
        return F.when((a["line"] != "") & fits, F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"))).otherwise(begun)

    return F.aggregate(F.split(text, " "), start, add, lambda a: F.concat(a["done"], F.array(a["line"])))


def html_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, page, line, text of what is seen, on a grid of lines broken into pages.

    A page takes as many whole lines as fit; one asked for ends it earlier,
    unless all that is left fits on the page.
    """
    own = shown(pages, id_col, html_col).withColumnRenamed(id_col, "id")
    blocks = own.groupBy("id", "block", "breaks").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("n").alias("n"))
    lines = blocks.select("id", "breaks", "n", F.posexplode(filled(F.col("text"))).alias("k", "text"))
    order, whole = Window.partitionBy("id").orderBy("n", "k"), Window.partitionBy("id")
    lines = lines.withColumns({"line": F.row_number().over(order) - 1, "lines": F.count("*").over(whole), "asked": F.col("breaks") > F.coalesce(F.lag("breaks").over(order), F.lit(0))})
    down = Window.partitionBy("id").orderBy("line")
    lines = lines.withColumn("from", F.coalesce(F.last(F.when(F.col("asked"), F.col("line")), ignorenulls=True).over(down), F.lit(0)))
    lines = lines.withColumn("top", F.when((F.col("line") - F.col("from")) % PAGE_LINES == 0, F.col("line")))
    before = F.last("top", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    turns = F.col("top").isNotNull() & (before + PAGE_LINES < F.col("lines"))
    lines = lines.withColumn("turns", F.coalesce(turns, F.lit(False)).cast("int")).withColumn("page", F.sum("turns").over(down))
    return lines.select(F.col("id").alias(id_col), F.col("page").cast("int").alias("page"), "line", "text")
