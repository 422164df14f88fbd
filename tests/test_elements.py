"""What is seen of HTML pages, against cases worked out by hand and a parser with a stack."""

import html.parser
import random

import pytest
from pyspark.sql import functions as F

from quire.sources import elements as E
from quire.sources.markup import paginate

CASES = {
    "a<b hidden>b</b>c": "a c",
    "<div style='display:none'>a<div>b</div>c</div>d": "d",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b<i>c</i></b>d</div>e": "b c e",
    "<div style='opacity:0'>a<b>b</b></div>c": "b c",
    "<div style='font-size:0'>a<b style='font-size:2em'>b</b><b style='font-size:9px'>c</b></div>d": "c d",
    "<p hidden>a<p>b": "b",
    "<p hidden>a<b>b</b><div>c</div>": "c",
    "<ul><li hidden>a<li>b</ul>c": "b c",
    "<div><span hidden>a</div>b": "b",
    "<div hidden>a": "",
    "</div>a</p>b<div hidden>c</div>d": "a b d",
    "<div title='x hidden y' data-hidden=1>a</div>": "a",
    "<div HIDDEN=''>a</div><input hidden>b": "b",
    "<div style='x:y;DISPLAY : None ! important'>a</div>b".replace("! important", "!important"): "b",
    "<a title=\"1 > 0\">a</a> 2 < 3 <!-- <b hidden> -->b": "a 2 < 3 b",
    "<script>x</script><style>y</style>&amp;lt;&nbsp;z": "&lt; z",
    "": "",
    " \n ": "",
}


def seen(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page long, html string")
    out = {i: [] for i in range(len(pages))}
    for r in E.shown(rows.withColumn("pos", F.lit(1)).withColumn("id", F.lit("x")), "page", F.col("html")).orderBy("page", "n").collect():
        out[r["page"]].append(r["text"])
    return [" ".join(out[i]) for i in range(len(pages))]


def test_cases(spark):
    assert dict(zip(CASES, seen(spark, list(CASES)), strict=True)) == CASES


def test_null_and_empty_tables(spark):
    assert seen(spark, [None, "a", None]) == ["", "a", ""]
    none = spark.createDataFrame([], "page long, html string")
    assert E.shown(none, "page", F.col("html")).count() == 0 and E.html_pages(none, "page", F.col("html")).count() == 0


def test_long_tags_and_texts(spark):
    wide = "<a " + "x" * 200_000 + ">a</a>" + "<i title='" + "y" * 200_000 + "'>b</i>" + "<" * 3_000 + " c " + "<b>" * 500 + "d"
    assert seen(spark, [wide])[0].replace("<", "").split() == ["a", "b", "c", "d"]


class Stack(html.parser.HTMLParser):
    """The same by a stack, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        up = self.stack[-1] if self.stack else {"gone": False, "seen": True}
        style = a.get("style", "")
        shows = {"visibility:hidden": False, "visibility:visible": True}.get(style, up["seen"])
        self.stack.append({"gone": up["gone"] or "hidden" in a or style == "display:none", "seen": shows, "clear": style == "opacity:0"})

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else {"gone": False, "seen": True, "clear": False}
        if not top["gone"] and top["seen"] and not top["clear"]:
            self.out.append(data)


def made(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        out.append(rng.choice(["one", "two", "three"]) if rng.random() < 0.5 or depth > 5 else None)
        if out[-1] is None:
            name, word = rng.choice(["div", "b", "section", "span"]), rng.choice(["", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'", " style='opacity:0'"])
            out[-1] = f"<{name}{word}>{made(rng, depth + 1)}</{name}>"
    return " ".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_stack(spark, seed):
    rng = random.Random(seed)
    pages = [made(rng) for _ in range(80)]
    want = []
    for p in pages:
        s = Stack()
        s.feed(p)
        s.close()
        want.append(" ".join(" ".join(s.out).split()))
    assert seen(spark, pages) == want


def test_pages_of_the_grid(spark):
    """Lines break as the general rule breaks boxes of one line each."""
    rng = random.Random(5)
    pages, tops = [], []
    for n in (1, 51, 52, 53, 103, 160, 260):
        asked = sorted(rng.sample(range(1, n), min(n - 1, 3)))
        pages.append("".join(f"<p{' style=break-before:page' if i in asked else ''}>line {i}</p>" for i in range(n)))
        tops.append(paginate(n * E.LINE, [(i * E.LINE, (i + 1) * E.LINE) for i in range(n)], [i * E.LINE for i in asked]))
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    for r in E.html_pages(rows, "page_id", F.col("html")).collect():
        assert r["text"] == f"line {r['line']}"
        assert r["page"] == sum(t <= r["line"] * E.LINE for t in tops[r["page_id"]]) - 1


def test_lines_of_words(spark):
    words = ["a" * 100, "b" * 39, "c" * 40, "d", "e" * 80, "f"]
    rows = spark.createDataFrame([(1, "<div>" + " ".join(words) + "</div>g")], "page_id long, html string")
    lines = [r["text"] for r in E.html_pages(rows, "page_id", F.col("html")).orderBy("line").collect()]
    assert lines == ["a" * 100, "b" * 39 + " " + "c" * 40, "d", "e" * 80, "f", "g"]
