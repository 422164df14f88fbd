"""Cases worked out by hand for functions and small operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import files, geometry, pages, pii, sheets
from quire.sources import markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, code, want", [
    (1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (0.256, "0%", "26%"), (1234567, "#,##0,", "1,235"), (-5, "0.00", "-5.00"),
    (0, "#,##0;(#,##0);-", "-"), (45219, "d-mmm-yy", "20-Oct-23"), (0.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (0.1, "General", "0.1"),
    (123456789012.0, "General", "1.23457E+11"), (1 / 3, "General", "0.33333333333"), (0.5, "#.##", ".5"), (12, '0 "kg;x"', "12 kg;x"), (5, "\\$0", "$5"), (-3, "[Red]0;[Blue]-0", "-3"),
])
def test_cell_formats(value, code, want):
    assert sheets.formatted(float(value), code) == want


def test_text_formats():
    assert sheets.formatted("abc", '0;0;0;"<"@">"') == "<abc>" and sheets.formatted("abc", "0") == "abc"


@pytest.mark.parametrize("serial, day", [(1, "1900-01-01"), (59, "1900-02-28"), (60, "1900-02-28"), (61, "1900-03-01"), (45219, "2023-10-20")])
def test_serials(spark, serial, day):
    assert one(spark, sheets.serial_date(F.lit(serial)).cast("string")) == day


@pytest.mark.parametrize("text, want", [("1-3, 5, 8-10", [0, 1, 2, 4, 7, 8]), ("5-3", []), ("x,2", [1]), ("4-", [3]), ("-3", []), (" 2 - 4 ", [1, 2, 3])])
def test_selections(spark, text, want):
    assert one(spark, pages.selection(F.lit(text), F.lit(9))) == want


def test_selection_texts(spark):
    assert one(spark, pages.selection_text(F.array(*map(F.lit, (0, 1, 3))))) == "1-2, 4"


def test_labels(spark):
    labels = [one(spark, pages.page_label(F.lit("{n} of {N}"), F.lit(i), F.lit(1), F.lit(3))) for i in range(3)]
    assert labels == ["1 of 3", "2 of 3", "3 of 3"]


def test_question_terms(spark):
    assert one(spark, T.question_terms(F.lit("What is the total amount due?"))) == ["total", "amount", "due"]


def test_sizes(spark):
    assert one(spark, T.human_size(F.lit(1536))) == "1.5 KB"


def test_joined_lines(spark):
    lines = F.array(*map(F.lit, ("", "exam-", "ple text", "Well-", "Known")))
    assert one(spark, T.rejoined(lines)) == "example text Well- Known"


def test_csv():
    assert markup.parse_csv('a,"b ""q""",c\r\n1,2\n\n , \n') == [["a", 'b "q"', "c"], ["1", "2"]]
    assert markup.parse_csv('x"y,z"w,1') == [["xy,zw", "1"]]
    assert markup.parse_csv("") == []


def test_pagination():
    assert markup.paginate(100, [], []) == [0.0]
    assert markup.paginate(250, [(95, 120)], [], page=100) == [0.0, 95, 195]
    assert markup.paginate(250, [(95, 120)], [40.0], page=100) == [0.0, 40.0, 140.0, 240.0]


def hits(spark, line):
    return [(h.kind, h.value) for h in one(spark, pii.line_hits(F.lit(line)))]


def test_personal_data(spark):
    assert hits(spark, "152.143.123.131") == [("phone", "152.143.123.131")]
    assert hits(spark, "4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert hits(spark, "E-mail: jane@x.io") == [("email", "jane@x.io"), ("label-e-mail", "jane@x.io")]
    assert one(spark, pii.kind_of(F.lit("label-e-mail"))) == "label"
    assert hits(spark, "born 1999-12-31, 123-45-6789")[:2] == [("ssn", "123-45-6789"), ("dob", "1999-12-31")]


def test_masked_text_has_no_pattern_left(spark):
    text = "Mail jane@x.io or 555.987.6543 now\nNothing here\nSSN 123-45-6789"
    masked = one(spark, pii.masked(F.lit(text)))
    assert len(masked) == len(text) and "jane" not in masked and "Nothing here" in masked
    assert one(spark, pii.masked(F.lit(masked))) == masked


#: Each line holds exactly one kind of hit.
SINGLE = (
    ("email", "to jane@x.io"), ("phone", "call 5559876543"), ("ssn", "id 123-45-6789"), ("dob", "born 1.2.1999"), ("label-name", "Name: Jane"), ("label-location", "location – Pune"),
    ("address", "Hill Road, Pune"), ("profile-url", "linkedin.com/in/janedoe"), ("profile-url", "see github.com/jane"), ("profile-url", "see GitHub.com/jane"),
)


def test_no_line_with_a_hit_is_left_out(spark):
    docs = spark.createDataFrame(list(enumerate(line for _, line in SINGLE)), "doc_id int, text string")
    text = F.col("text")
    rows = docs.select("doc_id", pii.line_hits(text).alias("hits"), pii.masked(text).alias("masked")).collect()
    scanned = {(r.doc_id, r.value, r.start, r.stop) for r in pii.scan(docs).collect()}
    for r in rows:
        assert SINGLE[r.doc_id][0] in {h.kind for h in r.hits}
        assert {(r.doc_id, h.value, h.start, h.stop) for h in r.hits} <= scanned
        assert all(set(r.masked[h.start : h.stop]) == {pii.MASK} for h in r.hits)
    assert pii.kinds(docs).count() == len(SINGLE)


def test_all_detectors_are_scanned_and_masked(spark):
    texts = [
        "amit kumar\nplain prose without any mark\nj a n e @ x . c o m\nAda Lovelace\n5 5 5 9 8 7 6 5 4 3\nAddress\nHill View\nMumbai, India\nSkills",
        "\nAddress: Goa\nnear Hill Road\nnothing here",
        "\U0001f600 j a n e @ x . c o m",
        "\n" * 30 + "Ada Lovelace",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.line, r.kind, r.value, r.start, r.stop) for r in pii.scan(docs, "id").collect()}
    assert {
        (0, 0, "name", "amit kumar", 0, 10), (0, 2, "email", "j a n e @ x . c o m", 0, 19), (0, 3, "name", "Ada Lovelace", 0, 12), (0, 4, "phone", "5 5 5 9 8 7 6 5 4 3", 0, 19),
        (0, 6, "address", "Hill View", 0, 9), (0, 6, "name", "Hill View", 0, 9), (0, 7, "address", "Mumbai, India", 0, 13), (1, 1, "address", "Goa", 9, 12), (1, 2, "address", "near Hill Road", 0, 14),
        (2, 0, "email", "j a n e @ x . c o m", 2, 21),
    } == got
    masked = {r.id: r.t for r in docs.select("id", pii.masked(F.col("text")).alias("t")).collect()}
    assert masked[0].split("\n") == ["█" * 10, "plain prose without any mark", "█" * 19, "█" * 12, "█" * 19, "Address", "█" * 9, "█" * 13, "Skills"]
    assert masked[1] == "\nAddress: ███\n" + "█" * 14 + "\nnothing here" and masked[2] == "\U0001f600 " + "█" * 19 and masked[3] == texts[3]
    assert {r.id: r.kinds for r in pii.kinds(docs, "id").collect()} == {0: ["name", "email", "phone", "address"], 1: ["address"], 2: ["email"]}


def test_label_alone_takes_the_next_line(spark):
    lines = F.array(*map(F.lit, ("Address", "Flat 4, Hill View", "Mumbai, India", "Skills")))
    got = [(h.line, h.kind) for h in one(spark, pii.context_hits(lines))]
    assert (1, "label-address") in got and (2, "label-address") in got and all(line < 3 for line, _ in got)


def test_markdown(spark):
    source = "# A\n\n- b\n1. c\n```\nx\ny\n```\ntext **bold**\n```\nopen"
    rows = spark.createDataFrame([(1, source), (2, "```")], "id int, text string")
    got = [(r.id, r.kind, r.text) for r in markup.markdown_blocks(rows, "id", "text").orderBy("id", "ord").collect()]
    assert got == [(1, "h1", "A"), (1, "blank", None), (1, "li", "b"), (1, "li", "c"), (1, "code", "x\ny"), (1, "p", "text **bold**"), (1, "code", "open")]


def test_list_labels(spark):
    items = spark.createDataFrame([(1, i, level) for i, level in enumerate([0, 1, 1, 0, 1])], "doc int, ord int, level int")
    assert [r.label for r in geometry.list_labels(items, ["doc"]).orderBy("ord").collect()] == ["1", "1.1", "1.2", "2", "2.1"]


def test_upper_median(spark):
    assert spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int").agg(geometry.upper_median("v").alias("m")).first().m == 3


def test_smallest_fill_wins(spark):
    lines = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0)], "page int, line_id int, x0 double, y0 double, x1 double, y1 double")
    fills = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0, "AA"), (1, 2, 5.0, 5.0, 30.0, 30.0, "BB"), (1, 3, 9.0, 9.0, 21.0, 21.0, "FFFFFF")], "page int, fill_id int, x0 double, y0 double, x1 double, y1 double, color string")
    assert geometry.shaded(lines, fills).first().shading == "BB"


def test_pages_of_one_side(spark):
    from quire.operators import diff

    left, right = (spark.createDataFrame([(1, p, "t") for p in range(1, n + 1)], "doc int, page int, text string") for n in (3, 4))
    got = {r.page: r.only_in for r in diff.page_pairs(left, right, ["doc", "page"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "right"}


def test_file_kinds(spark):
    assert one(spark, files.file_kind(F.lit(bytearray(b"%PDF-1.7xxx")))) == "pdf"


def test_streamed_ingestion(spark, tmp_path):
    from quire.operators import summary
    from quire.streaming import ingest

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "One sentence here. Another one there.")], "doc_id long, text string")
    for n in range(2):
        batch.withColumn("doc_id", F.lit(n).cast("long")).write.mode("append").parquet(source)
        ingest(spark, source, batch.schema, summary.summaries, sink, str(tmp_path / "position"))
    got = spark.read.parquet(sink)
    assert {r.doc_id for r in got.collect()} == {0, 1} and got.where("doc_id = 0").count() == summary.summaries(batch).count()


def test_checksums(spark, sf_dir):
    import hashlib
    import zlib

    from quire import plans

    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in plans.queries()["file_checksums"](spark, sf_dir).collect():
        assert (r.crc32, r.sha384, r.sha512) == (zlib.crc32(text[r.doc_id]), hashlib.sha384(text[r.doc_id]).hexdigest(), hashlib.sha512(text[r.doc_id]).hexdigest())


def test_character_references(spark):
    import html

    from pyspark.sql import functions as F

    from quire.sources.markup import decoded

    texts = ["a &lt;b&gt; &amp;amp; c", "caf&eacute; &copy;&#8217;&#x1F600;", "&unknown; & &; &#0; &#55296; &#9999999;", "no reference", "&nbsp;&quot;&apos;&#39;&Omega;&hearts;", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(decoded(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_phrase_boxes(spark):
    from quire.operators.geometry import phrase_boxes

    kind = "page long, word_id long, x double, y double, width double, height double, text string"
    words = spark.createDataFrame(
        [(1, 0, 0.0, 10.25, 40.0, 10.0, "Jane"), (1, 1, 50.0, 10.0, 30.0, 10.0, "Doe"), (1, 2, 90.0, 10.0, 30.0, 10.0, "doe"), (1, 3, 0.0, 30.0, 40.0, 10.0, "jane"), (2, 4, 0.0, 0.0, 10.0, 10.0, ""), (2, 5, 5.0, 0.0, 20.0, 10.0, "A.B"), (3, 6, None, None, None, None, None)],
        kind,
    )
    boxes = lambda phrase: sorted(tuple(r) for r in phrase_boxes(words, phrase).collect())
    # from the third letter of one word to the second of the next
    assert boxes(" NE do ") == [(1, 19.0, 9.0, 52.0, 12.25)]
    assert boxes("doe") == [(1, 49.0, 9.0, 32.0, 12.0), (1, 89.0, 9.0, 32.0, 12.0)]
    assert boxes("a.b") == [(2, 4.0, -1.0, 22.0, 12.0)] and boxes("a,b") == [] and boxes("  ") == []


def test_repaired_rules(spark):
    from quire.operators.files import repaired_rules

    block = '<mc:AlternateContent><wp:extent cx="5" cy="{}"/>behindDoc="0" behindDoc="0"{}<w10:wrap type="none"/>z-index:1 z-index:2</mc:AlternateContent>'
    thin, thick = block.format(12700, "<wp:wrapNone/>"), block.format(12701, "<wp:wrapNone/>")
    mended = '<mc:AlternateContent><wp:extent cx="5" cy="12700"/>behindDoc="1" behindDoc="0"<wp:wrapTopAndBottom/><w10:wrap type="topAndBottom"/>z-index:-1 z-index:-2</mc:AlternateContent>'
    cases = {
        "a" + thin + "b" + thick + thin: "a" + mended + "b" + thick + mended,
        block.format(1, ""): block.format(1, ""),
        block.format("9" * 40, "<wp:wrapNone/>"): block.format("9" * 40, "<wp:wrapNone/>"),
        "<mc:AlternateContent><wp:wrapNone/>": "<mc:AlternateContent><wp:wrapNone/>",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "xml string")
    assert [r[0] for r in rows.select(repaired_rules(F.col("xml"))).collect()] == list(cases.values())


def test_values_follow_their_own_label(spark):
    from quire.operators import pii

    rows = spark.createDataFrame([("surname: x; name: x",), ("Name:   ",), ("email - a | phone: 1",)], "t string")
    found = [[(h["kind"], h["value"], h["start"]) for h in r[0]] for r in rows.select(pii.label_hits(F.col("t"))).collect()]
    assert found == [[("label-name", "x", 18)], [], [("label-email", "a", 8), ("label-phone", "1", 19)]]


def test_pinned_cover(spark):
    from quire.operators.files import NEW_PAGE, next_link, pinned_cover

    doc = "<w:body>{}</w:body>"
    cases = {
        # the nearest paragraph before the first break
        doc.format('<w:p>1</w:p><w:p>2<w:br w:type="page"/></w:p><w:p>3<w:br w:type="page"/></w:p>'): doc.format('C<w:p>2<w:br w:type="page"/></w:p><w:p>3<w:br w:type="page"/></w:p>'),
        # a line break is none, and a rendered break in the very first paragraph ends nothing
        doc.format('<w:p>1<w:br/></w:p><w:sectPr/>'): doc.format("C<w:sectPr/>"),
        doc.format("<w:p><w:lastRenderedPageBreak/></w:p><w:sectPr/>"): doc.format(f"C{NEW_PAGE}<w:p><w:lastRenderedPageBreak/></w:p><w:sectPr/>"),
        doc.format(""): doc.format(f"C{NEW_PAGE}"),
        "<w:bodyguard>": "<w:bodyguard>",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "xml string")
    assert [r[0] for r in rows.select(pinned_cover(F.col("xml"), F.lit("C"))).collect()] == list(cases.values())
    links = spark.createDataFrame([('Id="rId9" Id="rId10" rId="rId77" Id="x5"',), ("",)], "r string")
    assert [r[0] for r in links.select(next_link(F.col("r"))).collect()] == ["rId11", "rId1"]


def test_resolved_path(spark):
    rows = spark.createDataFrame([("word", "../x.xml", "x.xml"), ("a/b", "../../../x", "x"), ("a", "/b/./c", "b/c"), ("", "x/../y", "y"), ("a", "..", ""), ("a", "", "a"), (None, "x", "x"), ("a", None, None)], "f string, t string, want string")
    assert [(r[0]) for r in rows.select(T.resolved_path(F.col("f"), F.col("t"))).collect()] == [r.want for r in rows.collect()]
