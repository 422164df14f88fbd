"""Queries over files: formats written and read back, checksums, uploads, policies; with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.formats import crypto, office, pdf
from quire.functions.text import BLANK
from quire.operators import files as O
from quire.sources.tables import table


#: Bytes that files of each kind begin with, in hex, and two beginnings of none.
HEADS = ("255044462D", "504B0304", "D0CF11E0A1B11AE1", "FFD8FF", "89504E470D0A1A0A", "", "616263", "")


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32("text").alias("crc32"), F.sha2("text", 384).alias("sha384"), F.sha2("text", 512).alias("sha512"))


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a file of one page a turn, read back."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        pages = [pdf.Page([pdf.Placed(line, 54, 738 - 16 * i) for i, line in enumerate(t.split("\n"))]) for t in rows["text"]]
        name = int(rows["conv_id"].iloc[0])
        return pd.DataFrame({"conv_id": [name], "content": [pdf.write(pages, {"Title": f"Conversation {name}"}, "secret" if name % 7 == 0 else None)]})

    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(write, "conv_id long, content binary")
    rows = pdf.read_files(files, "conv_id", password="secret")
    return rows.select("conv_id", "page", "width", "height", "text", "title", "error")


def pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each supplier, locked, damaged or no file at all, read back."""

    def write(batches):
        for rows in batches:
            files = []
            for key, name in zip(rows["s_suppkey"].tolist(), rows["s_name"], strict=True):
                page = pdf.Page([pdf.Placed(name, 54, 738)])
                way = key % 5
                files.append(pdf.write([page], password="p") if way == 0 else name.encode() if way == 1 else b"" if way == 2 else pdf.write([page, pdf.Page()]).replace(b"startxref", b"lost") if way == 3 else b"%PDF-1.4\n" + name.encode())
            yield pd.DataFrame({"s_suppkey": rows["s_suppkey"], "content": files})

    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name").mapInPandas(write, "s_suppkey long, content binary")
    return pdf.read_files(files, "s_suppkey").select("s_suppkey", "page", F.split("error", ":")[0].alias("error"))


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as a workbook, a sheet a segment, read back."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        for name, part in rows.sort_values("c_custkey").groupby("c_mktsegment"):
            cells = [(0, 0, "Customer", None, True, True), (0, 1, "Balance", None, True, True)]
            for r, (who, value) in enumerate(zip(part["c_name"], part["c_acctbal"], strict=True), 1):
                cells += [(r, 0, who, None, False, True), (r, 1, "", float(value), False, True)]
            sheets.append((name, cells))
        return pd.DataFrame({"c_nationkey": [int(rows["c_nationkey"].iloc[0])], "content": [office.write_workbook(sheets)]})

    books = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").groupBy("c_nationkey").applyInPandas(write, "c_nationkey int, content binary")
    cells = office.read_files(books, "xlsx", "c_nationkey")
    # of number cells the value is compared, not its text
    number = F.when(~F.isnan("number"), F.col("number"))
    return cells.select("c_nationkey", "place", F.when(number.isNull(), F.col("text")).alias("text"), number.alias("number"), "error")


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as word-processor files, read back: lines with a bar are table rows."""

    def write(batches):
        for b in batches:
            made = [office.write_document([("row" if "|" in x else "paragraph", x.replace("|", "\t")) for x in t.split("\n")]) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": made})

    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(write, "doc_id long, content binary")
    return office.read_files(files, "docx", "doc_id").select("doc_id", "ord", "text", "error")


def presentation_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as presentations: a slide a turn, its role the title."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        return pd.DataFrame({"conv_id": [int(rows["conv_id"].iloc[0])], "content": [office.write_presentation([[("title", r), ("body", t)] for r, t in zip(rows["role"], rows["text"], strict=True)])]})

    files = table(spark, sf_dir, "conversations").groupBy("conv_id").applyInPandas(write, "conv_id long, content binary")
    return office.read_files(files, "pptx", "conv_id").select("conv_id", "place", "text", "error")


def cipher_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names enciphered with RC4 and AES and deciphered again, with Spark's own AES beside."""

    def run(batches):
        for b in batches:
            rows = []
            for key, name in zip(b["p_partkey"], b["p_name"], strict=True):
                k, plain = int(key).to_bytes(16, "little"), name.encode()
                secret = crypto.cbc_encrypt(k, bytes(16), plain)
                rows.append((key, secret, crypto.cbc_decrypt(k, bytes(16), secret).decode(), crypto.rc4(k, crypto.rc4(k, plain)).decode()))
            yield pd.DataFrame(rows, columns=["p_partkey", "secret", "aes", "rc4"])

    made = table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInPandas(run, "p_partkey long, secret binary, aes string, rc4 string")
    key = F.unhex(F.rpad(F.concat(*[F.lpad(F.hex(F.shiftright("p_partkey", 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]), 32, "0"))
    own = F.aes_decrypt(F.concat(F.lit(bytearray(16)), F.col("secret")), key, F.lit("CBC"), F.lit("DEFAULT")).cast("string")
    return made.select("p_partkey", "aes", "rc4", own.alias("spark"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as uploads of files: which are taken to be merged."""
    kinds = F.array(*map(F.lit, (".pdf", ".PDF", ".docx", "", ".pdf")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("f"), F.element_at(kinds, (F.col("l_partkey") % 5 + 1).cast("int"))).alias("name"), (F.col("l_extendedprice") * 2000).cast("long").alias("size"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"))
    return O.accepted(rows, "l_orderkey", "merge").groupBy("l_orderkey").agg(F.count_if("accepted").alias("taken"), F.count_if(~F.col("accepted")).alias("refused"), F.max("enough").alias("enough"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each document's bytes behind one of the heads of files; of two of them the text is left out."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    text = F.when(F.col("doc_id") % len(HEADS) < 6, F.coalesce("text", F.lit(""))).otherwise("")
    content = F.concat(F.unhex(head), F.encode(text, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", O.file_kind(content).alias("kind"))


def compression_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = F.floor(F.col("o_totalprice") * 16).cast("long"), F.floor(F.col("o_totalprice") * (8 + F.col("o_orderkey") % 12)).cast("long")
    r = O.compression_result(before, after)
    return table(spark, sf_dir, "orders").select("o_orderkey", r["kept"].alias("kept"), r["size"].alias("size"), r["message"].alias("message"))


def compression_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a picture of so many dots an inch, with what its preset leaves of them; the second is taken where none is named."""
    presets = spark.createDataFrame(list(O.PRESETS), "level string, settings string, color_dpi int, gray_dpi int, mono_dpi int, quality double")
    names = F.array(*[F.lit(p[0]) for p in O.PRESETS])
    level = F.coalesce(F.try_element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(O.PRESETS[1][0]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), (F.col("o_custkey") % 600 + 50).cast("int").alias("dpi"))
    return rows.join(F.broadcast(presets), "level").select("o_orderkey", "level", "settings", *[F.least("dpi", c).alias(c) for c in ("color_dpi", "gray_dpi", "mono_dpi")], "quality")


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a recogniser, as line items: those kept, by supplier."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_returnflag", (F.col("l_quantity") * 2).alias("confidence"), F.col("l_shipdate").cast("string").alias("text"), (F.col("l_suppkey") % 40).alias("native_chars"))
    return O.kept_words(rows).groupBy("page").agg(F.count("*").alias("n"))


def recognised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 2).alias("confidence"), F.lit("w").alias("text"), (F.col("l_suppkey") % 40).alias("native_chars"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 40).alias("native_chars"))
    return O.ocr_counts(pages, rows)


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fields of an order's form, filled in with part names."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_returnflag").alias("value"))
    fields = items.select("l_orderkey", F.col("l_linenumber").cast("string").alias("name"), "value", (F.col("p") % 3 == 0).alias("read_only"), F.when(F.col("p") % 5 > 0, (F.col("p") % 5).cast("int")).alias("page"))
    values = items.where("p % 2 = 0").select("l_orderkey", F.col("l_linenumber").cast("string").alias("name"), F.col("p").cast("string").alias("value"))
    return O.filled(fields, values, ["l_orderkey"]).select("l_orderkey", "name", "value", "order")


_size = lambda n: f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN (CAST(floor({n} / 1024 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor({n} / 1024 * 10 + 0.5) AS BIGINT) % 10) || ' KB' ELSE (CAST(floor({n} / 1048576 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor({n} / 1048576 * 10 + 0.5) AS BIGINT) % 10) || ' MB' END"
#: A drawn rule of a part's size, which is a hairline up to size 25, wrapped by text unless the key says otherwise.
DRAWN = """concat('<w:p>', p_name, '</w:p><mc:AlternateContent><wp:anchor behindDoc="0"><wp:extent cx="9" cy="', CAST(p_size * 508 AS VARCHAR(20)), '"/>', CASE WHEN p_partkey % 3 = 0 THEN '<wp:wrapSquare/>' ELSE '<wp:wrapNone/>' END,
'</wp:anchor><v:line style="z-index:', CAST(p_partkey % 10 AS VARCHAR(20)), '"><w10:wrap type="none"/></v:line></mc:AlternateContent><w:p behindDoc="0">', p_brand, '</w:p>')"""


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drawn rules for each part, one of them of thickness 0, repaired."""
    xml = F.expr(DRAWN.replace("VARCHAR(20)", "STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", O.repaired_rules(F.concat(xml, F.regexp_replace(xml, 'cy="[0-9]+"', 'cy="0"'))).alias("xml"))


#: Documents by how their first page ends: what goes, and what stays.
FIRST_PAGES = (
    ("<w:p>{n}</w:p>", '<w:p a="1"><w:r><w:br w:type="page"/></w:r></w:p><w:p>{b}</w:p><w:sectPr/>'),
    ("<w:p>{n}</w:p>", '<w:p><w:r><w:lastRenderedPageBreak/><w:t>{b}</w:t></w:r></w:p><w:sectPr/>'),
    ("<w:tbl>{n}</w:tbl>", "<w:p><w:pPr><w:sectPr>{b}</w:sectPr></w:pPr></w:p><w:p>{b}</w:p><w:sectPr/>"),
    ("<w:p>{n}</w:p><w:p>{b}</w:p>", "<w:sectPr>{b}</w:sectPr>"),
    ("", "<w:p>{n}</w:p>"),
)


def word_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of every form, and without a body, with a cover pinned to each."""
    forms = F.array(*[F.lit(f'<w:document><w:body w:x="1">{gone}{kept}</w:body></w:document>') for gone, kept in FIRST_PAGES], F.lit("<w:document>{n}</w:document>"))
    form = F.element_at(forms, (F.col("p_partkey") % (len(FIRST_PAGES) + 1)).cast("int") + 1)
    xml = F.replace(F.replace(form, F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))
    relations = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 12), lambda i: F.concat(F.lit('<Relationship Id="rId'), (i * F.col("p_size")).cast("string"), F.lit('"/>'))), "")
    cover = F.concat(F.lit("<w:p>cover "), F.col("p_type"), F.lit("</w:p>"))
    return table(spark, sf_dir, "part").select("p_partkey", O.pinned_cover(xml, cover).alias("xml"), O.next_link(relations).alias("link"))


QUERIES = {f.__name__: f for f in (word_covers, word_rules, file_digests, file_checksums, pdf_text, pdf_errors, workbook_cells, document_paragraphs, presentation_slides, cipher_round_trips, uploads, file_kinds, compression_policy, compression_presets, recognised_words, recognised_counts, form_values)}
_KEPT = ", ".join(f"'{O.NEW_PAGE * (gone == '')}{kept}'" for gone, kept in FIRST_PAGES)
SQL = {
    "word_covers": f"""WITH m AS (SELECT *, p_partkey % {len(FIRST_PAGES) + 1} AS form FROM part)
SELECT p_partkey, CASE WHEN form = {len(FIRST_PAGES)} THEN '<w:document>' || p_name || '</w:document>'
  ELSE '<w:document><w:body w:x="1"><w:p>cover ' || p_type || '</w:p>' || replace(replace([{_KEPT}][form + 1], '{{n}}', p_name), '{{b}}', p_brand) || '</w:body></w:document>' END AS xml,
  'rId' || CAST(p_size % 12 * p_size + 1 AS VARCHAR) AS link FROM m""",
    "word_rules": f"""WITH m AS (SELECT p_partkey, p_partkey % 3 <> 0 AS beside, p_size * 508 AS cy, {DRAWN} AS x FROM part),
r AS (SELECT *, regexp_replace(replace(replace(replace(x, '<wp:wrapNone/>', '<wp:wrapTopAndBottom/>'), '<wp:anchor behindDoc="0">', '<wp:anchor behindDoc="1">'), '<w10:wrap type="none"/>', '<w10:wrap type="topAndBottom"/>'), 'z-index:([0-9])', 'z-index:-\\1') AS y FROM m)
SELECT p_partkey, CASE WHEN beside AND cy <= 12700 THEN y ELSE x END || regexp_replace(CASE WHEN beside THEN y ELSE x END, 'cy="[0-9]+"', 'cy="0"') AS xml FROM r""",
    "file_digests": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "pdf_text": f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS text, 'Conversation ' || conv_id AS title, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "pdf_errors": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(unnest(CASE WHEN s_suppkey % 5 = 3 THEN [1, 2] ELSE [0] END) AS INTEGER) AS page, CASE WHEN s_suppkey % 5 = 0 THEN 'password' WHEN s_suppkey % 5 <> 3 THEN 'corrupt' END AS error FROM supplier",
    "workbook_cells": "WITH r AS (SELECT c_nationkey, c_mktsegment, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) + 1 AS n FROM customer) SELECT c_nationkey, c_mktsegment || '!A' || n AS place, c_name AS text, CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS error FROM r UNION ALL SELECT c_nationkey, c_mktsegment || '!B' || n, NULL, c_acctbal, NULL FROM r UNION ALL SELECT DISTINCT c_nationkey, c_mktsegment || '!' || unnest(['A1', 'B1']), unnest(['Customer', 'Balance']), NULL, NULL FROM customer",
    "document_paragraphs": "SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS ord, replace(unnest(p), '|', chr(9)) AS text, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)",
    "presentation_slides": "WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations) SELECT conv_id, n || '.0:title' AS place, role AS text, CAST(NULL AS VARCHAR) AS error FROM s UNION ALL SELECT conv_id, n || '.1:body', text, NULL FROM s",
    "cipher_round_trips": "SELECT p_partkey, p_name AS aes, p_name AS rc4, p_name AS spark FROM part",
    "uploads": "WITH f AS (SELECT l_orderkey, l_partkey % 5 IN (0, 1, 4) AND CAST(l_extendedprice * 2000 AS BIGINT) <= 104857600 AS fit FROM lineitem) SELECT l_orderkey, count(*) FILTER (fit) AS taken, count(*) FILTER (NOT fit) AS refused, count(*) FILTER (fit) >= 2 AS enough FROM f GROUP BY l_orderkey",
    "file_kinds": f"WITH c AS (SELECT doc_id, {list(HEADS)}[doc_id % 8 + 1] || CASE WHEN doc_id % 8 < 6 THEN hex(coalesce(text, '')) ELSE '' END AS c FROM documents) SELECT doc_id, CASE WHEN length(c) < 16 THEN 'empty' WHEN starts_with(c, '255044462D') THEN 'pdf' WHEN starts_with(c, '504B0304') THEN 'package' WHEN starts_with(c, 'D0CF11E0A1B11AE1') THEN 'encrypted' WHEN starts_with(c, 'FFD8FF') THEN 'jpeg' WHEN starts_with(c, '89504E470D0A1A0A') THEN 'png' ELSE 'unknown' END AS kind FROM c",
    "compression_policy": f"WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * 16) AS BIGINT) AS b, CAST(floor(o_totalprice * (8 + o_orderkey % 12)) AS BIGINT) AS a FROM orders), p AS (SELECT *, least(a, b) AS s, (b - least(a, b)) * 100 / b AS pct FROM s) SELECT o_orderkey, a >= b AS kept, s AS size, CASE WHEN pct < 0.5 THEN 'Already small: kept at ' || {_size('s')} ELSE 'Reduced by ' || (CAST(floor(pct * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(pct * 10 + 0.5) AS BIGINT) % 10) || '% (' || {_size('b')} || ' to ' || {_size('s')} || ')' END AS message FROM p",
    "compression_presets": "WITH p(level, settings, c, g, m, quality) AS (VALUES " + ", ".join(f"{p[:-1]}"[:-1] + f", {p[-1]}::DOUBLE)" for p in O.PRESETS) + f"), o AS (SELECT o_orderkey, coalesce({[p[0] for p in O.PRESETS]}[o_orderkey % 4 + 1], '{O.PRESETS[1][0]}') AS level, CAST(o_custkey % 600 + 50 AS INTEGER) AS dpi FROM orders) SELECT o_orderkey, o.level, settings, CAST(least(dpi, c) AS INTEGER) AS color_dpi, CAST(least(dpi, g) AS INTEGER) AS gray_dpi, CAST(least(dpi, m) AS INTEGER) AS mono_dpi, quality FROM o JOIN p ON p.level = o.level",
    "recognised_words": "SELECT l_suppkey AS page, count(*) AS n FROM lineitem WHERE l_suppkey % 40 < 24 AND l_quantity * 2 >= 40 GROUP BY 1",
    "recognised_counts": "WITH w AS (SELECT count(*) AS n FROM lineitem WHERE l_suppkey % 40 < 24 AND l_quantity * 2 >= 40 AND l_suppkey IN (SELECT s_suppkey FROM supplier)) SELECT count(*) FILTER (s_suppkey % 40 < 24) AS recognised, count(*) FILTER (s_suppkey % 40 >= 24) AS skipped, CAST(any_value(n) AS BIGINT) AS words FROM supplier, w",
    "form_values": "WITH i AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_returnflag) AS v FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber::VARCHAR AS name, CASE WHEN p % 3 = 0 OR p % 2 <> 0 THEN v ELSE p::VARCHAR END AS value, CASE WHEN p % 5 > 0 THEN CAST(p % 5 AS INTEGER) ELSE 1000000 END AS \"order\" FROM i",
}
