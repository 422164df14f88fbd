"""Queries that compare versions of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import BLANKS, words
from quire.operators import diff as D
from quire.sources.tables import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one before it in its source. Only ids go through the window; texts are joined to the pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    w = Window.partitionBy("source").orderBy("doc_id")
    pairs = docs.select("doc_id", F.lag("doc_id").over(w).alias("earlier")).where("earlier is not null")
    pairs = pairs.join(docs.select(F.col("doc_id").alias("earlier"), F.col("text").alias("before")).where("before is not null"), "earlier")
    return pairs.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "before", "text")


def diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words at the head and tail of neighbouring turns of a conversation with a word put in."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.col("text")).alias("a"))
    rows = rows.withColumn("b", F.concat(F.slice("a", 1, (F.col("turn") + 2).cast("int")), F.array(F.lit("##")), F.slice("a", (F.col("turn") + 4).cast("int"), 10_000_000)))
    rows = rows.withColumn("head", D.common_head(F.col("a"), F.col("b")))
    return rows.select("conv_id", "turn", "head", D.common_tail(F.col("a"), F.col("b"), F.col("head")).alias("tail"))


def diff_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_diffs(_pairs(spark, sf_dir), ["doc_id"], "before", "text")


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.change_counts(diff_parts(spark, sf_dir), ["doc_id"])


def diff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as pages, against those of the conversation before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    left = rows.select((F.col("conv_id") + 1).alias("conv_id"), "turn", "text")
    return D.page_pairs(left, rows, ["conv_id", "turn"])


QUERIES = {f.__name__: f for f in (diff_edges, diff_parts, diff_counts, diff_pages)}
_HEAD = "coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true) - 1, least(len({a}), len({b})))"
SQL = {
    "diff_edges": f"WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^{BLANKS}]+') AS a FROM conversations), p AS (SELECT *, list_concat(a[1 : turn + 2], ['##'], a[turn + 4 :]) AS b FROM w), h AS (SELECT *, {_HEAD.format(a='a', b='b')} AS head FROM p), r AS (SELECT *, list_reverse(a[head + 1 :]) AS ra, list_reverse(b[head + 1 :]) AS rb FROM h) SELECT conv_id, turn, CAST(head AS INTEGER) AS head, CAST({_HEAD.format(a='ra', b='rb')} AS INTEGER) AS tail FROM r",
    "diff_pages": "WITH l AS (SELECT conv_id + 1 AS conv_id, turn, text, true AS there FROM conversations), r AS (SELECT conv_id, turn, text, true AS there FROM conversations) SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, CASE WHEN r.there IS NULL THEN 'left' WHEN l.there IS NULL THEN 'right' END AS only_in, r.there IS NOT NULL AND l.there IS NOT NULL AND l.text IS DISTINCT FROM r.text AS changed FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn",
}
