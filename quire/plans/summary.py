"""Queries over documents: sentences, summaries, answers; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import summary
from quire.sources.tables import table

QUESTION = "What is the passage about language and nation, and where does it end?"
B = T.BLANK

SENTENCES_CTE = f"""
norm AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^{B}+|{B}+$', '', 'g') AS t FROM documents),
cut AS (
  SELECT doc_id, 0 AS way, string_split(regexp_replace(t, '([.!?]){B}+', '\\1' || chr(1), 'g'), chr(1)) AS parts, 1 AS least FROM norm WHERE t <> ''
  UNION ALL SELECT doc_id, 1, string_split_regex(t, '\\n+'), 8 FROM norm WHERE t <> ''
  UNION ALL SELECT doc_id, 2, list_transform(range(0, len(w), 12), lambda i: array_to_string(w[i + 1 : i + 18], ' ')), 8
    FROM (SELECT doc_id, t, regexp_extract_all(t, '[^{T.BLANKS}]+') AS w FROM norm WHERE length(t) >= 8)),
flat AS (SELECT doc_id, way, unnest(range(len(parts))) AS place, regexp_replace(unnest(parts), '^{B}+|{B}+$', '', 'g') AS s, least FROM cut),
kept AS (SELECT * FROM flat WHERE length(s) >= least),
uniq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY way, place) AS n FROM kept),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY way, place) - 1 AS idx, s FROM uniq WHERE n = 1)
"""
SCORED_CTE = f"""{SENTENCES_CTE},
term AS (SELECT doc_id, idx, unnest(regexp_extract_all(lower(s), '{T.TERM}')) AS w FROM sent),
freq AS (SELECT doc_id, w, count(*) AS f FROM term GROUP BY doc_id, w),
sums AS (SELECT t.doc_id, t.idx, sum(f.f) AS f, count(*) AS n FROM term t JOIN freq f ON t.doc_id = f.doc_id AND t.w = f.w GROUP BY t.doc_id, t.idx),
scored AS (SELECT s.doc_id, s.idx, s.s, CAST(coalesce(x.f, 0) AS DOUBLE) / greatest(coalesce(x.n, 0), 1) + CASE WHEN s.idx < 3 THEN 1.5 ELSE 0 END AS score FROM sent s LEFT JOIN sums x ON s.doc_id = x.doc_id AND s.idx = x.idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r, least(8, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY doc_id) * CAST(0.35 AS DOUBLE)) AS BIGINT))) AS picks FROM scored),
chosen AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS ord, s AS sentence, score FROM ranked WHERE r <= picks)
"""


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summaries(table(spark, sf_dir, "documents"))


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.summaries(table(spark, sf_dir, "documents"))
    return summary.summary_texts(rows, F.concat(F.lit("document "), F.col("doc_id").cast("string")))


def sentence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sentences(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "idx", F.col("s").alias("sentence"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.punctuated(t)).alias("punctuated"), F.size(T.long_lines(t)).alias("lines"), F.size(T.chunks(t)).alias("chunks"))


def keyword_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return summary.answers(docs, F.lit(QUESTION))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the first user turn from the assistant's text of the same conversation."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    said = talk.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return summary.answers(said, asked, "conv_id").drop("question")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(T.terms(F.col("text"))).alias("term"))
    return rows.groupBy("lang", "term").agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in T.QUESTION_WORDS)
QUERIES = {f.__name__: f for f in (extractive_summary, summary_text, sentence_union, sentence_counts, keyword_answers, conversation_answers, term_frequency)}
SQL = {
    "extractive_summary": f"WITH {SCORED_CTE} SELECT doc_id, ord, sentence, score FROM chosen",
    "summary_text": f"WITH {SCORED_CTE} SELECT doc_id, 'Summary of document ' || doc_id || chr(10) || chr(10) || string_agg(ord || '. ' || sentence, chr(10) ORDER BY ord) || chr(10) AS summary FROM chosen GROUP BY doc_id",
    "sentence_union": f"WITH {SENTENCES_CTE} SELECT doc_id, CAST(idx AS INTEGER) AS idx, s AS sentence FROM sent",
    "sentence_counts": f"WITH {SENTENCES_CTE}, n AS (SELECT doc_id, way, CAST(count(*) AS INTEGER) AS n FROM kept GROUP BY doc_id, way) SELECT d.doc_id, coalesce(a.n, 0) AS punctuated, coalesce(b.n, 0) AS lines, coalesce(c.n, 0) AS chunks FROM documents d LEFT JOIN n a ON a.doc_id = d.doc_id AND a.way = 0 LEFT JOIN n b ON b.doc_id = d.doc_id AND b.way = 1 LEFT JOIN n c ON c.doc_id = d.doc_id AND c.way = 2",
    "keyword_answers": f"""WITH {SENTENCES_CTE},
keys AS (SELECT list_filter(regexp_extract_all(lower('{QUESTION}'), '{T.TERM}'), lambda w: w NOT IN ({STOP})) AS k),
hits AS (SELECT doc_id, idx, s, CAST(len(list_filter(k, lambda w: contains(lower(s), w))) AS INTEGER) AS hits FROM sent, keys),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, idx) AS INTEGER) AS ord FROM hits WHERE hits > 0)
SELECT doc_id, '{QUESTION}' AS question, ord, s AS sentence, hits FROM r WHERE ord <= 4""",
    "conversation_answers": f"""WITH asked AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
documents AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
keys AS (SELECT conv_id, list_filter(regexp_extract_all(lower(question), '{T.TERM}'), lambda w: w NOT IN ({STOP})) AS k FROM asked),
{SENTENCES_CTE},
hits AS (SELECT doc_id AS conv_id, idx, s, CAST(len(list_filter(k, lambda w: contains(lower(s), w))) AS INTEGER) AS hits FROM sent JOIN keys ON sent.doc_id = keys.conv_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, idx) AS INTEGER) AS ord FROM hits WHERE hits > 0)
SELECT conv_id, ord, s AS sentence, hits FROM r WHERE ord <= 4
UNION ALL SELECT conv_id, 0, 'Ask a more specific question about the document.', 0 FROM keys WHERE len(k) = 0""",
    "term_frequency": f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{T.TERM}')) AS term FROM documents) GROUP BY lang, term",
}
