"""Extractive summaries and keyword answers.

A text falls into sentences three ways: after closing punctuation, by line, and
as overlapping runs of words. Their union, in that order and without repeats
(case aside), is scored by how frequent each sentence's terms are in all of
them; the first three get a bonus. The best make the summary, in order.

All of it happens within a row, so no text is shuffled. Columns cut the
sentences; each is met once, and terms are counted, by a dictionary of the
document, which arrays could only do in a time that grows with the square of
its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T

#: Fixed values.
BONUS_FIRST, BONUS, SHARE, MOST, ANSWERS = 3, 1.5, 0.35, 8, 4
NO_KEYWORDS = "Ask a more specific question about the document."
TERM = re.compile(T.TERM)


def pieces(text: Column) -> Column:
    """Sentences of a normalized text in order, with repeats."""
    return F.concat(T.punctuated(text), T.long_lines(text), T.chunks(text))


def _by_row(docs: DataFrame, id_col: str, text_col: str, names: list[str], fields: str, work: Callable[[list[str], list[str]], list[tuple]]) -> DataFrame:
    """id and ``fields``: the rows that ``work`` makes of each document's sentences, met once each, and their lower-case forms."""
    rows = docs.select(F.col(id_col).alias("id"), T.normalized(F.col(text_col)).alias("t")).where("t <> ''").select("id", pieces(F.col("t")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(made)
        for batch in batches:
            out, source = [], []
            for n, s in enumerate(batch.column(1).to_pylist()):
                first: dict[str, str] = {}
                for x in s:
                    first.setdefault(x.lower(), x)
                found = work(list(first.values()), list(first))
                out += found
                source += [n] * len(found)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(own)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *arrays], names=own.names)

    made = StructType([rows.schema["id"], *StructType.fromDDL(fields).fields])
    return rows.mapInArrow(run, made)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx (from 0), s: the sentences of every document, each once."""
    return _by_row(docs, id_col, text_col, ["idx", "s"], "idx int, s string", lambda s, low: list(enumerate(s)))


def _best(s: list[str], low: list[str]) -> list[tuple]:
    terms = [TERM.findall(x) for x in low]
    often = Counter(t for own in terms for t in own)
    scores = [sum(often[t] for t in own) / max(len(own), 1) + (BONUS if i < BONUS_FIRST else 0.0) for i, own in enumerate(terms)]
    most = min(MOST, max(1, -int(-len(s) * SHARE // 1)))
    best = sorted(sorted(range(len(s)), key=lambda i: (-scores[i], i))[:most])
    return [(n, s[i], scores[i]) for n, i in enumerate(best, 1)]


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord (from 1), sentence and score of the picked sentences."""
    rows = _by_row(docs, id_col, text_col, ["ord", "sentence", "score"], "ord int, sentence string, score double", _best)
    return rows.withColumnRenamed("id", id_col)


def summary_texts(rows: DataFrame, name: Column, id_col: str = "doc_id") -> DataFrame:
    """One text for each document: a heading with its name, and the numbered sentences."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: F.concat(x["ord"].cast("string"), F.lit(". "), x["sentence"]))
    return rows.groupBy(id_col).agg(lines.alias("lines")).select(id_col, F.concat(F.lit("Summary of "), name, F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("summary"))


def answers(docs: DataFrame, questions: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, question, ord, sentence, hits: the sentences of each document that hold most keywords of a question.

    ``questions`` is a question asked of all documents, or a table (id,
    question) that goes with them by id. A question without keywords gives one
    row with ord 0 and a request for a better one.
    """
    if isinstance(questions, Column):
        asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), questions.alias("question"))
    else:
        asked = questions.select(F.col(id_col).alias("id"), "question").join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "left")
    kind = "array<struct<hits: int, idx: int, s: string, low: string>>"

    def ranked(text: Column, keys: Column) -> Column:
        rows = F.transform(pieces(text), lambda s, i: F.struct((-T.containment(s, keys)).alias("hits"), i.alias("idx"), s.alias("s"), F.lower(s).alias("low")))
        return F.array_sort(F.filter(rows, lambda x: x["hits"] < 0)).cast(kind)

    def first(found: Column, x: Column) -> Column:
        more = (F.size(found) < ANSWERS) & ~F.exists(found, lambda y: y["low"] == x["low"])
        return F.when(more, F.concat(found, F.array(x))).otherwise(found)

    keys, text = T.question_terms(F.col("question")), T.normalized(F.col("text"))
    rows = asked.where("question is not null").select("id", "question", keys.alias("keys"), F.when(text != "", text).alias("t"))
    none = F.array(F.struct(F.lit(0).alias("hits"), F.lit(-1).alias("idx"), F.lit(NO_KEYWORDS).alias("s"), F.lit(None).cast("string").alias("low"))).cast(kind)
    best = F.aggregate(ranked(F.col("t"), F.col("keys")), F.array().cast(kind), first)
    rows = rows.select("id", "question", F.posexplode(F.when(F.size("keys") == 0, none).otherwise(best)).alias("place", "x"))
    ord_ = F.when(F.col("x.idx") >= 0, F.col("place") + 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), "question", ord_.alias("ord"), F.col("x.s").alias("sentence"), (-F.col("x.hits")).alias("hits"))
