"""Cleaning of the documents table for training, in stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_codec, decontamination, language_id, line_dedup, near_duplicates
from quire.llm.frames import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if one language has at least this probability.
LEAST_SCORE = 0.5


@functools.cache
def _vocabulary() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or whose language stays in doubt."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    named = language_id.identify(docs, model, keep=tuple(COLUMNS))
    return named.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of the texts; n_chars follows.

    A page of nothing but boilerplate is a copy of other pages, of which the
    next stage keeps one; without its text that stage could not tell.
    """
    kept = line_dedup.drop_boilerplate(docs, min_pages=5, keep_pages=True)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) keeps the document with the smallest id."""
    copies = near_duplicates.similar_components(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a passage of one."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the text that they decode to."""
    return bpe_codec.round_trip(docs, _vocabulary(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("bpe_codec", encode),
]

#: SQL cannot express language identification, near-duplicates, alignment or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
