"""Queries of this subpackage and their SQL, as ``{name: function}`` and ``{name: text}``."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_codec, decontamination, exact_dedup, language_id, line_dedup, lm_scores, media, near_duplicates, periodic_runs, substring_dedup, term_tries, token_counts, token_files
from quire.llm.frames import pick, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scores.score(table(spark, sf_dir, "documents"), target, content(WORD_MODEL).decode(), boundary=49_408)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), content(PIECE_MODEL))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    return language_id.identify(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = content(WORD_MODEL).decode()
    ids = bpe_codec.encode(table(spark, sf_dir, "documents"), vocabulary)
    return bpe_codec.decode(ids, vocabulary, digests=True)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.store(table(spark, sf_dir, "documents"))
    return media.features(images, pixels=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_components(table(spark, sf_dir, "documents"), size=4)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), content(WORD_MODEL).decode(), end_id=1)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_tries.divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), {"doc_id": "doc_id", "text": "text"}).select("doc_id", periodic_runs.made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = (
    op1_decontamination, op2_lm_scores, op3_line_dedup, op4_token_counts, op5_language_id, op6_bpe_codec, op7_media_columns, op8_near_duplicates,
    op9_token_files, op10_substring_dedup, op11_exact_dedup, op12_source_divergence, op13_periodic_runs,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op11_exact_dedup": exact_dedup.SQL, "op12_source_divergence": term_tries.SQL}
