"""The pipeline's stages, each against what it promises about its own input."""

import corpus_pipeline
import pytest

from quire.llm import decontamination
from tests.llm.test_operators import brute_components, brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((name, docs.collect()))
    return dict(out)


def test_columns_and_order(stages):
    assert list(stages) == ["documents", "language_id", "line_dedup", "near_duplicates", "decontamination", "bpe_codec"]
    for name in list(stages)[:-1]:
        assert stages[name][0].__fields__ == corpus_pipeline.COLUMNS


def test_language_stage_keeps_texts_with_letters(stages):
    kept = {r.doc_id for r in stages["language_id"]}
    assert all(r.doc_id in kept for r in stages["documents"] if r.text and sum(c.isalpha() for c in r.text) > 20)


def test_line_stage(stages):
    want = brute_lines([(r.doc_id, r.text, r.source) for r in stages["language_id"]], 8, 5)
    assert sorted(((r.doc_id, r.text) for r in stages["line_dedup"]), key=repr) == [x[:2] for x in want]
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_copies_stage_keeps_one_of_each_group(stages):
    groups = brute_components([(r.doc_id, r.text) for r in stages["line_dedup"]], 5)
    assert {r.doc_id for r in stages["near_duplicates"]} == {d for d, (_, _, kept) in groups.items() if kept}


def test_benchmark_stage(spark, sf_dir, stages):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block = decontamination.block(items)
    before, after = stages["near_duplicates"], {r.doc_id for r in stages["decontamination"]}
    assert {r.doc_id for r in before if not any(i in r.text for i in items)} >= after
    assert after == {r.doc_id for r in before if not decontamination.matches(block, [r.text])}


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, stages["bpe_codec"]))
