"""Groups of equal texts against brute force, and the index behind them."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup
from quire.llm.frames import stored


def brute(rows):
    """(id, keep_id, group_size) of rows (id, text), and the number of rows that stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted(((i, max(g, key=key), len(g)) for g in groups.values() for i in g), key=repr), len(groups)


TEXTS = ["", None, "a", "a ", "A", "é", "é", "日本", "x\ny", "x\r\ny", "word " * 40_000, "word " * 39_999 + "word", *[f"t{i % 7}" for i in range(60)]]


@pytest.mark.parametrize(("bits", "broadcast"), [(64, 1_000), (64, 0), (3, 1_000), (3, 0), (1, 1_000)])
def test_equal_texts(spark, monkeypatch, bits, broadcast):
    from quire.llm import frames

    monkeypatch.setattr(frames, "FEW_ROWS", 10)
    monkeypatch.setattr(frames, "HOT_ROWS", 5)
    rows = [(i * 37 % 101, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (None, None), (500, "only here"), (None, "nobody else's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_groups(docs, bits=bits, broadcast_keys=broadcast, capacity=4).collect()
    want, stay = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == stay
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 2 + [(0, "a")], "doc_id long, text string").repartition(3)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(0, 6, False), *[(1, 6, False)] * 4, (1, 6, True), (2, 2, False), (2, 2, True)]


def test_texts_are_compared_as_made_normal(spark):
    docs = spark.createDataFrame([(1, " A  b"), (2, "a B "), (3, "ab")], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, normal=lambda t: F.trim(F.lower(F.regexp_replace(t, " +", " "))))
    assert sorted((r.doc_id, r.keep_id) for r in got.collect()) == [(1, 2), (2, 2), (3, 3)]


def test_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, TEXT int, id string, `key` int, n int, row int, `head.row` int"
    docs = spark.createDataFrame([(1, "a", 1, "q", 1, 1, 1, 1), (2, "a", 2, "r", 2, 2, 2, 2)], schema)
    got = exact_dedup.exact_groups(docs, keep=("id", "n"))
    assert got.columns == ["id", "n", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.id, r.n, r.keep_id) for r in got.collect()) == [("q", 1, 2), ("r", 2, 2)]
    assert exact_dedup.exact_groups(docs.where("doc_id > 9")).collect() == []


@pytest.mark.parametrize(("rows", "capacity", "deepest"), [(0, 4, 16), (1, 4, 16), (1_000, 4, 16), (1_000, 4, 3), (1_000, 10_000, 16)])
def test_directory(spark, rows, capacity, deepest):
    """Every prefix has one bucket; a bucket is overfull only at full depth, and no two halves would fit into one."""
    slots = stored(spark.range(rows).select(exact_dedup.text_key(F.col("id").cast("string")).alias("key")), "slots")
    full = exact_dedup.depth_of(rows, 64, capacity, deepest)
    got = exact_dedup.directory(slots, 64, capacity, deepest).collect()
    assert sorted(r.entry for r in got) == list(range(1 << full))
    buckets = {(r.bucket, r.depth): r.slots for r in got}
    assert sum(buckets.values()) == rows
    assert all(n <= capacity or d == full for (_, d), n in buckets.items())
    for b, d in buckets:
        if d:
            other = b ^ (1 << full - d)
            inside = sum(n for (x, _), n in buckets.items() if x >> (full - d + 1) == b >> (full - d + 1))
            assert inside > capacity, (b, d, other)


def test_index_lies_in_key_ranges(spark):
    keys = spark.range(3_000).select(exact_dedup.text_key((F.col("id") % 1_000).cast("string")).alias("key"), "id", F.col("id").alias("row"))
    found = exact_dedup.index(keys, capacity=50)
    rows = found.withColumn("part", F.input_file_name()).collect()
    assert len(rows) == 1_000 and all(r.n == 3 and r.head.id >= 2_000 for r in rows)
    ranges = defaultdict(list)
    for r in rows:
        ranges[r.part].append(r.key)
    spans = sorted((min(k), max(k)) for k in ranges.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
