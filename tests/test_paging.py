"""Pagination by doubled pointers against a plain loop."""

import random

import pytest

from quire.operators import paging


def plain(heights, page, header=0.0):
    n, y, out = 0, header, []
    for h in heights:
        if y + h > page and y > header + 1:
            n, y = n + 1, header
        out.append((n, y))
        y += h
    return out


def paged(spark, tables, page, header):
    rows = [(k, i * 3, float(h)) for k, hs in enumerate(tables) for i, h in enumerate(hs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, ord long, h double").repartition(3)
    got = paging.paged(df, ["k"], ["ord"], "h", page, header, order_band=50.0)
    assert got.columns == ["k", "ord", "h", "page", "top"]
    found = sorted((r.k, r.ord, r.page, r.top) for r in got.collect())
    return [[(p, t) for k, _, p, t in found if k == n] for n in range(len(tables))]


def test_rows_repeat_the_header(spark):
    tables = [[30, 30, 30], [500, 10], [500], [0.5, 500, 0.5, 0.5, 90]]
    want = [[(0, 20), (0, 50), (1, 20)], [(0, 20), (1, 20)], [(0, 20)], [(0, 20), (0, 20.5), (1, 20), (1, 20.5), (1, 21)]]
    assert paged(spark, tables, 100, 20) == want == [plain(t, 100, 20) for t in tables]


@pytest.mark.parametrize(("header", "heights"), [(0.0, (14, 90)), (20.0, (1, 300)), (35.5, (0, 3)), (12.25, (60, 61))])
def test_pages(spark, header, heights):
    rng = random.Random(int(header))
    tables = [[rng.randint(4 * heights[0], 4 * heights[1]) / 4 for _ in range(n)] for n in (1, 2, 70, 400)]
    assert paged(spark, tables, 200.0, header) == [plain(t, 200.0, header) for t in tables]


def test_empty_table(spark):
    assert paging.paged(spark.createDataFrame([], "k int, ord long, h double"), ["k"], ["ord"], "h", 100.0).collect() == []
