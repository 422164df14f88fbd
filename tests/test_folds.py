"""Segmented folds against plain loops over whole pages, and cases worked out by hand."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire.operators import folds


def plain_stretches(values, reach):
    """Opening value of the stretch of each value."""
    out, opened, last = {}, None, None
    for v in sorted(values):
        if last is None or v - last > reach:
            opened = v
        out[v], last = opened, v
    return out


def plain_lines(spans):
    made = []
    for s in sorted(spans, key=lambda s: (s["baseline"], s["x"], s["span_id"])):
        if made:
            small, large = sorted((s["size"], made[-1]["size"]))
            reach = max(2.0, large * 0.5) if small < large * 0.85 else max(1.6, small * 0.3)
        if made and abs(s["baseline"] - made[-1]["ref"]) <= reach:
            made[-1]["spans"].append(s)
            if s["text"].strip() and s["size"] > made[-1]["size"]:
                made[-1].update(size=s["size"], ref=s["baseline"])
        else:
            made.append({"spans": [s], "size": s["size"], "ref": s["baseline"]})
    out = []
    for line in made:
        weight = {}
        for s in sorted(line["spans"], key=lambda s: (s["x"], s["span_id"])):
            key = int(s["size"] * 2 + 0.5) / 2
            weight[key] = weight.get(key, 0) + len(s["text"].strip()) + 1
        size = max(weight, key=weight.get)
        main = [s["baseline"] for s in line["spans"] if s["text"].strip() and abs(s["size"] - size) < 0.6]
        base = statistics.median_high(main or [s["baseline"] for s in line["spans"]])
        out.append((base - size, min(s["x"] for s in line["spans"]), base, size, line["spans"]))
    out.sort(key=lambda x: x[:2])
    return sorted((n, s["span_id"], size, base) for n, (_, _, base, size, spans) in enumerate(out) for s in spans)


def plain_groups(items):
    out = []
    for i in sorted(items, key=lambda i: (-i["y"], i["x"], i["item_id"])):
        home = next((g for g in out if abs(g[0]["y"] - i["y"]) <= max(3.5, g[0]["h"] * 0.45)), None)
        out.append([i]) if home is None else home.append(i)
    return sorted((n, i["item_id"]) for n, g in enumerate(out) for i in g)


def plain_hits(hits):
    out = []
    for h in sorted(hits, key=lambda h: h["hit_id"]):
        if not any(abs(u["x"] - h["x"]) < 1.5 and abs(u["y"] - h["y"]) < 1.5 and abs(u["w"] - h["w"]) < 2 for u in out):
            out.append(h)
    return sorted(h["hit_id"] for h in out)


@pytest.mark.parametrize("height", [60, 900, 20_000])
def test_stretches_and_ranks(spark, height):
    rng = random.Random(height)
    rows = [(p, i, float(rng.randint(0, height) * rng.choice([1, 1, 0]) - 40)) for p in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "page int, id long, v double").repartition(3)
    got = folds.stretches(df, ["page"], "v", F.lit(7.0)).collect()
    want = {p: plain_stretches([v for q, _, v in rows if q == p], 7.0) for p in (1, 2)}
    assert len(got) == len(rows) and all(r.stretch == want[r.page][r.v] for r in got)
    ranks = folds.ranked(df, ["page"], ["v", "id"], "n").collect()
    for p in (1, 2):
        assert [r.id for r in sorted((r for r in ranks if r.page == p), key=lambda r: r.n)] == [i for _, i, _ in sorted((x for x in rows if x[0] == p), key=lambda x: (x[2], x[1]))]


def spans_of(rng, n, height):
    return [{"page": 1, "span_id": i, "text": rng.choice(["word", "a", " ", "longer text"]), "x": float(rng.randint(0, 30)), "baseline": float(rng.randint(0, height)) / 2, "size": rng.choice([6.0, 8.0, 9.0, 12.0, 12.4, 30.0])} for i in range(n)]


@pytest.mark.parametrize(("n", "height"), [(1, 10), (60, 80), (120, 3_000), (200, 900)])
def test_lines(spark, n, height):
    spans = spans_of(random.Random(n), n, height)
    got = folds.text_lines(spark.createDataFrame(spans, "page int, span_id long, text string, x double, baseline double, size double"))
    assert sorted((r.line, r.span_id, r["size"], r.baseline) for r in got.collect()) == plain_lines(spans)


def test_a_raised_figure_stays_with_its_line(spark):
    rows = [(1, 1, "word", 10.0, 100.0, 12.0), (1, 2, "2", 40.0, 95.0, 7.0), (1, 3, "next", 10.0, 114.0, 12.0)]
    got = folds.text_lines(spark.createDataFrame(rows, "page int, span_id long, text string, x double, baseline double, size double"))
    assert sorted((r.line, r.span_id, r["size"]) for r in got.collect()) == [(0, 1, 12.0), (0, 2, 12.0), (1, 3, 12.0)]


@pytest.mark.parametrize(("n", "height"), [(80, 60), (150, 2_000)])
def test_groups(spark, n, height):
    rng = random.Random(n)
    items = [{"page": 1, "item_id": i, "x": float(rng.randint(0, 9)), "y": rng.randint(-height, height) / 2, "h": float(rng.choice([4, 8, 20]))} for i in range(n)]
    got = folds.text_groups(spark.createDataFrame(items, "page int, item_id long, x double, y double, h double"))
    assert sorted((r.line, r.item_id) for r in got.collect()) == plain_groups(items)


def test_groups_by_first_item(spark):
    rows = [(1, i, float(x), float(y), 10.0) for i, (x, y) in enumerate([(5, 100), (1, 97), (9, 94), (0, 80)])]
    got = folds.text_groups(spark.createDataFrame(rows, "page int, item_id long, x double, y double, h double"))
    assert sorted((r.line, r.item_id) for r in got.collect()) == [(0, 0), (0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("spread", [4, 40])
def test_hits(spark, spread):
    rng = random.Random(spread)
    hits = [{"page": 1, "hit_id": i, "x": rng.randint(0, 4 * spread) / 4, "y": rng.randint(0, 4 * spread) / 4, "w": rng.randint(0, 12) / 2} for i in range(250)]
    got = folds.distinct_hits(spark.createDataFrame(hits, "page int, hit_id long, x double, y double, w double").repartition(3))
    assert sorted(r.hit_id for r in got.collect()) == plain_hits(hits)


def test_hits_within_a_hair_count_once(spark):
    rows = [(1, i, float(x), float(y), float(w)) for i, (x, y, w) in enumerate([(0, 0, 10), (1, 1, 11), (2.4, 0, 10), (0, 0, 12)])]
    got = folds.distinct_hits(spark.createDataFrame(rows, "page int, hit_id long, x double, y double, w double"))
    assert sorted(r.hit_id for r in got.collect()) == [0, 2, 3]


def test_empty_tables(spark):
    assert folds.text_lines(spark.createDataFrame([], "page int, span_id long, text string, x double, baseline double, size double")).collect() == []
    assert folds.text_groups(spark.createDataFrame([], "page int, item_id long, x double, y double, h double")).collect() == []
    assert folds.distinct_hits(spark.createDataFrame([], "page int, hit_id long, x double, y double, w double")).collect() == []


def plain_bands(lines, height):
    lines = sorted(lines, key=lambda x: (x[1], x[0]))
    n = len(lines)
    if n < 4:
        return sorted((i, "body") for i, *_ in lines)
    body = statistics.median_high([x[3] for x in lines])
    gaps = [b[1] - a[2] for a, b in zip(lines, lines[1:], strict=False)]
    near = [g for g in gaps if g > -2]
    apart = max(10, max(statistics.median_high(near) if near else 0, body * 0.3) * 2.2, body * 1.4)
    small = lambda band: all(x[3] <= body * 1.12 for x in band)
    end, start = 0, n
    i = next((i for i in range(1, min(3, n - 1) + 1) if gaps[i - 1] >= apart), None)
    if i and lines[i - 1][2] <= height * 0.18 and small(lines[:i]):
        end = i
    j = next((j for j in range(n - 1, max(end + 1, n - 3) - 1, -1) if gaps[j - 1] >= apart), None)
    if j and lines[j][1] >= height * 0.82 and small(lines[j:]):
        start = j
    return sorted((x[0], "header" if k < end else "footer" if k >= start else "body") for k, x in enumerate(lines))


def test_bands(spark):
    rng = random.Random(6)
    pages = {}
    for p in range(120):
        tops = rng.sample(range(0, 790, rng.choice([11, 12, 40])), rng.choice([1, 3, 4, 5, 9, 18]))
        pages[p] = [(i, float(y), y + 10.0, float(rng.choice([9, 9, 9, 10, 11, 30]))) for i, y in enumerate(tops)]
    df = spark.createDataFrame([(p, *x, 792.0) for p, xs in pages.items() for x in xs], "page int, line_id long, y0 double, y1 double, size double, page_height double")
    got = folds.bands(df.repartition(3)).collect()
    want = sorted((p, *x) for p, xs in pages.items() for x in plain_bands(xs, 792.0))
    assert sorted((r.page, r.line_id, r.band) for r in got) == want
    assert {b for _, _, b in want} == {"header", "body", "footer"}


def test_medians_and_rows_before(spark):
    rng = random.Random(7)
    rows = [(k, i, float(rng.randint(-300, 300))) for k, n in enumerate((1, 2, 9, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(3)
    assert {r.k: r.m for r in folds.upper_medians(df, ["k"], "v", "m").collect()} == {k: statistics.median_high([v for q, _, v in rows if q == k]) for k in range(4)}
    got = {(r.k, r.i): r.p for r in folds.previous(df, ["k"], ["v", "i"], "v", "p").collect()}
    for k in range(4):
        ordered = sorted((v, i) for q, i, v in rows if q == k)
        assert [got[k, i] for _, i in ordered] == [None, *[v for v, _ in ordered[:-1]]]
