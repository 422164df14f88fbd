"""What lets queries finish on larger tables: work is dealt out, and equal rows are judged once."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import areas
from quire.operators import geometry as G
from quire.operators import graph, pii
from quire.operators import layout as L
from quire.plans import editor
from quire.plans import pii as cards


def test_cards_are_dealt_to_all_cores(spark, sf_dir):
    made = cards.cards(spark, sf_dir)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(1 for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) >= 4


def test_matches_of_texts_with_marks(spark):
    texts = ["", "ab", "xab\x01ab", "\x01", "abab", "ab\x01", "é ab ü", "x"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: None if r.m is None else [(m.value, m.start, m.stop) for m in r.m] for r in df.select("t", T.matches(F.col("t"), "ab").alias("m")).collect()}
    assert got == {**{t: [("ab", i, i + 2) for i in range(len(t)) if t[i : i + 2] == "ab"] for t in texts}, None: None}


def test_cheap_conditions_lose_no_hit(spark):
    lines = ["+91 (98765) 4-3210", "98765 43210", "98.76.54.32.10", "4111-1111 1111  1111", "A@B.CO", "a@b.co.", "HTTPS://GITHUB.COM/x", "1/1/1999", "1999.1.1", "123-45-6789", "12345678901234567890", "9876543210a", "x9876543210"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    checks = {"phone": pii.is_phone, "card": pii.is_card}
    every = F.concat(*(pii._kinded(T.matches(F.col("t"), pii.java(p)), kind, checks.get(kind)) for kind, p in pii.PATTERNS.items()))
    rows = df.select("t", pii.pattern_hits(F.col("t")).alias("got"), every.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(len(r.got) for r in rows) >= 8


def test_small_pages_are_dealt_to_all_cores(spark):
    pages = spark.range(2000).groupBy((F.col("id") % 500).alias("page")).agg(F.count("*").alias("n"))
    made = L.per_page(pages, ["page"], "n int, name string", lambda rows: [(len(rows), "x"), (0, None)])
    assert sum(1 for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) >= 4
    assert sorted((r.page, r.n, r.name) for r in made.collect()) == sorted([(p, 1, "x") for p in range(500)] + [(p, 0, None) for p in range(500)], key=lambda r: (r[0], r[1]))
    assert L.per_page(pages.where("page < 0"), ["page"], "n int", lambda rows: [(1,)]).collect() == []


def test_chains_have_no_bound_on_rows(spark):
    with_limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 10)
    try:
        links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, None)], "id long, base long")
        got = {r.id: (r.depth, r.path) for r in graph.chains(links).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", with_limit)
    way = lambda ids: "/" + "".join(f"{i}/" for i in ids)
    want = {i: (min(i - 1, 20), way(range(i, max(0, i - 21), -1))) for i in range(1, 40)}
    assert got == want | {50: (1, "/50/51/"), 51: (1, "/51/50/"), 60: (0, "/60/")}


def test_steps_of_transforms_do_not_grow_into_one_another(spark, sf_dir):
    plan = editor.editor_transforms(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_equal_spans_meet_equal_rules_once(spark):
    rules = spark.createDataFrame([(1, 10.0, 0.0, 60.0)] * 300 + [(1, 11.0, 61.0, 100.0)] * 300 + [(1, 300.0, 0.0, 50.0)], "page int, pos double, start double, `end` double")
    rows = [(1, i, 12.0, 0.0, 100.0) for i in range(300)] + [(1, 900, 300.0, 0.0, 100.0), (2, 901, 12.0, 0.0, 100.0), (1, 902, None, 0.0, 100.0)]
    got = G.covered(rules, spark.createDataFrame(rows, "page int, span_id long, pos double, low double, high double"))
    assert {r.span_id: r.covered for r in got.collect()} == {**{i: True for i in range(300)}, 900: False, 901: False, 902: False}
    assert _joined(got) < 2_000


def test_equal_lines_meet_equal_fills_once(spark):
    fills = spark.createDataFrame([(1, i, 0.0, 0.0, 100.0, 50.0, f"c{i}") for i in range(300)] + [(1, 999, 0.0, 0.0, 90.0, 50.0, "small"), (1, 5000, 0.0, 0.0, 10.0, 10.0, "FFFFFF")], "page int, fill_id long, x0 double, y0 double, x1 double, y1 double, color string")
    lines = spark.createDataFrame([(1, i, 5.0, 5.0, 95.0, 15.0) for i in range(300)] + [(1, 700, 5.0, 5.0, 20.0, 15.0), (1, 701, 500.0, 5.0, 520.0, 15.0)], "page int, line_id long, x0 double, y0 double, x1 double, y1 double")
    got = G.shaded(lines, fills)
    assert {r.line_id: r.shading for r in got.collect()} == {**{i: "c0" for i in range(300)}, 700: "small", 701: None}
    assert _joined(got) < 2_000


def _joined(df):
    """The most rows that a join of the finished query made."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    most, left = 0, [plan]
    while left:
        node = left.pop()
        kids = node.children()
        left += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in node.nodeName():
            left.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_pages_of_any_size_are_clustered_alike(spark):
    rng = random.Random(9)
    places = [(p, i, rng.randrange(0, 900, 30), rng.randrange(0, 900, 30), rng.choice((0, 10, 40, -25))) for p, n in ((1, 5), (2, 40), (3, 90), (4, 1)) for i in range(n)]
    rows = [(p, i, float(x), float(y), float(x + w), float(y + 10)) for p, i, x, y, w in places]
    rows += [(2, 500, None, 1.0, 2.0, 3.0), (3, 500, 1.0, 1.0, None, 3.0), (3, 501, 1.0, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "page int, id long, x0 double, y0 double, x1 double, y1 double").repartition(5)
    every = [{(r.page, r.id): r.cluster for r in areas.clusters(df, local=local).collect()} for local in (10**6, 60, 20, 0)]
    assert every[0] == every[1] == every[2] == every[3] and len(every[0]) == len(rows)
    assert len(set(every[0].items())) == len(rows) and len({(p, c) for (p, _), c in every[0].items()}) > 10


def test_a_page_is_clustered_in_one_pass(spark, monkeypatch):
    # rounds over all pages fill the disk
    monkeypatch.setattr(areas, "components", None)
    df = spark.range(3000).select((F.col("id") % 300).alias("page"), "id", (F.col("id") * 7 % 90).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 7 % 90 + 5).cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    assert areas.clusters(df).count() == 3000


def test_labels_of_pages_of_any_size(spark):
    rng = random.Random(5)
    regions = [(p, i, float(x), float(y), x + 60.0, y + 50.0, 600.0, 800.0) for p in range(5) for i in range(p) for x, y in [(rng.randrange(500), rng.randrange(700))]]
    spans = [(p, rng.choice(("label", "", "x" * 50)), float(x), float(x + rng.choice((20, 70))), float(y), float(y + 9), float(rng.choice((7, 9, 14)))) for p in range(1, 6) for x, y in [(rng.randrange(600), rng.randrange(800)) for _ in range(300)]]
    r = spark.createDataFrame(regions, "page int, region long, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    s = spark.createDataFrame(spans, "page int, text string, x double, x_end double, y0 double, y1 double, size double")
    every = [sorted(tuple(x) for x in areas.with_labels(r, s, local=local).collect()) for local in (10**6, 302, 0)]
    assert every[0] == every[1] == every[2] and len(every[0]) == len(regions)
    assert every[0] != sorted(regions)
