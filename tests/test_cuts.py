"""Trees of cuts against a plain recursion."""

import random
import statistics

from quire.operators import cuts

SCHEMA = "page int, line_id long, x0 double, y0 double, x1 double, y1 double, baseline double"


def plain(rows, path="0", depth=0):
    """Rows are (line_id, x0, y0, x1, y1, baseline)."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    leaf = [(path, "leaf", r[0]) for r in rows]
    if len(rows) < 2 or depth > 5:
        return leaf
    leads = [d for a, b in zip(rows, rows[1:], strict=False) if (d := b[5] - a[5]) > 0]
    least = max((statistics.median_high(leads) if leads else 0) * 1.9, 9)
    at, best, bottom = 0, 0, rows[0][4]
    for i in range(1, len(rows)):
        gap = rows[i][2] - bottom
        if gap > least and gap > best:
            at, best = i, gap
        bottom = max(bottom, rows[i][4])
    groups, kind = [rows[:at], rows[at:]], "across"
    if not at:
        groups, kind = columns(rows), "down"
        if not groups:
            return leaf
    return [(path, kind, -1), *(x for n, g in enumerate(groups) for x in plain(g, f"{path}.{n}", depth + 1))]


def columns(rows):
    left, right = min(r[1] for r in rows), max(r[3] for r in rows)
    side, reach, middles = max(40, (right - left) * 0.12), None, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if reach is not None and r[1] - reach >= 16 and reach - left >= side and right - r[1] >= side:
            middles.append((reach + r[1]) / 2)
        reach = r[3] if reach is None else max(reach, r[3])
    groups = [[r for r in rows if sum(m < (r[1] + r[3]) / 2 for m in middles) == n] for n in range(len(middles) + 1)]
    return groups if middles and len(rows) >= 4 and right - left >= 120 and all(len(g) > 1 for g in groups) else []


def pages():
    rng, out = random.Random(4), {}
    for page in range(60):
        rows, y, n = [], 0.0, 0
        for _ in range(rng.randint(1, 5)):
            y += rng.choice([0, 12, 30, 60])
            tops = []
            for c in range(rng.randint(1, 3)):
                top = y
                for _ in range(rng.randint(1, 6)):
                    width = rng.choice([60, 100, 110, 110])
                    rows.append((n, 130.0 * c + rng.choice([0, 0, 5]), top, 130.0 * c + width, top + 10, top + 8))
                    n, top = n + 1, top + rng.choice([12, 12, 12, 14, 36])
                tops.append(top)
            y = max(tops)
        rng.shuffle(rows)
        out[page] = rows
    out[60] = [(i, 0.0, 100.0 * i + (i * i), 50.0, 100.0 * i + i * i + 10, 100.0 * i + i * i + 8) for i in range(12)]
    return out


def test_cuts(spark):
    made = pages()
    df = spark.createDataFrame([(p, *r) for p, rows in made.items() for r in rows], SCHEMA).repartition(3)
    got = sorted((r.page, r.path, r.kind, r.line_id) for r in cuts.parts(df).collect())
    want = sorted((p, *x) for p, rows in made.items() for x in plain(rows))
    assert got == want
    assert {k for _, _, k, _ in want} == {"across", "down", "leaf"} and max(path.count(".") for _, path, _, _ in want) == 6


def test_two_columns_under_a_heading(spark):
    lines = [(1, 0, 0.0, 0.0, 400.0, 10.0, 8.0)]
    lines += [(1, 1 + 2 * i + k, 220.0 * k, 60.0 + 12 * i, 220.0 * k + 180, 70.0 + 12 * i, 68.0 + 12 * i) for i in range(4) for k in (0, 1)]
    leaves = {r.line_id: r.path for r in cuts.parts(spark.createDataFrame(lines, SCHEMA)).collect() if r.kind == "leaf"}
    assert leaves[0] == "0.0" and {leaves[i] for i in (1, 3, 5, 7)} == {"0.1.0"} and {leaves[i] for i in (2, 4, 6, 8)} == {"0.1.1"}
    assert cuts.parts(spark.createDataFrame([], SCHEMA)).collect() == []
