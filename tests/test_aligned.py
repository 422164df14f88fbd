"""Tables without rules, against cases worked out by hand and a plain walk down the page."""

import random
import re

from quire.operators import aligned as A

LINES = "page int, line_id long, y0 double, y1 double, size double, segments array<struct<x:double,x_end:double,text:string>>"
GRIDS = "page int, grid int, x0 double, y0 double, x1 double, y1 double"
MARKER = re.compile(r"(?:[•–*-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxlcdmIVXLCDM]{1,6}[.)])|\(?[0-9A-Za-z]{1,3}[.)]?")


def page(number, rows, top=0.0):
    """Lines 12 apart; each row is a list of (x, x_end, text)."""
    return [(number, i, top + 12.0 * i, top + 12.0 * i + 10, 10.0, row) for i, row in enumerate(rows)]


def found(spark, lines, grids=()):
    """(page, first): (rows, columns) of each table."""
    cells = A.tables(spark.createDataFrame(lines, LINES), spark.createDataFrame(list(grids), GRIDS)).collect()
    return {k: tuple(max(c[n] for c in cells if (c["page"], c["first"]) == k) + 1 for n in ("row", "col")) for k in {(c["page"], c["first"]) for c in cells}}


def row(*texts, shift=0.0):
    return [(100.0 * k + shift, 100.0 * k + shift + 40, t) for k, t in enumerate(texts)]


def test_kinds(spark):
    word = row("some", "words")
    lines = [
        *page(1, [word] * 3),
        *page(2, [word] * 2),
        *page(3, [[(0.0, 20.0, f"{i}."), (100.0, 140.0, "item")] for i in range(4)]),  # a list
        *page(4, [row(f"chapter {i}", str(i)) for i in range(1, 5)]),  # contents
        *page(5, [row(str(i), str(i)) for i in range(1, 5)]),  # figures beside figures
        *page(6, [[(0.0, 120.0, "wide"), (125.0, 140.0, "x")], [(0.0, 40.0, "a"), (110.0, 140.0, "y")], [(0.0, 40.0, "a"), (110.0, 140.0, "y")]]),  # columns overlap
        *page(7, [row("a", "b", shift=40.0), *[word] * 3, row("one")]),  # the table begins a line later
        *page(8, [word, row("one"), word, word, word]),
        *page(9, [[(0.0, 40.0, "a"), (100.0 + 9 * i, 200.0, "right")] for i in range(3)]),  # at their right edges
        *page(10, [row(None, " "), word, word, row(None, "b")]),  # a blank line is none
    ]
    assert found(spark, lines) == {(1, 0): (3, 2), (5, 0): (4, 2), (7, 1): (3, 2), (8, 2): (3, 2), (9, 0): (3, 2), (10, 0): (3, 2)}


def test_claims(spark):
    lines = [line for n in range(1, 6) for line in page(n, [row("some", "words")] * 6)]
    around = lambda n, first, last, grid=1, x=200.0: (n, grid, 0.0, 12.0 * first, x, 12.0 * last + 10)
    grids = [around(1, 0, 2), around(2, 2, 3), around(3, 3, 3), around(4, 0, 1, x=10.0), around(5, 0, 3, 1), around(5, 2, 5, 2)]
    assert found(spark, lines, grids) == {(1, 3): (3, 2), (3, 0): (6, 2), (4, 0): (6, 2)}


def test_places(spark):
    lines = page(1, [[(0.0, 40.0, "a"), (60.0, 90.0, "b")], [(2.0, 30.0, "c"), (70.0, 90.0, "d")], [(0.0, 40.0, "e"), (60.0, 99.0, "f")]])
    cells = A.tables(spark.createDataFrame(lines, LINES), spark.createDataFrame([], GRIDS)).orderBy("row", "col").collect()
    assert [(c.x0, c.y0, c.x1, c.y1, c.text) for c in cells] == [
        (0, 0, 50, 11, "a"), (50, 0, 99, 11, "b"), (0, 11, 50, 23, "c"), (50, 11, 99, 23, "d"), (0, 23, 50, 34, "e"), (50, 23, 99, 34, "f"),
    ]


def test_empty(spark):
    none = spark.createDataFrame([], LINES)
    assert A.tables(none, spark.createDataFrame([], GRIDS)).count() == 0
    assert A.tables(spark.createDataFrame([(1, 1, 0.0, 1.0, 9.0, []), (1, 2, 0.0, 1.0, 9.0, None)], LINES), spark.createDataFrame([], GRIDS)).count() == 0


def plain(lines):
    """The walk down a page, line by line: number of the first line to number of lines."""
    out, i = {}, 0
    near = lambda a, b, e: all(abs(p[0] - q[0]) <= e or abs(p[1] - q[1]) <= e for p, q in zip(a, b, strict=True))
    number = lambda t: re.fullmatch(r"[0-9]{1,4}|[ivxlcdm]{1,9}", t) is not None
    while i < len(lines):
        _, _, _, _, size, head = lines[i]
        j = i + 1
        while len(head) > 1 and j < len(lines) and len(lines[j][5]) == len(head) and lines[j][2] - lines[j - 1][3] < max(size * 2.6, 14) and near(lines[j][5], head, max(5, size * 0.9)):
            j += 1
        run = [x[5] for x in lines[i:j]]
        listed = len(head) == 2 and head[0][1] - head[0][0] <= size * 3 and all(MARKER.fullmatch(r[0][2]) for r in run)
        contents = any(all(number(r[k][2]) and r[k - 1][2] and not number(r[k - 1][2]) for r in run) for k in range(1, len(head)))
        overlap = any(min(r[k][0] for r in run) <= max(r[k - 1][1] for r in run) for k in range(1, len(head)))
        if j - i >= 3 and not listed and not contents and not overlap:
            out[i] = j - i
            i = j
        else:
            i += 1
    return out


def test_against_a_walk(spark):
    rng = random.Random(11)
    lines, want = [], {}
    for p in range(120):
        y, rows, kind = 0.0, [], 0
        for i in range(rng.randint(0, 40)):
            kind = rng.randrange(5) if rng.random() < 0.2 else kind
            n = 1 if rng.random() < 0.05 else 2 + kind % 2
            y += rng.choice([12, 12, 12, 20, 30, 38])
            texts = [rng.choice(["1.", "a)", "xi", "word"] if kind == 2 else ["some", "7", "iv", "more words"] if kind < 4 else ["title"]) if k == 0 else rng.choice(["12", "iv"] if kind == 4 else ["12", "data", "data"]) for k in range(n)]
            rows.append((p, i, y, y + 10, rng.choice([8.0, 10.0, 12.0]), [(60.0 * k + rng.choice([0, 0, 4, 8, 12]), 60.0 * k + rng.choice([20, 40, 40, 40, 62 if rng.random() < 0.1 else 40]), t) for k, t in enumerate(texts)]))
        lines += rows
        want |= {(p, i): (n, len(rows[i][5])) for i, n in plain(rows).items()}
    assert len(want) > 40
    assert found(spark, lines) == want
