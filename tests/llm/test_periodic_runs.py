"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import periodic_runs, queries, wordhash
from quire.llm.frames import pick

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """(start, length, period) of all runs, by comparing words at every distance."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def expected(text, least=12):
    words = WORD.findall(text or "")
    found = brute(words, least)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    return (len(words), len(found), *(top or (None,) * 3), 1_000 * top[1] // top[2] if top else None, digest, " ".join(w for i, w in enumerate(words) if i not in gone))


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "a", "a " * 12, "a " * 11, "x " + "a b " * 6 + "c", "a b c d e f " * 2, "a b c d e f a b c d e", "fib"]
    a, b = "a", "a b"
    for _ in range(8):
        a, b = b, f"{b} {a}"
    out.append(b)
    for _ in range(n):
        k = rng.choice([1, 2, 3, 8, 50])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz" if k > 5 else "ab") + str(rng.randrange(k)) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6 and words:
            i, p = rng.randrange(len(words)), rng.randint(1, 20)
            words[i:i] = (words[i : i + p] * rng.randint(2, 6))[: rng.randint(2, 80)]
        out.append(rng.choice([" ", "\n", "\t  "]).join(words))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 12), (2, 12), (3, 4), (4, 2), (5, 1), (6, 7)])
def test_runs(seed, least):
    made = texts(150, seed)
    w = wordhash.words(pa.array(made))
    assert list(periodic_runs._work(w, range(len(made)), least)) == [expected(t, least) for t in made]


def test_all_short_texts_of_two_words():
    made = [" ".join(f"{n:b}".zfill(15)) for n in range(1 << 15)][::7]
    w = wordhash.words(pa.array(made))
    assert list(periodic_runs._work(w, range(len(made)), 4)) == [expected(t, 4) for t in made]


def test_long_texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(5_000)}" for _ in range(3_000)]
    made = [" ".join(base * 7 + base[:500]), "a " * 30_000, " ".join(base[:100] + ["x", "y"] * 10_000 + base[100:200])]
    w = wordhash.words(pa.array(made))
    rows = list(periodic_runs._work(w, range(3), 12))
    assert [r[:6] for r in rows] == [(21_500, 1, 0, 21_500, 3_000, 7_166), (30_000, 1, 0, 30_000, 1, 30_000_000), (20_200, 1, 100, 20_000, 2, 10_000_000)]
    assert [len(r[7].split()) for r in rows] == [3_000, 1, 202]


def test_words_of_one_hash_differ(monkeypatch):
    made = texts(40, 9)
    plain = wordhash.hashed
    monkeypatch.setattr(wordhash, "hashed", lambda *a: tuple(x % np.uint64(3) for x in plain(*a)))
    w = wordhash.words(pa.array(made))
    assert list(periodic_runs._work(w, range(len(made)), 12)) == [expected(t) for t in made]


def made_periodic(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        _, n, *top, digest, collapsed = expected(made_periodic(r.doc_id, r.text))
        want.append((r.doc_id, n, *top, digest, hashlib.sha256(collapsed.encode()).hexdigest()))
    got = queries.queries()["op13_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] for r in want) > 10


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS", 100)
    schema = "doc_id long, text string, TEXT int, start long, collapsed string, `n.runs` int"
    rows = [(i, t, 1, 2, "c", 3) for i, t in enumerate([None, *texts(60, 12), "é 日本 " * 20, "word " * 20_000, "l" * 100_000 + " "])]
    rows += [rows[5], rows[5], (None, "a " * 20, None, None, None, None), (None,) * 6]
    docs = spark.createDataFrame(rows, schema)
    got = periodic_runs.periodic_runs(docs, keep=("TEXT",))
    assert sorted(((r[0], *r[2:]) for r in got.collect()), key=repr) == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)
    assert periodic_runs.periodic_runs(docs.where("doc_id < -1")).collect() == []
    turned = pick(docs, {"doc_id": "doc_id", "text": "text"}).select("doc_id", periodic_runs.made_periodic(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert sorted(map(tuple, turned), key=repr) == sorted(((r[0], made_periodic(r[0], r[1])) for r in rows), key=repr)
