"""Divergence of sources against brute force; tries and shares by themselves."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import frames, term_tries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, best=50):
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        whole = Counter(t for d in own for t in d[2])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    words = [*"the of and a to in The OF".split(), "élan", "Élan", "日本", "日本語", "ſ", "x_y", "don't", "ß9z", "ab", "abc", "abd", "b" * 300, "😀"]
    rows = []
    for i in range(n):
        source = rng.choice(sources) if i % 3 else sources[0]
        k = min(len(words), 3 + len(source or "") + i % 5)
        rows.append((rng.choice(["en", "de", None, ""]), source, " ".join(rng.choice(words[:k] + words[-2:]) for _ in range(rng.randint(0, 30)))))
    return rows + [("xx", "a", "1 2 3"), ("xx", None, None), ("xx", "b", ""), ("yy", None, None)]


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize(("sources", "counters", "least", "cells"), [(1_024, 200_000, 5, 1 << 20), (4, 20, 5, 16), (2, 1, 1, 4), (6, 100, 20, 1)])
def test_divergence(spark, monkeypatch, sources, counters, least, cells):
    monkeypatch.setattr(term_tries, "COUNTERS", counters)
    monkeypatch.setattr(frames, "SLICE_BYTES", 500)
    monkeypatch.setattr(term_tries, "CELLS", cells)
    rows = corpus(220, ["s0", "s1", "s2", "source three", None, "", "é", "Z"], 5)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert rows_of(term_tries.divergence(docs, least=least, best=7, sources=sources)) == brute(rows, least, 7)


def test_awkward_tables(spark):
    schema = "lang string, source string, text string, TEXT int, term int, n int, docs string"
    rows = [("en", "a", "Long " * 100_000, 1, 1, 1, "x"), ("en", "b", "long", 1, 1, 1, "x"), ("en", "b", "long", 1, 1, 1, "x"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert rows_of(term_tries.divergence(docs, least=2)) == brute([r[:3] for r in rows], 2)
    assert term_tries.divergence(docs.where("n > 5")).collect() == []


def test_trie_walks_in_byte_order():
    rng, trie, want = random.Random(1), term_tries.Trie(), {}
    for n in range(5_000):
        term = "".join(rng.choice("abé日😀") for _ in range(rng.randint(0, 6))).encode()
        trie.add(term, n)
        want[term] = n
    assert list(trie.walk()) == sorted(want.items())


def test_tallies_are_mergeable():
    """Leaves of several tries add up to those of one."""
    rows = [(a or "", b or "", c or "") for a, b, c in corpus(200, ["s0", "s1", "é"], 8)]

    def leaves(*parts):
        found = {}
        for part in parts:
            tally = term_tries.Tally()
            for begin in range(0, len(part), 7):
                tally.count(*map(list, zip(*part[begin : begin + 7], strict=True)))
            listed = [r for batch in tally.leaves() for r in batch.to_pylist()]
            terms = [(list(tally.langs).index(r["lang"]), r["term"].encode()) for r in listed if r["term"]]
            assert terms == sorted(set(terms))
            for r in listed:
                docs, cells = found.setdefault((r["lang"], r["term"]), (Counter(), Counter()))
                docs.update({c["source"]: c["docs"] for c in r["cells"]})
                cells.update({c["source"]: c["n"] for c in r["cells"]})
        return found

    assert leaves(rows) == leaves(rows[:50], rows[50:51], rows[51:])


def test_terms():
    rng = random.Random(2)
    alphabet = [*"aZz@[`{ \x00\x7f\x80\x85\xa0é日😀\n0-", " ", "AB"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(30))
        assert [t.decode() for t in term_tries.terms_of(text)] == TERM.findall(lowered(text))


def test_shares_are_exact():
    ns = np.array([0, 1, 7, 10**6, 10**12, 8 * 10**15], np.int64)
    totals = np.array([10**7, 10**13, 8 * 10**15], np.int64)
    for (n, total), terms in itertools.product(itertools.product(ns.tolist(), totals.tolist()), (1, 10**6)):
        if n <= total:
            assert term_tries.shares(np.array([n]), np.array([total]), terms).tolist() == [1 + 10**9 * (n + 5) // (total + 5 * terms)]
