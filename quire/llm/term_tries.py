"""Counts of terms by language and source in byte tries, and how sources differ.

Terms are runs of letters: bytes A to Z, a to z and everything beyond ASCII,
with A to Z lower-cased. Each task puts the terms of its texts into a radix trie
over their UTF-8 bytes. A leaf has counters for each language and source:
occurrences, and documents with the term. Counters of all leaves lie in sorted
arrays, so equal ones are added up in numpy. A trie of more than ``TERMS`` terms
or ``COUNTERS`` counters is written out in byte order and a new one begun, so a
task's memory does not grow with its input; tries are mergeable. They are merged
by prefix range: written leaves are dealt to tasks by ranges of (language, term)
and counters added up there. Ranges are chosen from the leaves that there are,
so a common first letter is several ranges. A trie has one leaf for a language
and term, so no term is hot.

The merged leaves are traversed twice. For pairs of sources a task goes through
its terms a block at a time and adds up differences for all sources of a
language; the sources that it has at hand are bounded by ``SOURCES``. For terms,
each task keeps the best of each group (ties in UTF-8 order), and those are
merged.

Shares are fixed-point integers: with ``n`` occurrences of a term among ``N`` of
all V kept terms, 1 + floor(10**9 * (n + 5) / (N + 5 * V)). All arithmetic is in
integers.

Null texts, languages and sources count as empty strings; an empty one is a
language or source like any other. A group of documents without terms takes
part with counts of 0. Repeated rows count each. A text may have any length; a
term may too, though one kept needs ``least`` documents. An empty table gives an
empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.frames import map_arrow, pick, slices, spread_join, stored

#: Terms and counters of a task's trie before it is written out, some 60 and 50 MB.
TERMS = 300_000
COUNTERS = 2_000_000
#: Sources that the traversal for pairs has at hand at once.
SOURCES = 1_024
#: Shares at hand at once in the traversal for pairs.
CELLS = 1 << 20
SCALE, SMOOTH = 10**9, 5
#: Letters to themselves in lower case, other ASCII to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


class Trie:
    """A radix trie over bytes; every leaf has a number. A node is [label, children by first byte, number or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]

    def add(self, term: bytes, number: int) -> None:
        node, at, size = self.root, 0, len(term)
        while at < size:
            children = node[1]
            child = children.get(term[at])
            if child is None:
                children[term[at]] = [term[at:], {}, number]
                return
            label = child[0]
            if term.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = 1
            while at + k < size and label[k] == term[at + k]:
                k += 1
            fork = children[term[at]] = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            node, at = fork, at + k
        node[2] = number

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and their numbers in byte order."""
        waiting = [(b"", self.root)]
        while waiting:
            prefix, (label, children, number) = waiting.pop()
            term = prefix + label
            if number is not None:
                yield term, number
            waiting += [(term, children[b]) for b in sorted(children, reverse=True)]


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Counts:
    """How often each of many keys (integers) was met, as sorted arrays."""

    def __init__(self):
        self.keys, self.ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(np.unique(keys, return_counts=True))
        self.waiting += len(self.pending[-1][0])
        if self.waiting > max(len(self.keys), 1 << 18):
            self.settle()

    def settle(self) -> None:
        keys, ns = (np.concatenate(x) for x in zip((self.keys, self.ns), *self.pending, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, ns = keys[order], ns[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.ns = keys[first], np.add.reduceat(ns, first) if len(first) else ns
        self.pending, self.waiting = [], 0


class Tally:
    """The trie of one task, and its counters of occurrences and documents by group and term."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.occurrences, self.documents = Counts(), Counts()

    def count(self, langs: list[str], sources: list[str], texts: list[str]) -> None:
        found = list(map(terms_of, texts))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        terms = np.fromiter(map(self.terms.__getitem__, itertools.chain.from_iterable(found)), np.int64, total)
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)), np.int64, len(found))
        for lang in langs:
            self.langs.setdefault(lang, len(self.langs))
        text = np.repeat(np.arange(len(found)), sizes)
        self.occurrences.add((group[text] << 40) + terms)
        once = np.unique((text << 40) + terms)
        self.documents.add((group[once >> 40] << 40) + (once & ((1 << 40) - 1)))

    def full(self) -> bool:
        return len(self.terms) > TERMS or len(self.occurrences.keys) > COUNTERS

    def leaves(self) -> Iterator[pa.RecordBatch]:
        """Leaves by language, in byte order of their terms; before them the groups, as leaves of no term."""
        self.occurrences.settle()
        self.documents.settle()
        trie = Trie()
        for term, number in self.terms.items():
            trie.add(term, number)
        walked = list(trie.walk())
        names = pa.array([t for t, _ in walked], pa.binary()).cast(pa.string())
        place = np.zeros(len(walked), np.int64)
        place[np.fromiter((n for _, n in walked), np.int64, len(walked))] = np.arange(len(walked))
        pairs = list(self.groups)
        sources = pa.array([s for _, s in pairs], pa.string())
        lang_of = np.array([self.langs[lang] for lang, _ in pairs], np.int64)
        mask = (1 << 40) - 1
        group, at = self.occurrences.keys >> 40, place[self.occurrences.keys & mask]
        by = (lang_of[group] << 40) + at if len(group) else group
        order = np.lexsort((group, by))
        by, group, ns, docs = by[order], group[order], self.occurrences.ns[order], self.documents.ns[order]
        begins = np.flatnonzero(np.append(True, by[1:] != by[:-1])[: len(by)])
        leaf = by[begins]
        own = pa.array(list(self.langs), pa.string())
        if pairs:
            nothing = np.zeros(len(pairs), np.int64)
            yield _leaves(own.take(pa.array(lang_of)), pa.array([""] * len(pairs)), np.arange(len(pairs) + 1), sources, nothing, nothing)
        for a in range(0, len(leaf), 1 << 16):
            b = min(len(leaf), a + (1 << 16))
            low, high = int(begins[a]), int(begins[b]) if b < len(leaf) else len(by)
            yield _leaves(own.take(pa.array(leaf[a:b] >> 40)), names.take(pa.array(leaf[a:b] & mask)), np.append(begins[a:b], high) - low, sources.take(pa.array(group[low:high])), ns[low:high], docs[low:high])


def _leaves(lang: pa.Array, term: pa.Array, cuts: np.ndarray, sources: pa.Array, ns: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    cells = pa.StructArray.from_arrays([sources, pa.array(ns, pa.int64()), pa.array(docs, pa.int64())], ["source", "n", "docs"])
    return pa.RecordBatch.from_arrays([lang, term, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), cells)], names=["lang", "term", "cells"])


def counted(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, term and cells (source, n, docs): leaves of all tries, on shared files. Leaves of the empty term tell the groups that there are."""
    docs = pick(df, {"lang": lang_col, "source": source_col, "text": text_col}).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        tally = Tally()
        for batch in batches:
            for a, b in slices(batch.column(2)):
                tally.count(*[batch.column(i).slice(a, b - a).to_pylist() for i in range(3)])
                if tally.full():
                    yield from tally.leaves()
                    tally = Tally()
        yield from tally.leaves()

    return stored(map_arrow(docs, run, "lang string, term string, cells array<struct<source string, n long, docs long>>"), "leaves")


def kept_terms(leaves: DataFrame, least: int) -> DataFrame:
    """lang, term, n and sources (source, n) of the terms in at least ``least`` documents of their language, on shared files.

    Both groupings find their rows together already, as terms are dealt by range.
    """
    cells = leaves.where("term <> ''").repartitionByRange("lang", "term").select("lang", "term", F.explode("cells").alias("c"))
    merged = cells.groupBy("lang", "term", "c.source").agg(F.sum("c.n").alias("n"), F.sum("c.docs").alias("docs"))
    whole = merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return stored(whole.where(F.col("docs") >= least).select("lang", "term", "n", "sources"), "kept-terms")


def _share(n, total, terms):
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), as exact decimals."""
    top = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(20,0)")) + F.lit(1).cast("long")


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same of integers below 9 * 10**15, by long division three digits at a time."""
    n, total = np.broadcast_arrays(n + SMOOTH, total + SMOOTH * terms)
    digits, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1_000
        digits, rest = digits * 1_000 + rest // total, rest % total
    return digits + 1


def _pairs(leaves: DataFrame, groups: list[tuple[str, str, int]], terms: dict[str, int], apart: int | None) -> DataFrame:
    """lang, a, b, value: sums of differences between sources of one language, for each task.

    ``groups`` has (lang, source, total). Of the sources of a language those
    before place ``apart`` are paired with those from it on; with None all are
    paired with one another.
    """
    own: dict[str, list[tuple[str, int]]] = {}
    for lang, source, total in groups:
        own.setdefault(lang, []).append((source, total))
    places = {lang: {s: i for i, (s, _) in enumerate(ss)} for lang, ss in own.items()}
    totals = {lang: np.array([t for _, t in ss], np.int64) for lang, ss in own.items()}
    shared = leaves.sparkSession.sparkContext.broadcast((places, totals, terms))

    def run(batches):
        places, totals, terms = shared.value
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            which, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            lists = batch.column(1)
            begins = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            sources, ns = flat.field(0).dictionary_encode(), flat.field(1).to_numpy()
            for k, lang in enumerate(names):
                if lang not in places:
                    continue
                place = np.array([places[lang].get(s, -1) for s in sources.dictionary.to_pylist()], np.int64)
                total = totals[lang]
                size = len(total)
                first = size if apart is None else apart
                acc = sums.setdefault(lang, np.zeros((first, size), np.int64))
                rows = np.flatnonzero(which == k)
                step = max(1, CELLS // size)
                for begin in range(0, len(rows), step):
                    part = rows[begin : begin + step]
                    counts = np.zeros((len(part), size), np.int64)
                    lengths = begins[part + 1] - begins[part]
                    at = np.repeat(begins[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
                    where = place[sources.indices.to_numpy()[at]]
                    there = where >= 0
                    counts[np.repeat(np.arange(len(part)), lengths)[there], where[there]] = ns[at[there]]
                    p = shares(counts, total, terms[lang])
                    for s in range(first):
                        acc[s] += np.abs(p - p[:, s : s + 1]).sum(axis=0)
        for lang, acc in sums.items():
            names = list(places[lang])
            a, b = np.indices(acc.shape).reshape(2, -1)
            wanted = a < b if apart is None else b >= apart
            a, b = a[wanted], b[wanted]
            names = np.array(names, object)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(acc[a, b], pa.int64())], names=["lang", "a", "b", "value"])

    return map_arrow(leaves, run, "lang string, a string, b string, value long")


def divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 30, best: int = 50, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank: how each (language, source) differs from the others and from its language.

    Each language keeps the terms in at least ``least`` of its documents. Part
    ``pair`` has the other sources of the language by the sum of differences of
    shares over its kept terms; part ``term`` the ``best`` terms that the source
    has more of than the language, by that difference.
    """
    leaves = counted(df, lang_col, source_col, text_col)
    kept = kept_terms(leaves, least)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole"))
    inside = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("total"), F.count("*").alias("own"))
    present = leaves.where("term = ''").select("lang", F.explode("cells").alias("c")).select("lang", "c.source").distinct()
    groups = present.join(inside, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "own", "terms", "whole")]), "groups")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _all_pairs(kept.select("lang", "sources"), groups, sources).withColumn("rank", F.row_number().over(order))
    cells = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("sources").alias("s")).select("lang", "term", "n_lang", "s.source", "s.n").where("n > 0")
    cells = spread_join(cells, groups, ["lang", "source"], "own", F.col("term"), groups.agg(F.sum("own")).first()[0] or 0)
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("n_lang"), F.col("whole"), F.col("terms"))
    ahead = cells.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    top = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    out = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").union(out(top, "term"))


def _all_pairs(listed: DataFrame, groups: DataFrame, sources: int) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways.

    Sources are numbered in blocks within their language. One pass over the
    terms takes the whole of several languages, or two blocks of one, so that
    it never has more than ``sources`` of them at hand.
    """
    half = max(1, sources // 2)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = stored(groups.where("terms > 0").withColumn("block", F.floor(number / half).cast("int")), "blocks")
    sizes: dict[str, dict[int, int]] = {}
    for r in numbered.groupBy("lang", "block").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.lang, {})[r.block] = r.n

    def taken(blocks: list[tuple[str, int]]) -> tuple[list[tuple[str, str, int]], dict[str, int]]:
        wanted = F.lit(False)
        for lang, block in blocks:
            wanted = wanted | ((F.col("lang") == lang) & (F.col("block") == block))
        found = sorted(numbered.where(wanted).collect(), key=lambda r: (r.lang, r.block, r.source))
        return [(r.lang, r.source, r.total) for r in found], {r.lang: r.terms for r in found}

    sums, some, held = [], [], 0
    for lang, own in sorted(sizes.items()):
        if len(own) > 1:
            of_lang = listed.where(F.col("lang") == lang)
            sums += [_pairs(of_lang, *taken([(lang, i)]), None) for i in own]
            sums += [_pairs(of_lang, *taken([(lang, i), (lang, j)]), own[i]) for i in own for j in own if i < j]
            continue
        if some and held + own[0] > sources:
            sums.append(_pairs(listed, *taken(some), None))
            some, held = [], 0
        some.append((lang, 0))
        held += own[0]
    if some:
        sums.append(_pairs(listed, *taken(some), None))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p")
    # languages that keep no term: nothing differs
    bare = groups.where("terms = 0").select("lang", "source")
    out = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    if sums:
        added = stored(functools.reduce(DataFrame.union, sums), "pair-sums").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        out = out.union(added.select("lang", both, "value").select("lang", "p.source", "p.item", "value"))
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The same over ``documents``.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_LETTERS.upper()}', '{_LETTERS}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
cells AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS whole, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source) c USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (g.whole + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
