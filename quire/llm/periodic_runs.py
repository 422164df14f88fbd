"""Periodic runs of words, found in the suffix tree of each text.

Words are maximal runs of characters other than space and 0x09 to 0x0D. A run
is a stretch of words with smallest period q (words q apart are equal) of at
least max(``least``, 2 q) words that no neighbouring word extends.

A stretch of two equal halves (a tandem repeat) that the next word does not
carry on is branching: its halves begin in different children of the node of
the suffix tree that spells one half. Every run of period q ends in exactly one
branching tandem repeat of halves of q words. They are found by going through
the leaves of all children of a node but the largest, and looking for a leaf
that stands the node's depth before or behind in the node's whole leaf list. A
leaf is met only as often as its list at least doubles, so n log n times in
all. A repeat is then rotated to the left as far as words stay equal, which
gives the run; several repeats of one run, with multiples of its period, are
merged into the one of the smallest.

The tree is held as arrays for many texts together: suffixes sorted by doubling
prefixes, lengths of common prefixes, and the interval of leaves of each node.
Words of different texts never compare equal, so no text's cost depends on
another. The names that doubling gives to the stretches of 1, 2, 4, ... words
also tell how far a repeat rotates. In a run of at least 12 words some six words
in a row come again one period on; texts without six such words have no run and
need no tree (for a smaller ``least``, half of it).

Memory is about 150 bytes a word and 4 more for each doubling, for a batch of
``WORDS`` words or one text that is longer. A null text has no words, as a blank
one. Rows are independent: repeated rows repeat in the result, an empty table
gives an empty one, and other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash
from quire.llm.frames import map_text, pick

LEAST = 12
#: Words of a batch.
WORDS = 200_000
FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


@dataclass
class Tree:
    """Suffixes of many texts in order, with the names of their stretches."""

    order: np.ndarray  # suffix at each rank
    rank: np.ndarray
    names: list[np.ndarray]  # by level: equal for equal stretches of 2 ** level words
    ends: np.ndarray  # by word: where its text ends
    begins: np.ndarray  # and begins


def named(values: np.ndarray) -> np.ndarray:
    """Numbers in order for values."""
    return np.unique(values, return_inverse=True)[1]


def repeated(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from each place on, inside a text, come twice."""
    names, width = words.astype(np.int64), 1
    n = len(words)
    while width < size:
        step = min(width, size - width)
        ahead = np.full(n, -1, np.int64)
        inside = np.flatnonzero(np.arange(n) + step + width <= ends)
        ahead[inside] = names[inside + step]
        short = ahead < 0
        names = named(names * (n + 1) + ahead + 1)
        names[short] = n + np.flatnonzero(short)  # too near to the end to come again
        names = named(names)
        width += step
    count = np.bincount(names, minlength=n)
    return (count[names] > 1) & (np.arange(n) + size <= ends)


def sorted_suffixes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Tree:
    """Words are numbers that differ between texts; ``begins`` and ``ends`` are those of each word's text."""
    n = len(words)
    rank = named(words)
    names, width = [rank.astype(np.int32)], 1
    place = np.arange(n)
    while True:
        order = np.argsort(rank, kind="stable")
        first = np.append(True, rank[order][1:] != rank[order][:-1])
        size = np.diff(np.append(np.flatnonzero(first), n))
        open_ranks = np.repeat(size > 1, size)
        at = order[open_ranks]  # suffixes not told apart yet
        if not at.size:
            return Tree(order, rank, names, ends, begins)
        ahead = np.zeros(n, np.int64)
        inside = at[place[at] + width < ends[at]]
        ahead[inside] = rank[inside + width] + 1
        keys = rank[at] * np.int64(n + 1) + ahead[at]
        inner = np.argsort(keys, kind="stable")
        keys, at = keys[inner], at[inner]
        fresh = np.append(True, keys[1:] != keys[:-1])
        # a group keeps the rank of its first member in the whole order
        slots = np.flatnonzero(open_ranks)
        after = rank.copy()
        after[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        if width == 1:  # ranks of single words become places too
            starts = np.flatnonzero(first)
            closed = order[~open_ranks]
            after[closed] = starts[np.cumsum(first) - 1][~open_ranks]
        rank = after
        names.append(rank.astype(np.int32))
        width *= 2


def common(tree: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b have in common."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(tree.names) - 1, -1, -1):
        name, width = tree.names[level], 1 << level
        x, y = a + out, b + out
        live = np.flatnonzero((x + width <= tree.ends[a]) & (y + width <= tree.ends[b]))
        same = live[name[x[live]] == name[y[live]]]
        out[same] += width
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the last smaller value before each one, or -1. Pointers are followed by all that are not there yet."""
    at = np.arange(len(values)) - 1
    live = np.arange(len(values))
    while True:
        live = live[at[live] >= 0]
        live = live[values[at[live]] >= values[live]]
        if not live.size:
            return at
        at[live] = at[at[live]]


def branching_repeats(words: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Begin and half of every branching tandem repeat."""
    n = len(words)
    depth = common(tree, tree.order[:-1], tree.order[1:])  # between neighbouring leaves
    low = nearest_smaller(depth)
    high = len(depth) - 1 - nearest_smaller(depth[::-1])[::-1]
    # a node is known by the place before it and its depth; its leaves are low + 1 to high
    inner = np.flatnonzero(depth > 0)
    inner = inner[np.lexsort((inner, depth[inner], low[inner]))]
    if not inner.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.append(True, (low[inner][1:] != low[inner][:-1]) | (depth[inner][1:] != depth[inner][:-1]))
    head = np.flatnonzero(fresh)
    splits = np.diff(np.append(head, len(inner)))
    # children of a node: from its first leaf or behind a split, to the next split or its last leaf
    count = splits + 1
    node = np.repeat(np.arange(len(head)), count)
    first_child = np.cumsum(count) - count
    begin, end = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
    is_first = np.zeros(len(node), bool)
    is_first[first_child] = True
    is_last = np.zeros(len(node), bool)
    is_last[first_child + count - 1] = True
    begin[is_first], begin[~is_first] = low[inner[head]] + 1, inner + 1
    end[is_last], end[~is_last] = high[inner[head]], inner
    size = end - begin + 1
    largest = np.maximum.reduceat(size, first_child)
    # leave out one largest child of each node
    is_largest = np.flatnonzero(size == largest[node])
    skip = is_largest[np.append(True, node[is_largest][1:] != node[is_largest][:-1])]
    small = np.ones(len(node), bool)
    small[skip] = False
    begin, size, node = begin[small], size[small], node[small]
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    node = np.repeat(node, size)
    leaf, half = tree.order[at], depth[inner[head]][node]
    left, right = low[inner[head]][node] + 1, high[inner[head]][node]
    found = []
    for other, start in ((leaf + half, leaf), (leaf - half, leaf - half)):
        inside = np.flatnonzero((other >= tree.begins[leaf]) & (other < tree.ends[leaf]))
        where = tree.rank[other[inside]]
        inside = inside[(where >= left[inside]) & (where <= right[inside])]
        i, d = start[inside], half[inside]
        after = i + 2 * d
        goes_on = (after < tree.ends[i]) & (words[i] == words[np.minimum(after, n - 1)])
        found.append(np.stack([i, d])[:, ~goes_on])
    both = np.concatenate(found, axis=1)
    both = np.unique(both[0] * np.int64(n + 1) + both[1])
    return both // (n + 1), both % (n + 1)


def rotated(tree: Tree, begin: np.ndarray, half: np.ndarray) -> np.ndarray:
    """First word of the run that each repeat belongs to."""
    at = begin.copy()
    for level in range(len(tree.names) - 1, -1, -1):
        name, width = tree.names[level], 1 << level
        live = np.flatnonzero(at - width >= tree.begins[begin])
        live = live[name[at[live] - width] == name[at[live] - width + half[live]]]
        at[live] -= width
    return at


def runs(words: np.ndarray, cuts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and smallest period of all runs, in order. ``cuts`` are where texts begin, and the end; equal numbers are equal words."""
    sizes = np.diff(cuts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    own = named(named(words) + text * np.int64(len(words) + 1))
    ends = cuts[1:][text]
    again = np.bincount(text, repeated(own, ends, max(1, least // 2)), len(sizes)) > 0
    chosen = np.flatnonzero(again[text])
    if not chosen.size:
        return none, none, none
    kept = sizes * again
    moved = np.cumsum(kept) - kept  # where each text begins among the chosen ones
    text = text[chosen]
    own = named(own[chosen])
    tree = sorted_suffixes(own, moved[text], (moved + kept)[text])
    begin, half = branching_repeats(own, tree)
    start = rotated(tree, begin, half)
    length = begin + 2 * half - start
    long = length >= np.maximum(least, 2 * half)
    start, length, half = start[long], length[long], half[long]
    order = np.lexsort((half, length, start))
    start, length, half = start[order], length[order], half[order]
    fresh = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, half = start[fresh], length[fresh], half[fresh]
    order = np.lexsort((half, start))
    return chosen[start[order]], length[order], half[order]


def _work(w: wordhash.Words, texts: range, least: int) -> Iterator[tuple]:
    """A row of ``FIELDS`` for each text."""
    a, b = int(w.cuts[texts.start]), int(w.cuts[texts.stop])
    cuts = w.cuts[texts.start : texts.stop + 1] - a
    start, length, period = runs(numbers(w, a, b), cuts, least)
    n = b - a
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    bounds = np.searchsorted(start, cuts)
    for i in range(len(texts)):
        low, high = int(cuts[i]), int(cuts[i + 1])
        own = slice(int(bounds[i]), int(bounds[i + 1]))
        s, m, p = (start[own] - low).tolist(), length[own].tolist(), period[own].tolist()
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, m, p, strict=True))
        best = min(range(len(s)), key=lambda k: (-m[k], s[k], p[k])) if s else None
        top = (None,) * 4 if best is None else (s[best], m[best], p[best], 1_000 * m[best] // p[best])
        yield high - low, len(s), *top, hashlib.sha256(listed.encode()).hexdigest(), joined(w, a + low + np.flatnonzero(stays[low:high]))


def numbers(w: wordhash.Words, a: int, b: int) -> np.ndarray:
    """Numbers of words a to b, equal for equal bytes.

    Words are grouped by their hashes and compared with the first of the group;
    any that differ, though hashed alike, are numbered by their bytes.
    """
    _, where, number = np.unique(w.hashes[a:b], return_index=True, return_inverse=True)
    begins, ends = w.begins[a:b], w.ends[a:b]
    first = where[number]
    size = ends - begins
    alike = size == size[first]
    alike[alike] = wordhash.same(w.data, begins[alike], size[alike], w.data, begins[first[alike]])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~alike).tolist():
        number[i] = others.setdefault(w.data[begins[i] : ends[i]].tobytes(), len(where) + len(others))
    return number


def joined(w: wordhash.Words, words: np.ndarray) -> str:
    """These words with single spaces between them."""
    if not len(words):
        return ""
    begins, sizes = w.begins[words], w.ends[words] - w.begins[words]
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) - 1, 0x20, np.uint8)
    into = np.repeat(ends - sizes - 1, sizes) + _within(sizes)
    out[into] = w.data[np.repeat(begins, sizes) + _within(sizes)]
    return out.tobytes().decode()


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """id, ``keep`` columns and ``FIELDS`` of every row of ``df``.

    start, length, period and exponent_milli are of the longest run (ties: least
    start, then period), null without runs; runs_sha256 digests ``start,length,
    period`` of all runs, a line each; collapsed is the text without the words
    that a run repeats, with single spaces.
    """

    def make():
        def work(text: pa.Array) -> list:
            w = wordhash.words(text)
            rows, begin = [], 0
            while begin < len(text):
                end = max(begin + 1, int(np.searchsorted(w.cuts, w.cuts[begin] + WORDS, "right")) - 1)
                rows += _work(w, range(begin, end), least)
                begin = end
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    docs = pick(df, {id_col: id_col, **{k: k for k in keep}, "__text": text_col})
    return map_text(docs, "__text", [id_col, *keep], FIELDS, make)


def made_periodic(text: Column, doc_id: Column) -> Column:
    """Texts of one id in ten repeat a stretch of their words to the end, for a known period; others stay as they are.

    With h the checksum of the id in decimal: word i from a = (h div 10) mod n
    on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + (h div 10) mod 8).
    A null id has the checksum of an empty string.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(words)

    def turned(ws: Column) -> Column:
        size = F.size(ws)
        a = (g % size).cast("int")
        p = (F.lit(1) + F.floor((size - a) / (3 + g % 8))).cast("int")
        times = F.ceil((size - a) / p).cast("int")
        return F.concat_ws(" ", F.slice(ws, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(ws, a + 1, p), times)), 1, size - a))

    # as the variable of a function the words are cut once
    return F.when((h % 10 == 0) & (n > 0), F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(text)
