"""Removal of long passages that earlier documents hold, by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window
over it also starts in a document with a smaller id, judged on the input.

Reference blocks. Every window has an anchor: the least hash of the runs of
half its length inside it. Equal windows have equal anchors, so the stretches of
text whose windows have one anchor make a block that is complete for them, and
only anchors of several documents need one. A block is the words of its
stretches in order of document ids, with an index: chains from the hash of a
window to its positions.

Parsing. In each block every stretch is factored greedily. Where a window is
found in the block, compared word by word, the copy is carried on for as long as
the words agree, within one stretch of the reference: a factor (position in the
block, place in the stretch, words). A factor of n words covers n - WINDOW + 1
windows; the first window beyond them, which lies over the factor's end, is
looked up anew, so no window across a boundary is missed. Windows that no factor
covers are added to the index once the document is done, each at its first
position; where another occurrence would carry a copy further, that shows as a
factor of its own. Factors of neighbouring anchors meet or overlap, and their
union is what goes.

Documents of the same words form a class. Only the one with the smallest id is
parsed; the others, if a window long, go whole. The same holds of stretches. An
anchor whose stretches have more than ``BLOCK_WORDS`` words would make a block
that is too large, so its stretches are first cut back to windows that two
documents may have, as two hashes of each window say, and equal ones are merged,
word for word, under the smallest id; the others are factors as a whole. What is
left is parsed in a block as above. Where even that is more than ``BLOCK_WORDS``,
stretches of one window each are merged in the same way, and leave nothing to
parse. Hashes say what may be left out; words are compared before any is removed.

Null, empty and blank texts have 0 words and stay empty. A text may be of any
length that a row can hold. A row without an id keeps all its words and is no
reference for others. Rows of one id are not references for each other, so
repeated rows lose nothing to each other. An empty table gives an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash
from quire.llm.frames import dropped, map_arrow, map_text, only, pick, slices, spread_join, stored, strings

WINDOW = 50
#: Words of the largest block, at some 200 bytes each with their place in the index.
BLOCK_WORDS = 200_000
#: Windows that are sent on at once, with their words.
SENT_WINDOWS = 2_000


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Anchor of every window of the words ``hashes``."""
    half = window // 2
    return wordhash.lowest(wordhash.runs(hashes, half), window - half + 1)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def changes(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal ``values`` begins, and their number."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


def profiles(docs: DataFrame, window: int) -> DataFrame:
    """id, n_words, d1, d2 (digest of the words) and distinct anchors, with the words of their stretches, of every row of ``docs`` (id, text)."""

    def make():
        def work(text: pa.Array) -> list:
            w = wordhash.words(text)
            found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i in range(len(text)):
                made = anchors(w.hashes[w.of(i)], window)
                edge = changes(made) if len(made) else np.zeros(1, np.int64)
                known, at = np.unique(made[edge[:-1]], return_inverse=True)
                found.append(known)
                sizes.append(np.bincount(at, np.diff(edge) + window - 1, len(known)).astype(np.int64))
            pairs = pa.StructArray.from_arrays([np.concatenate(found).view(np.int64), np.concatenate(sizes)], ["anchor", "size"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in found]), pa.int32()), pairs)
            names = halves([digest(t.encode().split()) for t in strings(text)])
            return [np.diff(w.cuts), names[:, 0], names[:, 1], lists]

        return work

    return map_text(docs, "text", ["id"], "n_words long, d1 long, d2 long, anchors array<struct<anchor: long, size: long>>", make)


def marked(batch: pa.RecordBatch, window: int) -> Iterator[tuple]:
    """Id, words, digest, two hashes of each window, anchors and whether each is in the list, of rows (id, text, anchors) that have a window."""
    w = wordhash.words(batch.column(1))
    for i, (one, text, listed) in enumerate(zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2), strict=True)):
        own = w.hashes[w.of(i)]
        if len(own) >= window:
            words, anchor = text.encode().split(), anchors(own, window)
            known = listed.values.to_numpy(zero_copy_only=False).view(np.uint64)
            yield one, words, halves([digest(words)])[0].tolist(), (own, w.others[w.of(i)]), anchor, np.isin(anchor, known)


STRETCH = "id long, d1 long, d2 long, first long, anchor long, n long, words binary"
_STRETCH = {"id": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "first": pa.int64(), "anchor": pa.int64(), "n": pa.int64(), "words": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_STRETCH)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STRETCH.values(), strict=True)], names=list(_STRETCH))


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """Stretches of ``docs`` (id, text, shared: anchors) whose windows have one anchor of the list: id, d1, d2, first (word), anchor, n (words) and words, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows: list[tuple] = []
                for one, words, (d1, d2), _, anchor, inside in marked(batch.slice(a, b - a), window):
                    edge, keys = changes(anchor).tolist(), anchor.view(np.int64)
                    for first, last in zip(edge, edge[1:], strict=False):
                        if inside[first]:
                            end = last + window - 1
                            rows.append((one, d1, d2, first, int(keys[first]), end - first, b" ".join(words[first:end])))
                yield _batch(rows)

    return map_arrow(docs.select("id", "text", "shared"), run, STRETCH)


def windows(docs: DataFrame, window: int) -> DataFrame:
    """Windows of ``docs`` (id, text, shared: anchors) with an anchor of the list: id, d1, d2, start, anchor and two hashes of the words, w1 and w2."""
    names = ["id", "d1", "d2", "start", "anchor", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                for one, _, (d1, d2), hashes, anchor, inside in marked(batch.slice(a, b - a), window):
                    at = np.flatnonzero(inside)
                    w1, w2 = (wordhash.runs(h, window)[at].view(np.int64) for h in hashes)
                    same = [np.full(len(at), x, np.int64) for x in (one, d1, d2)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, at.astype(np.int64), anchor[at].view(np.int64), w1, w2)], names=names)

    return map_arrow(docs.select("id", "text", "shared"), run, ", ".join(f"{n} long" for n in names))


def trimmed(docs: DataFrame, window: int) -> DataFrame:
    """Longest stretches, as of ``stretches``, of ``docs`` (id, text, places: d1, d2, start, anchor) whose windows are all among the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for one, text, places in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2), strict=True):
                words = text.encode().split()
                d1, d2 = halves([digest(words)])[0].tolist()
                d1s, d2s, starts, keys = (places.values.field(k).to_numpy(zero_copy_only=False) for k in ("d1", "d2", "start", "anchor"))
                mine = (d1s == d1) & (d2s == d2)
                starts, at = np.unique(starts[mine], return_index=True)
                if not len(starts):
                    continue
                keys = keys[mine][at]
                edge = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (np.diff(keys) != 0)))
                for first, last in zip(edge.tolist(), [*(edge[1:] - 1).tolist(), len(starts) - 1], strict=True):
                    begin, end = int(starts[first]), int(starts[last]) + window
                    rows.append((one, d1, d2, begin, int(keys[first]), end - begin, b" ".join(words[begin:end])))
            yield _batch(rows)

    return map_arrow(docs.select("id", "text", "places"), run, STRETCH)


def single(rows: DataFrame, window: int) -> DataFrame:
    """Stretches of one window each for every window of the stretches ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for one, d1, d2, first, anchor, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = raw.split()
                for k in range(n - window + 1):
                    out.append((one, d1, d2, first + k, anchor, window, b" ".join(words[k : k + window])))
                    if len(out) == SENT_WINDOWS:
                        yield _batch(out)
                        out = []
        yield _batch(out)

    return map_arrow(rows.select(*_STRETCH), run, STRETCH)


def merged(rows: DataFrame) -> DataFrame:
    """Stretches ``rows``, which are stored, with least: the smallest id that has the same words under the same anchor.

    Copies are counted map-side. The keys that ``spread_join`` broadcasts have
    no more bytes than 4,096 average rows, as each stands in one of 4,096 rows.
    """
    equal = rows.groupBy("anchor", "words").agg(F.min("id").alias("least"), F.count("*").alias("c"))
    return spread_join(rows, equal, ["anchor", "words"], "c", F.xxhash64("id", "first"), rows.count()).select(*_STRETCH, "least")


class ReferenceBlock:
    """Words of one anchor's stretches met so far, and the positions of their windows."""

    def __init__(self, window: int):
        self.window = window
        self.words: list[bytes | None] = []
        self.chains: dict[int, list[int]] = {}
        self.waiting: list[tuple[list[bytes], list[int], list[int]]] = []  # of the document being parsed
        self.document: int | None = None

    def find(self, key: int, words: list[bytes]) -> int | None:
        """Position of a window of the block, of the hash ``key``, with the words given."""
        for place in self.chains.get(key, ()):
            if self.words[place : place + self.window] == words:
                return place
        return None

    def add(self, words: list[bytes], keys: list[int], new: list[int]) -> None:
        """Puts a stretch at the end of the block and its windows at the places ``new`` into the index."""
        base = len(self.words)
        self.words += [*words, None]  # no copy runs over the end of a stretch
        for at in new:
            if self.find(keys[at], words[at : at + self.window]) is None:
                self.chains.setdefault(keys[at], []).append(base + at)

    def factors(self, document: int, words: list[bytes], keys: list[int]) -> list[tuple[int, int, int]]:
        """Position in the block, place in the stretch and number of words of each factor.

        Documents come in ascending order; one is added when the next begins,
        so all that the block holds is of earlier ones.
        """
        if document != self.document:
            for stretch in self.waiting:
                self.add(*stretch)
            self.document, self.waiting = document, []
        out, new, at = [], [], 0
        while at < len(keys):
            place = self.find(keys[at], words[at : at + self.window])
            if place is None:
                new.append(at)
                at += 1
                continue
            n = self.window
            while at + n < len(words) and self.words[place + n] == words[at + n]:
                n += 1
            out.append((place, at, n))
            at += n - self.window + 1
        if new:
            self.waiting.append((words, keys, new))
        return out


SPANS = "id long, d1 long, d2 long, start long, stop long"


def factored(rows: DataFrame, window: int) -> DataFrame:
    """id, d1, d2, start, stop: words covered by factors of the ``stretches`` of each anchor."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("anchor", "id", "d1", "d2", "first", "words").repartition(n, "anchor").sortWithinPartitions("anchor", "id", "d1", "d2", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, ReferenceBlock(window)
        for batch in batches:
            found: list[tuple] = []
            w = wordhash.words(batch.column(5))
            for i, (anchor, one, d1, d2, first, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if anchor != key:
                    key, block = anchor, ReferenceBlock(window)
                keys = wordhash.runs(w.hashes[w.of(i)], window).tolist()
                found += [(one, d1, d2, first + at, first + at + n) for _, at, n in block.factors(one, raw.split(), keys)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "d1", "d2", "start", "stop"])

    return map_arrow(dealt, run, SPANS)


def busy(docs: DataFrame, window: int, block_words: int) -> DataFrame:
    """id, d1, d2, start, stop: words covered by factors of ``docs`` (id, text, shared: anchors whose blocks would be too large)."""
    each = stored(windows(docs, window), "windows")
    twice = each.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("c")).where("least < most").select("w1", "w2", "c")
    kept = spread_join(each, twice, ["w1", "w2"], "c", F.xxhash64("id", "start"), each.count()).where("c is not null")
    places = stored(kept.groupBy("id").agg(F.collect_list(F.struct("d1", "d2", "start", "anchor")).alias("places")), "places")
    cut = stored(trimmed(only(docs.select("id", "text"), places.select("id")).join(places.hint("shuffle_hash"), "id"), window), "cut")
    rows = stored(merged(cut), "merged")
    dropped(docs.sparkSession, each, places, cut)
    whole, first = rows.where("id > least"), rows.where("id = least").drop("least")
    sizes = first.groupBy("anchor").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    first = spread_join(first, sizes, ["anchor"], "c", F.xxhash64("id", "first"), rows.count())
    found = factored(first.where(F.col("size") <= block_words), window)
    if sizes.where(F.col("size") > block_words).limit(1).count():
        whole = whole.unionByName(merged(stored(single(first.where(F.col("size") > block_words), window), "single")).where("id > least"))
    return found.union(whole.select("id", "d1", "d2", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop")))


def spans(docs: DataFrame, window: int, block_words: int) -> DataFrame:
    """id, spans (d1, d2, start, stop) for each document of ``docs`` (id, text) that loses words; stop -1 for all words."""
    rows = stored(profiles(docs, window), "profiles").where(F.col("id").isNotNull() & (F.col("n_words") >= window))
    classes = rows.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    several = classes.where("c > 1")
    copies = spread_join(rows.select("id", "d1", "d2"), several, ["d1", "d2"], "c", F.col("id"), rows.count()).where("id > rep").select("id", "d1", "d2", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop")).distinct()
    # the key holds the id, so copies of one text do not meet
    own = rows.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"], "left_semi").dropDuplicates(["d1", "d2", "id"])
    keyed = own.select("id", F.explode("anchors").alias("a")).select("id", "a.anchor", "a.size")
    shared = keyed.groupBy("anchor").agg(F.count("*").alias("c"), F.sum("size").alias("total")).where("c > 1")
    found = spread_join(keyed.drop("size"), shared, ["anchor"], "c", F.col("id"), 10 * rows.count()).where("c > 1")
    large = F.col("total") > block_words
    lists = stored(found.groupBy("id").agg(F.collect_list(F.when(~large, F.col("anchor"))).alias("shared"), F.collect_list(F.when(large, F.col("anchor"))).alias("busy")), "shared")
    made = factored(stretches(only(docs, lists.select("id")).join(lists.select("id", "shared").hint("shuffle_hash"), "id"), window), window)
    crowded = lists.where("size(busy) > 0").select("id", F.col("busy").alias("shared"))
    if crowded.limit(1).count():
        made = made.union(busy(only(docs, crowded.select("id")).join(crowded.hint("shuffle_hash"), "id"), window, block_words))
    return made.union(copies).groupBy("id").agg(F.collect_list(F.struct("d1", "d2", "start", "stop")).alias("spans"))


def drop_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_words, n_removed, removed (spans of words) and kept (words left, joined by spaces) of every row of ``df``."""
    docs = pick(df, {"id": id_col, "text": text_col})
    joined = docs.join(stored(spans(docs, window, block_words), "spans").hint("shuffle_hash"), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                piece = batch.slice(a, b - a)
                total, gone, removed, kept = [], [], [], []
                for text, found in zip(strings(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    words = text.encode().split()
                    total.append(len(words))
                    ranges: list[tuple[int, int]] = []
                    if found:
                        d1, d2 = halves([digest(words)])[0].tolist()
                        for s in sorted((f["start"], len(words) if f["stop"] < 0 else f["stop"]) for f in found if f["d1"] == d1 and f["d2"] == d2):
                            if ranges and s[0] <= ranges[-1][1]:
                                ranges[-1] = ranges[-1][0], max(ranges[-1][1], s[1])
                            else:
                                ranges.append(s)
                    gone.append(sum(e - s for s, e in ranges))
                    for s, e in reversed(ranges):
                        del words[s:e]
                    removed.append([{"start": s, "stop": e} for s, e in ranges])
                    kept.append(b" ".join(words).decode())
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "removed", "kept"])

    return map_arrow(joined.select("id", "text", "spans"), run, "id long, n_words long, n_removed long, removed array<struct<start: long, stop: long>>, kept string").withColumnRenamed("id", id_col)
