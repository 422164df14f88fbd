"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as lower-case letters and digits with single spaces between
words. One rule holds for items of all lengths: an item is cut into pieces of
``PIECE`` characters, the last of them at its end, so close together that each
passage of the item of ``PASSAGE`` characters holds a whole piece; an item no
longer than that is one piece. A text holds an item if it holds a piece of it.
A piece of m characters may be matched with at most m * edits / 100 edits, but
with none if it has fewer than ``EXACT`` characters; such a short one must
stand there as whole words. Spread over an item, that many edits leave some
piece within its budget.

By the q-gram lemma a match with k edits keeps at least m + 1 - q (k + 1)
q-grams of the piece, and as an edit shifts what follows by one at most, they
lie on k + 1 neighbouring diagonals. So

1. places of a document whose q-gram occurs in the benchmark are marked, and
   stretches with too few marks for any piece are left out;
2. for the rest, hits are counted by piece in overlapping diagonal bands, and
   bands that reach the piece's bound are retained;
3. the region of each is verified by alignment within the band of diagonals.

The benchmark comes in blocks of bounded size, each broadcast by itself and
compared with all documents; one block holds a benchmark of a few thousand
items. Of several blocks, each is done, and its result written to the shared
folder, before the next is broadcast. No document is shuffled or compared with
another.

Null, empty and blank texts have no match, on either side, nor have texts
without letters and digits; short items are searched for however common their
words are, unless ``min_chars`` says otherwise. Texts may be of any length that
a row can hold. Repeated rows and items each match on their own; among equally
good places of a piece none is preferred, as only its least edits are told. Rows
without an id match too, with a null id. An empty table, on either side, gives
no match. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import dropped, map_arrow, numbered, pick, position, slices, stored, strings
from quire.llm.wordhash import mixed

Q = 10
#: Edits for each hundred characters.
EDITS = 6
#: Characters of the least passage of an item that counts, and of the pieces that find it.
PASSAGE = 80
PIECE = 60
#: Characters from which on a piece may have edits.
EXACT = 20
#: Characters of benchmark text in a block; it takes some 40 bytes for each in a worker.
BLOCK_CHARS = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


@functools.cache
def _shown() -> np.ndarray:
    """Which code points of the basic plane are letters or digits."""
    return np.array([chr(c).isalnum() for c in range(0x10000)])


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with one space after it, and where each begins; one more than texts."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    shown = _shown()[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if far.size:
        shown[far] = [chr(c).isalnum() for c in code[far].tolist()]
    code[~shown] = 32
    # a space stays after a letter or digit, and so does one at the end of each text
    keep = shown.copy()
    keep[1:] |= ~shown[1:] & shown[:-1]
    keep[ends - 1] = True
    cut = np.append(0, np.cumsum(keep))
    return code[keep], np.append(0, cut[ends])


def qgrams(code: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = code.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = out * _FACTOR + wide[i : i + n]
    return mixed(out)


@dataclass
class Block:
    """Pieces of some items and their q-grams; equal pieces are looked for once."""

    items: np.ndarray  # row of the item of each piece
    short: dict[int, dict[bytes, list[int]]]  # pieces that must match exactly, by length and code points
    copies: list[list[int]]  # pieces with each text
    texts: list[np.ndarray]  # code points of each distinct piece
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray  # q-grams that a match keeps at least
    grams: np.ndarray  # sorted distinct q-grams
    begin: np.ndarray
    owner: np.ndarray  # piece and place of each occurrence, by q-gram
    place: np.ndarray
    marked: np.ndarray  # bit for the leading bits of every q-gram


def block(texts: list[str], q: int = Q, edits: int = EDITS, min_chars: int = 1) -> Block | None:
    code, cut = normalized(texts)
    pieces, items = [], []
    for i in range(len(texts)):
        own = code[cut[i] : cut[i + 1]]
        while len(own) and own[-1] == 32:
            own = own[:-1]
        if len(own) < max(min_chars, 1):
            continue
        # PIECE + stride - 1 is at most PASSAGE
        size = min(PIECE, len(own))
        cuts = [*range(0, len(own) - size, PASSAGE - PIECE + 1), len(own) - size]
        pieces += [own[a : a + size] for a in cuts]
        items += [i] * len(cuts)
    if not pieces:
        return None
    short: dict[int, dict[bytes, list[int]]] = {}
    same: dict[bytes, list[int]] = {}
    for n, s in enumerate(pieces):
        (same if len(s) >= max(EXACT, q) else short.setdefault(len(s), {})).setdefault(s.tobytes(), []).append(n)
    copies = list(same.values())
    pieces = [pieces[c[0]] for c in copies]
    sizes = np.array([len(s) for s in pieces], np.int64)
    budgets = np.minimum(sizes * edits // 100, (sizes - q) // q)
    grams = [qgrams(s, q) for s in pieces]
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes - q + 1)
    place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])
    order = np.argsort(flat, kind="stable")
    distinct, begin = np.unique(flat[order], return_index=True)
    marked = np.zeros(1 << _FILTER_BITS, bool)
    marked[(distinct >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Block(np.array(items), short, copies, pieces, sizes, budgets, sizes + 1 - q * (budgets + 1), distinct, np.append(begin, len(flat)), owner[order], place[order], marked)


def _whole_words(b: Block, code: np.ndarray, cut: np.ndarray) -> list[tuple[int, int, int]]:
    """Text, piece and no edits for each text that holds a short piece as whole words."""
    found = set()
    opens = np.flatnonzero(np.append(True, code[:-1] == 32)[: len(code)])
    for size, pieces in b.short.items():
        at = opens[opens + size < len(code)]
        at = at[code[at + size] == 32]
        wanted = qgrams(np.frombuffer(b"".join(pieces), np.uint32), size)[::size]
        for p in at[np.isin(qgrams(code, size)[at], wanted)].tolist() if at.size else ():
            text = int(np.searchsorted(cut, p, "right")) - 1
            if p + size < cut[text + 1]:
                found |= {(text, n, 0) for n in pieces.get(code[p : p + size].tobytes(), ())}
    return sorted(found)


def _aligned(texts: list[np.ndarray], regions: list[np.ndarray], shifts: np.ndarray, budget: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Least edits of each text against any stretch of its region, on diagonals within ``half`` of ``shifts``.

    Column c of the band stands for region place i + shift - half + c at text
    place i; all pairs take each step together. More than the budget is budget + 1.
    """
    n, width, longest = len(texts), int(2 * half.max() + 1), max(map(len, texts))
    pad = width + longest + 2
    text = np.full((n, longest), 0xFFFFFFF0, np.uint32)
    room = np.full((n, longest + 2 * pad), 0xFFFFFFFF, np.uint32)
    size = np.array([len(t) for t in texts])
    for k, (t, r) in enumerate(zip(texts, regions, strict=True)):
        text[k, : len(t)] = t
        a = pad - int(shifts[k]) + int(half[k])  # region place p stands at column a + p
        lo, hi = max(0, -a), min(len(r), room.shape[1] - a)
        if hi > lo:
            room[k, a + lo : a + hi] = r[lo:hi]
    columns = np.arange(width)
    row = np.zeros((n, width), np.int32)  # a match may begin anywhere
    big = np.int32(1 << 20)
    row[columns[None, :] > 2 * half[:, None]] = big
    done = np.full(n, big)
    for i in range(longest):
        window = room[:, pad + i : pad + i + width]
        change = row + (window != text[:, i : i + 1])
        skip = np.full_like(row, big)
        skip[:, :-1] = row[:, 1:] + 1  # a character of the text is missing in the region
        now = np.minimum(change, skip)
        now[columns[None, :] > 2 * half[:, None]] = big
        # a character of the region too many: along the row
        now = np.minimum.accumulate(now - columns, axis=1) + columns
        row = now.astype(np.int32)
        end = size == i + 1
        if end.any():
            done[end] = row[end].min(axis=1)
    return np.minimum(done, budget + 1)


def matches(b: Block, texts: list[str], q: int = Q) -> list[tuple[int, int, int]]:
    """Text, piece and edits of every match, the best for each text and piece."""
    code, cut = normalized(texts)
    return _whole_words(b, code, cut) + _near(b, code, cut, q)


def _near(b: Block, code: np.ndarray, cut: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Matches of the pieces that may have edits."""
    grams = qgrams(code, q)
    if not len(grams) or not b.texts:
        return []
    maybe = np.flatnonzero(b.marked[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    at = np.searchsorted(b.grams, grams[maybe])
    sure = (at < len(b.grams)) & (b.grams[np.minimum(at, len(b.grams) - 1)] == grams[maybe])
    hit, gram = maybe[sure], at[sure]
    if not hit.size:
        return []
    # stretches in which the least demanding piece could be
    reach, least = int((b.sizes + b.budgets).max()), int(b.bounds.min())
    ahead = np.searchsorted(hit, hit + reach, "left") - np.arange(len(hit))
    dense = np.zeros(len(hit) + 1, np.int64)
    opens = np.flatnonzero(ahead >= least)
    np.add.at(dense, opens, 1)
    np.add.at(dense, opens + ahead[opens], -1)
    live = np.cumsum(dense[:-1]) > 0
    hit, gram = hit[live], gram[live]
    if not hit.size:
        return []
    counts = b.begin[gram + 1] - b.begin[gram]
    occurrence = np.repeat(b.begin[gram] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    where = np.repeat(hit, counts)
    segment, place = b.owner[occurrence].astype(np.int64), b.place[occurrence]
    # overlapping bands: of twice the width, one beginning at every width of diagonals
    width = b.budgets[segment] + 1
    diagonal = where - place + int(b.sizes.max())
    band = diagonal // width
    size = int(len(code)) + 2 * int(b.sizes.max()) + 2
    keys = np.concatenate([segment * size + band, segment * size + band - 1])
    places = np.concatenate([where, where])
    # a band counts only distinct places of the document
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    first = np.append(True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1]))
    found, n = np.unique(keys[first], return_counts=True)
    segment, band = found // size, found % size
    good = n >= b.bounds[segment]
    segment, band = segment[good], band[good]
    if not len(segment):
        return []
    width = b.budgets[segment] + 1
    low = band * width - int(b.sizes.max())  # diagonals low to low + 2 width - 1
    center = low + width
    text = np.searchsorted(cut, np.clip(center + b.sizes[segment] // 2, 0, len(code) - 1), "right") - 1
    begin = np.maximum(cut[text], low - width)
    end = np.minimum(cut[text + 1], low + 3 * width + b.sizes[segment])
    best: dict[tuple[int, int], int] = {}
    for a in range(0, len(segment), 4096):
        part = slice(a, a + 4096)
        regions = [code[x:y] for x, y in zip(begin[part].tolist(), end[part].tolist(), strict=True)]
        edits = _aligned([b.texts[s] for s in segment[part]], regions, center[part] - begin[part], b.budgets[segment[part]], 2 * width[part])
        for t, s, e, k in zip(text[part].tolist(), segment[part].tolist(), edits.tolist(), b.budgets[segment[part]].tolist(), strict=True):
            if e <= k and e <= best.get((t, s), k):
                best[t, s] = e
    return [(t, n, e) for (t, s), e in best.items() for n in b.copies[s]]


def _blocks(items: DataFrame, chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of the benchmark, about ``chars`` characters at a time."""
    ids, texts, total = [], [], 0
    for row in items.where("text is not null").orderBy("item", "text").toLocalIterator():
        ids.append(row.item)
        texts.append(row.text)
        total += len(row.text)
        if total >= chars:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, min_chars: int = 1) -> DataFrame:
    """id, item_id, segments (pieces of the item), matched (of them) and edits for every row of ``df`` and item that it holds."""
    docs = pick(df, {"id": id_col, "text": text_col})
    out, shared = [], None
    for ids, texts in _blocks(pick(benchmark, {"item": item_col, "text": item_text_col}), block_chars):
        made = block(texts, min_chars=min_chars)
        if made is None:
            continue
        if shared is not None:
            out[-1] = stored(out[-1], "leaks")
            shared.destroy()
        shared = df.sparkSession.sparkContext.broadcast((made, ids, np.bincount(made.items, minlength=len(ids)).tolist()))

        def run(batches, shared=shared):
            made, ids, segments = shared.value
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    one = batch.column(0).slice(a, b - a).to_pylist()
                    sums: dict[tuple[int, int], list[int]] = {}
                    for t, s, e in matches(made, strings(batch.column(1).slice(a, b - a))):
                        both = sums.setdefault((t, int(made.items[s])), [0, 0])
                        both[0] += 1
                        both[1] += e
                    rows = [(one[t], ids[i], segments[i], n, e) for (t, i), (n, e) in sums.items()]
                    columns = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "segments", "matched", "edits"])

        out.append(map_arrow(docs, run, "id long, item long, segments long, matched long, edits long"))
    none = docs.sparkSession.createDataFrame([], "id long, item long, segments long, matched long, edits long")
    found = functools.reduce(DataFrame.unionByName, out) if out else none
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "segments", "matched", "edits")


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, min_chars: int = 1) -> DataFrame:
    """Rows of ``df`` that hold no benchmark item, with all their columns. A null text holds none."""
    names = df.columns
    at = position(names, text_col)
    out, shared, before = numbered(df), None, []
    for _, texts in _blocks(pick(benchmark, {"item": item_col, "text": item_text_col}), block_chars):
        made = block(texts, min_chars=min_chars)
        if made is None:
            continue
        if shared is not None:
            out = stored(out, "clean")
            shared.destroy()
            dropped(df.sparkSession, *before)
            before = [out]
        shared = df.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared):
            for batch in batches:
                for a, b in slices(batch.column(at)):
                    part = batch.slice(a, b - a)
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, _, _ in matches(shared.value, strings(part.column(at)))]] = False
                    yield part.filter(pa.array(keep))

        out = map_arrow(out, run, out.schema)
    return out.toDF(*names)
