"""Ids of whole texts through a table of pieces met before, in numpy.

Texts are cut into pieces (see ``word_bpe``) as bytes: runs of letters, single
digits, runs of other printable characters. This holds for words of ASCII and
the letters of Latin-1 without an apostrophe or ``<``; any other word is odd
and is cut by the library's own tables. A piece is looked up by a 64-bit hash
of its lower-cased bytes, which are then compared with those of the entry;
pieces that the table lacks are encoded together. A piece whose place another
one of the same hash has taken is looked up by its bytes. Pieces and odd words
of over ``KEEP`` bytes are not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm import wordhash
from quire.llm.word_bpe import WordBpe

#: Entries before the table starts afresh; it takes about 30 MB then. One
#: batch of texts adds fewer than the slots left free for it.
ENTRIES = 400_000
_SLOTS = 1 << 20
KEEP = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

LETTER, DIGIT, OTHER, ODD = 1, 2, 3, 4
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = OTHER
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[0x27, 0x3C]] = ODD  # may begin a contraction or an added token
KIND[wordhash.SEPARATOR] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class PieceTable:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.entry = np.full(_SLOTS, -1, np.int32)
        self.begin = np.zeros(1 << 10, np.int64)
        self.size = np.zeros(1 << 10, np.int32)
        self.ids = np.zeros(1 << 12, np.int32)
        self.count = self.used = self.pooled = 0
        self.pool = np.zeros(1 << 12, np.uint8)  # bytes of the pieces that have a slot
        self.place = np.zeros(_SLOTS >> 1, np.int64)  # by entry, where they begin
        self.width = np.zeros(_SLOTS >> 1, np.int64)  # and how many they are; 0 without a slot
        self.odd: dict[bytes, int] = {}
        self.twins: dict[bytes, int] = {}

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Number of the first of new entries with these ids."""
        first = self.count
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.int32))
        while len(self.begin) < first + len(sizes):
            self.begin = np.append(self.begin, np.zeros(len(self.begin), np.int64))
            self.size = np.append(self.size, np.zeros(len(self.size), np.int32))
        self.ids[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(sizes)
        self.begin[first : first + len(sizes)] = self.used + ends - sizes
        self.size[first : first + len(sizes)] = sizes
        self.count, self.used = first + len(sizes), self.used + len(ids)
        return first

    def _keep(self, first: int, pieces: list[bytes]) -> None:
        """Stores the bytes of new entries from ``first`` on."""
        widths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = self.pooled + np.cumsum(widths)
        while len(self.pool) < ends[-1]:
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint8))
        while len(self.place) < first + len(pieces):
            self.place = np.append(self.place, np.zeros(len(self.place), np.int64))
            self.width = np.append(self.width, np.zeros(len(self.width), np.int64))
        self.pool[self.pooled : ends[-1]] = np.frombuffer(b"".join(pieces), np.uint8)
        self.place[first : first + len(pieces)] = ends - widths
        self.width[first : first + len(pieces)] = widths
        self.pooled = int(ends[-1])

    def _twin(self, piece: bytes) -> int:
        """Entry of a piece whose slot belongs to another one."""
        if piece not in self.twins:
            self.twins[piece] = self._append(*self.bpe.encode_pieces([piece]))
        return self.twins[piece]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = ((hashes * _FACTOR) >> np.uint64(44)).astype(np.int64)
        found = self.entry[slot]
        on = np.flatnonzero((found >= 0) & (self.keys[slot] != hashes))
        while on.size:
            slot[on] = (slot[on] + 1) & (_SLOTS - 1)
            at = slot[on]
            found[on] = self.entry[at]
            on = on[(self.entry[at] >= 0) & (self.keys[at] != hashes[on])]
        return found

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Adds distinct hashes that are not there yet."""
        slot, left = ((hashes * _FACTOR) >> np.uint64(44)).astype(np.int64), np.arange(len(hashes))
        while left.size:
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[left[free]]
            self.keys[slot[free]] = hashes[left[free]]
            lost = self.entry[slot] != entries[left]
            left, slot = left[lost], (slot[lost] + 1) & (_SLOTS - 1)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin; one more than texts."""
        if self.count > ENTRIES or self.used > 8 * ENTRIES:
            self.clear()
        data, offsets = wordhash.bytes_of(text)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(text) + 1, np.int64)
        kind = KIND[data]
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
        kind[second] = kind[second - 1] = LETTER
        inside = kind > 0
        fresh_text = np.zeros(len(data) + 1, bool)
        fresh_text[offsets] = True
        word_start = inside.copy()
        word_start[1:] &= ~inside[:-1] | fresh_text[1:-1]
        odd_at = np.flatnonzero(kind == ODD)
        starts = word_start.copy()
        starts[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        if odd_at.size:  # an odd word stays whole
            words = np.flatnonzero(word_start)
            wrong = np.zeros(len(words), bool)
            wrong[np.searchsorted(words, odd_at, "right") - 1] = True
            last = np.append(words[1:], len(data))
            change = np.zeros(len(data) + 1, np.int8)
            change[words[wrong]] += 1
            change[last[wrong]] -= 1
            starts &= word_start | (np.cumsum(change[:-1]) == 0)
        after = np.append(starts[1:] | ~inside[1:] | fresh_text[1:-1], True)
        begins, ends = np.flatnonzero(starts), np.flatnonzero(inside & after) + 1
        low = LOWER[data]
        capital = second[data[second] <= 0x9E]
        low[capital] += 0x20

        special = ends - begins > KEEP
        if odd_at.size:
            special |= np.isin(begins, words[wrong], assume_unique=True)
        plain = np.flatnonzero(~special)
        hashes, _ = wordhash.hashed(low, begins[plain], ends[plain])
        entry = np.empty(len(begins), np.int64)
        found = self._find(hashes)
        missing = found < 0
        if missing.any():
            new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, at = low.tobytes(), plain[missing][where]
            pieces = [raw[b:e] for b, e in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]
            first = self._append(*self.bpe.encode_pieces(pieces))
            self._keep(first, pieces)
            self._insert(new, np.arange(first, first + len(new), dtype=np.int32))
            found[missing] = first + back
        width = ends[plain] - begins[plain]
        alike = self.width[found] == width
        alike[alike] = wordhash.same(low, begins[plain][alike], width[alike], self.pool[: self.pooled], self.place[found[alike]])
        for i in np.flatnonzero(~alike).tolist():
            found[i] = self._twin(low[begins[plain[i]] : ends[plain[i]]].tobytes())
        entry[plain] = found
        others = np.flatnonzero(special)
        if others.size:
            raw = data.tobytes()
            entry[others] = [self._special(raw[b:e]) for b, e in zip(begins[others].tolist(), ends[others].tolist(), strict=True)]
        sizes = self.size[entry].astype(np.int64)
        total = np.append(0, np.cumsum(sizes))
        out = self.ids[np.repeat(self.begin[entry] - total[:-1], sizes) + np.arange(int(total[-1]))]
        return out, total[np.searchsorted(begins, offsets)]

    def _special(self, word: bytes) -> int:
        if word in self.odd:
            return self.odd[word]
        ids = np.frombuffer(self.bpe.encode_words([word.decode()])[0], "<i4")
        number = self._append(ids, np.array([len(ids)]))
        if len(word) <= KEEP:
            self.odd[word] = number
        return number
