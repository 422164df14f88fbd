"""Hashes of words and of word runs, over whole Arrow batches of texts.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. A word has
two 64-bit hashes that do not depend on each other: of a word of up to
``SHORT`` bytes, eight bytes at a time, each mixed into what came before; of a
longer one, the halves of a cryptographic digest. All work is on UTF-8 bytes in
numpy; memory beyond the results is bounded by the bytes of the batch.

Hashes find what may be equal. Where equality decides (a link, a removal), the
words themselves are compared.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of the longest word that is hashed in numpy.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    hashes: np.ndarray  # uint64, all texts one after another
    others: np.ndarray  # second hash of each word
    cuts: np.ndarray  # where each text's words begin; one more than texts
    begins: np.ndarray  # places in ``data``
    ends: np.ndarray
    data: np.ndarray  # UTF-8 bytes of all texts

    def of(self, text: int) -> slice:
        return slice(int(self.cuts[text]), int(self.cuts[text + 1]))


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null as empty."""
    text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) else "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(text) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(text) else np.zeros(1, np.int64))


def words(text: pa.Array, lower: bool = False) -> Words:
    """Words of every text; with ``lower`` A to Z count as a to z, and stand so in ``data``."""
    data, offsets = bytes_of(text)
    if lower:
        data = LOWER[data]
    inside = ~SEPARATOR[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = np.unique(offsets[1:-1])
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(*hashed(data, begins, ends), np.searchsorted(begins, offsets), begins, ends, data)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as integers; zeros follow the last byte."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))


def hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span of ``data``."""
    size = ends - begins
    first, second = size.astype(np.uint64) * _A, mixed(size.astype(np.uint64) + _B)
    eight = _eights(data)
    live, step = np.flatnonzero(size <= SHORT), 0
    while live.size:
        left = size[live] - step
        part = eight[begins[live] + step] & _MASKS[np.minimum(left, 8)]
        first[live] = mixed(first[live] ^ part)
        second[live] = mixed(second[live] * _A + (part ^ (part >> np.uint64(29))) * _B)
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        found = hashlib.blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=16).digest()
        first[i], second[i] = np.frombuffer(found, np.uint64)
    return first, second


def same(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of the span of ``other`` of the same size at ``places``."""
    left, right = _eights(data), _eights(other)
    equal = np.ones(len(begins), bool)
    live, step = np.flatnonzero(sizes > 0), 0
    while live.size:
        rest = sizes[live] - step
        differs = ((left[begins[live] + step] ^ right[places[live] + step]) & _MASKS[np.minimum(rest, 8)]) != 0
        equal[live[differs]] = False
        step += 8
        live = live[(rest > 8) & ~differs]
    return equal


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values; doubled up from halves."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    made, have, power, width = None, 0, hashes, 1
    left = size
    while True:
        if left & 1:
            made, have = (power, width) if made is None else (mixed(made[: len(hashes) - have - width + 1] * _A + power[have : have + len(hashes) - have - width + 1]), have + width)
        left >>= 1
        if not left:
            return made[:n]
        power = mixed(power[: len(power) - width] * _A + power[width:])
        width *= 2


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])
