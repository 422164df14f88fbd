"""Static range asymmetric numeral system over token ids, and its file format.

A file holds the ids of whole documents. One frequency table serves all its
blocks. Each block of ``BLOCK`` ids is coded by itself in ``LANES`` interleaved
states, so any block can be decoded alone: the file's index has a checkpoint
for each (where its words begin) and a checksum of its ids. numpy codes all
blocks of a file in step, one id of each lane at a time.

Layout, little-endian: magic, counts, ids with frequencies, documents (their
ids and numbers of tokens), checkpoints and checksums of the blocks, final
states, 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"QRNS0001"
LANES = 8
ROUNDS = 512
BLOCK = LANES * ROUNDS
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
_HEAD = struct.Struct("<8sBQQQQQ")


class Damaged(ValueError):
    """A file that does not decode to the ids it was made from."""


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive integers in proportion to ``counts`` that add up to ``2 ** scale``."""
    total = 1 << scale
    exact = counts * (total / counts.sum())
    out = np.maximum(1, np.floor(exact)).astype(np.int64)
    left = total - int(out.sum())
    if left > 0:
        gain = np.argsort(out - exact, kind="stable")
        out[gain[: left % len(out)]] += 1
        out += left // len(out)
    while left < 0:
        room = np.flatnonzero(out > 1)
        best = room[np.argsort(exact[room] - out[room], kind="stable")][:-left]
        out[best] -= 1
        left += len(best)
    return out


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the place of each id among them, and how often each occurs."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    table = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[table] = np.arange(len(table))
    return table, place[ids], counts[table]


def compress(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A file of the documents ``doc_ids`` with ``sizes`` tokens each; ids are below 2 ** 32."""
    n = len(ids)
    table, index, counts = _counted(ids)
    scale = max(16, int(2 * len(table)).bit_length())
    freq = frequencies(counts, scale) if n else counts
    blocks = -(-n // BLOCK)
    common = int(counts.argmax()) if n else 0
    filled = np.full(blocks * BLOCK, common, np.int64)
    filled[:n] = index
    steps = filled.reshape(blocks, ROUNDS, LANES)
    f64, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    ceiling = (LOW >> np.uint64(scale) << WORD) * f64
    words = np.zeros((blocks, BLOCK + LANES), np.uint32)
    head = np.full(blocks, BLOCK + LANES, np.int64)
    state = np.full((blocks, LANES), LOW, np.uint64)
    for r in range(ROUNDS - 1, -1, -1):
        s = steps[:, r]
        f = f64[s]
        full = state >= ceiling[s]
        if full.any():
            row, lane = np.nonzero(full)
            each = full.sum(axis=1)
            head -= each
            place = head[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            words[row, place] = state[row, lane].astype(np.uint32)
            state[row, lane] >>= WORD
        q = state // f
        state = (q << np.uint64(scale)) + (state - q * f) + start[s]
    lengths = BLOCK + LANES - head
    body = np.concatenate([words[b, head[b] :] for b in range(blocks)]) if blocks else np.zeros(0, np.uint32)
    data = ids.astype("<u4")
    checks = [zlib.crc32(data[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)]
    return b"".join([
        _HEAD.pack(MAGIC, scale, n, len(doc_ids), len(table), blocks, len(body)),
        table.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
        np.asarray(doc_ids, "<i8").tobytes(), np.asarray(sizes, "<u8").tobytes(),
        (np.cumsum(lengths) - lengths).astype("<u8").tobytes(), np.array(checks, "<u4").tobytes(),
        state.astype("<u8").tobytes(), body.astype("<u4").tobytes(),
    ])


@dataclass
class File:
    scale: int
    n: int
    table: np.ndarray
    freq: np.ndarray
    doc_ids: np.ndarray
    sizes: np.ndarray
    checkpoints: np.ndarray
    checks: np.ndarray
    states: np.ndarray
    words: np.ndarray


def parse(content: bytes) -> File:
    if len(content) < _HEAD.size or content[:8] != MAGIC:
        raise Damaged("no file of this format begins here")
    _, scale, n, docs, symbols, blocks, words = _HEAD.unpack_from(content)
    at, parts = _HEAD.size, []
    for kind, count in (("<u4", symbols), ("<u4", symbols), ("<i8", docs), ("<u8", docs), ("<u8", blocks), ("<u4", blocks), ("<u8", blocks * LANES), ("<u4", words)):
        size = np.dtype(kind).itemsize * count
        if at + size > len(content):
            raise Damaged("the file is cut short")
        parts.append(np.frombuffer(content, kind, count, at))
        at += size
    return File(scale, n, *parts)


def decode_blocks(file: File, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``end``, each from its checkpoint, checked against its checksum."""
    end = len(file.checks) if end is None else end
    blocks = end - first
    if blocks <= 0:
        return np.zeros(0, np.uint32)
    freq = file.freq.astype(np.uint64)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(len(freq)), file.freq)
    if len(slots) != 1 << file.scale:
        raise Damaged("the frequencies do not add up")
    mask, scale = np.uint64((1 << file.scale) - 1), np.uint64(file.scale)
    head = file.checkpoints[first:end].astype(np.int64)
    words = np.append(file.words, np.zeros(BLOCK, np.uint32)).astype(np.uint64)
    state = file.states.reshape(-1, LANES)[first:end].astype(np.uint64)
    out = np.zeros((blocks, ROUNDS, LANES), np.uint32)
    for r in range(ROUNDS):
        low = state & mask
        s = slots[low.astype(np.int64)]
        out[:, r] = file.table[s]
        state = freq[s] * (state >> scale) + low - start[s]
        short = state < LOW
        if short.any():
            row, lane = np.nonzero(short)
            each = short.sum(axis=1)
            place = head[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            state[row, lane] = state[row, lane] << WORD | words[np.minimum(place, len(words) - 1)]
            head += each
    flat = out.reshape(-1)[: file.n - first * BLOCK]
    data = flat.astype("<u4")
    for b in range(blocks):
        if zlib.crc32(data[b * BLOCK : (b + 1) * BLOCK].tobytes()) != file.checks[first + b]:
            raise Damaged(f"block {first + b} does not match its checksum")
    return flat
