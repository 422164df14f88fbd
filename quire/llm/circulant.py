"""Circulant MinHash signatures of word-shingle sets.

Two permutations make all coordinates of a signature: the first scatters a
shingle over a circular universe, the second ranks its places. Coordinate k is
the least rank of a set's places after a circular shift by k. As the ranks of
one place under all shifts stand next to each other in a table, a set costs
one row of it for each shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm import wordhash

#: Places of the circular universe.
UNIVERSE_BITS = 21
COORDINATES = 128
#: Coordinates of a band. Sets that share 0.8 of their union agree on one of
#: 32 bands but for one case in ten million.
ROWS = 4
_SEED = 20_231
_SCATTER = np.uint64(0x9FB21C651E98DF25)

_ranks: list[np.ndarray] = []


def shifted_ranks() -> np.ndarray:
    """Row p: ranks of the place p under shifts 0 to COORDINATES - 1."""
    if not _ranks:
        ranks = np.random.default_rng(_SEED).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _ranks.append(np.lib.stride_tricks.sliding_window_view(np.append(ranks, ranks[: COORDINATES - 1]), COORDINATES))
    return _ranks[0]


def places(shingles: np.ndarray) -> np.ndarray:
    """First permutation: an odd factor and a fold, which lose nothing, then the circle's place."""
    x = (shingles ^ (shingles >> np.uint64(31))) * _SCATTER
    return (x >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    ranks, at = shifted_ranks(), places(shingles)
    out = ranks[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        np.minimum(out, ranks[at[i : i + 2048]].min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is mixed in."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    out = np.arange(1, parts.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019)
    for r in range(ROWS):
        out = wordhash.mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def sets(w: wordhash.Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a short text is one shingle, one without words none."""
    whole = wordhash.runs(w.hashes, size)
    out = []
    for a, b in zip(w.cuts[:-1].tolist(), w.cuts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(wordhash.mixed(wordhash.runs(w.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str, size: int) -> set[bytes]:
    """The shingles of one text as words with spaces between them."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def set_sizes(w: wordhash.Words, found: list[np.ndarray], size: int, texts) -> list[int]:
    """Number of distinct shingles of every text, given its ``sets``.

    The second hashes of the words are put to the same count; where the two
    differ, which takes a collision, the shingles themselves are counted.
    """
    whole = wordhash.runs(w.others, size)
    out = []
    for i, s in enumerate(found):
        a, b = w.of(i).start, w.of(i).stop
        if b - a > len(s) + size - 1 and len(np.unique(whole[a : b - size + 1])) != len(s):
            out.append(len(shingles(texts[i].as_py(), size)))
        else:
            out.append(len(s))
    return out
