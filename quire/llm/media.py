"""Media columns: payloads stored as baseline JPEG, and features of stored images.

``store`` puts bytes into a JPEG column without loss; ``features`` reads such a
column, or one of any baseline JPEG images, back: dimensions, the payload if the
image carries one, a luminance thumbnail made of the DC coefficients, and a hash
of the thumbnail. An image without a payload has null payload columns. Files
that are not baseline images give null columns and the reason in ``error``; a
null file gives nulls throughout.

A null text is stored like an empty one, as one block of zeros; a text may be of
any length that a row can hold. Equal texts, and repeated rows, give equal files
and features, so there are no ties. Rows are independent of each other; an empty
table gives an empty one, and other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import jpeg
from quire.llm.frames import map_text, pick, strings

FEATURES = "width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes of the text, and media: the text, padded to whole units, as JPEG."""

    def make():
        def work(text: pa.Array) -> list:
            content = [t.encode() for t in strings(text)]
            return [[len(c) for c in content], jpeg.pack([jpeg.padded(c) for c in content])]

        return work

    return map_text(pick(df, {id_col: id_col, "__text": text_col}), "__text", [id_col], "n_bytes long, media binary", make)


def _read(files: list[bytes]) -> list:
    """What ``jpeg.unpack`` gives for each file, or the error of a file."""
    try:
        return jpeg.unpack(files)
    except (jpeg.Damaged, KeyError, IndexError, ValueError):
        out = []
        for f in files:
            try:
                out += jpeg.unpack([f])
            except (jpeg.Damaged, KeyError, IndexError, ValueError) as e:
                out.append(e)
        return out


def features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes"), pixels: bool = True) -> DataFrame:
    """``keep`` columns and the features of every file; with ``pixels`` the payload and thumbnail too."""
    fields = FEATURES + (", payload binary, thumbnail binary" if pixels else "") + ", error string"

    def make():
        def work(column: pa.Array) -> list:
            files = column.to_pylist()
            there = [i for i, f in enumerate(files) if f is not None]
            read = dict(zip(there, _read([files[i] for i in there]), strict=True))
            rows = []
            for i, f in enumerate(files):
                got = read.get(i)
                if got is None or isinstance(got, Exception):
                    rows.append((None,) * (8 + 2 * pixels) + (None if got is None else f"{type(got).__name__}: {got}",))
                    continue
                image, payload, small = got
                name = f"{image.width}x{image.height}:{jpeg.thumbnail_hash(small):016x}"
                carried = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), jpeg.tail_checksum(payload))
                row = (image.width, image.height, *carried, len(f), hashlib.sha256(f).hexdigest(), name)
                rows.append(row + ((payload, small.tobytes()) if pixels else ()) + (None,))
            return [list(x) for x in zip(*rows, strict=True)]

        return work

    return map_text(pick(df, {**{k: k for k in keep}, "__media": media_col}), "__media", list(keep), fields, make)
