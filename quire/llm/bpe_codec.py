"""Byte-pair encoding and decoding of whole texts.

``encode`` and ``decode`` map texts to ids and ids to texts. Pieces of words
keep their ids in a bounded table of the worker; pieces not in it are encoded
together by the dynamic program of ``word_bpe``. Ids and texts equal those of the tokenizers library for the same
file, without special tokens added; strings of added tokens inside a text are
taken as such tokens, as the library does by default.

A null text has no ids, like an empty one. Rows are independent: repeated rows
repeat in the result, an empty table gives an empty one, and other columns of
the input are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm.frames import map_arrow, map_text, pick
from quire.llm.piece_table import PieceTable
from quire.llm.word_bpe import loaded

_tables: dict[int, PieceTable] = {}


def encode_array(content: str, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (int32), and where each text's begin; one more than texts."""
    key = hash(content)
    if key not in _tables:
        _tables.clear()
        _tables[key] = PieceTable(loaded(content))
    return _tables[key].encode(text)


def encode(df: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns, n_tokens and ids (array of int) of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(content)

    def make():
        content = shared.value

        def work(text: pa.Array) -> list:
            ids, begins = encode_array(content, text)
            return [np.diff(begins), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))]

        return work

    docs = pick(df, {id_col: id_col, **{k: k for k in keep}, "__text": text_col})
    return map_text(docs, "__text", [id_col, *keep], "n_tokens long, ids array<int>", make)


class Decoder:
    """Texts and digests of rows of ids."""

    def __init__(self, content: str):
        name = loaded(content).name
        size = max(name) + 1
        self.text = [name.get(i, "") for i in range(size)]
        self.number = [str(i) for i in range(size)]

    def decoded(self, ids: list[int]) -> str:
        return " ".join(map(self.text.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """Of the ids in decimal with single spaces, and of the text that they decode to."""
        listed = " ".join(map(self.number.__getitem__, ids))
        return hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decoded(ids).encode()).hexdigest()


_decoders: dict[int, Decoder] = {}


def decoder(content: str) -> Decoder:
    key = hash(content)
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(content)
    return _decoders[key]


def decode(ids: DataFrame, content: str, keep: tuple[str, ...] = ("doc_id", "n_tokens"), ids_col: str = "ids", digests: bool = False) -> DataFrame:
    """``keep`` columns and the text that every row of ids stands for.

    With ``digests`` the columns ids_sha256 and decoded_sha256 instead of the
    text: hashes of the ids in decimal with single spaces and of the text.
    """
    shared = ids.sparkSession.sparkContext.broadcast(content)
    fields = "ids_sha256 string, decoded_sha256 string" if digests else "text string"

    def make():
        own = decoder(shared.value)

        def work(column: pa.Array) -> list:
            values = column.flatten().to_pylist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
            rows = [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            return [list(x) for x in zip(*map(own.digests, rows), strict=True)] if digests else [list(map(own.decoded, rows))]

        return work

    column = ids_col if ids_col in keep else "__ids"
    rows = pick(ids, {**{k: k for k in keep}, column: ids_col})
    return map_lists(rows, column, list(keep), fields, make)


def round_trip(df: DataFrame, content: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, ids, ids_sha256 and decoded_sha256: ``encode`` and ``decode`` in one pass, which needs half as many workers."""
    shared = df.sparkSession.sparkContext.broadcast(content)

    def make():
        content = shared.value
        own = decoder(content)

        def work(text: pa.Array) -> list:
            ids, begins = encode_array(content, text)
            values, cuts = ids.tolist(), begins.tolist()
            digests = [own.digests(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return [np.diff(begins), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32())), [d[0] for d in digests], [d[1] for d in digests]]

        return work

    docs = pick(df, {**{k: k for k in keep}, "__text": text_col})
    return map_text(docs, "__text", list(keep), "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", make)


def map_lists(df: DataFrame, column: str, keep: list[str], fields: str, make) -> DataFrame:
    """Like ``map_text`` over an array column, a few hundred thousand elements at a time."""
    from pyspark.sql import types as T

    extra = T.StructType.fromDDL(fields)
    out = T.StructType([*(df.schema[c] for c in keep), *extra.fields])
    at, place = df.columns.index(column), [df.columns.index(c) for c in keep]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(extra)]
        work = None
        for batch in batches:
            work = work or make()
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            begin = total = 0
            cuts = []
            for i, n in enumerate(sizes):
                if total and total + n > 300_000:
                    cuts.append((begin, i))
                    begin, total = i, 0
                total += n
            if sizes:
                cuts.append((begin, len(sizes)))
            for a, b in cuts:
                part = batch.slice(a, b - a)
                made = [pa.array(x, type=t) for x, t in zip(work(part.column(at)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in place), *made], names=out.names)

    return map_arrow(df, run, out)
