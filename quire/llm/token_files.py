"""Token files: ids of all documents in order of their ids, written and read back.

Documents are dealt out by ranges of their id and sorted, so the files taken in
order hold them in ascending order. Each task encodes its documents and closes
a file after about ``FILE_TOKENS`` ids. A file (see ``rans``) is one row of a
Parquet table in the shared folder: Spark's writer commits it, whatever the
store, and a lost executor costs no more than its own files.

Rows with a null text hold the end id alone. Rows with a null id come first.
Repeated rows keep their places beside each other; documents of one id follow
each other in any order. An empty table makes no file. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import rans
from quire.llm.bpe_codec import encode_array
from quire.llm.frames import SLICE_BYTES, map_arrow, pick, slices, stored

#: Ids in a file after which the next batch of texts opens another.
FILE_TOKENS = 1_000_000
#: Stands for a null id inside a file.
NO_ID = -(1 << 63)


def write(df: DataFrame, content: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """part, seq, n_tokens and file (binary) of each file made, not yet written."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(content)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(df, {"id": id_col, "text": text_col}).repartitionByRange(n, "id").sortWithinPartitions("id")

    def files(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        content = shared.value
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def closed():
            flat = np.concatenate(ids)
            file = rans.compress(flat, np.concatenate(docs), np.concatenate(sizes))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([file], pa.binary())], names=["part", "seq", "n_tokens", "file"])

        for batch in batches:
            for a, b in slices(batch.column(1), min(SLICE_BYTES, 4 * file_tokens)):
                flat, begins = encode_array(content, batch.column(1).slice(a, b - a))
                ids.append(np.insert(flat, begins[1:], end_id))
                sizes.append(np.diff(begins) + 1)
                docs.append(pc.fill_null(batch.column(0).slice(a, b - a).cast(pa.int64()), NO_ID).to_numpy())
                if sum(map(len, ids)) >= file_tokens:
                    yield closed()
                    ids, docs, sizes, seq = [], [], [], seq + 1
        if docs:
            yield closed()

    return map_arrow(docs, files, "part int, seq int, n_tokens long, file binary")


def read(files: DataFrame, id_col: str = "doc_id", tokens: bool = True) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document in ``files``; with ``tokens`` its ids too.

    start counts the ids of all documents before it. It comes from the files'
    sizes: sums by part, then within a part, so no task sees all files.
    """
    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    starts = sizes.withColumn("inside", F.sum("n_tokens").over(own) - F.col("n_tokens")).join(parts, "part")
    placed = files.drop("n_tokens").join(starts.select("part", "seq", (F.col("before") + F.col("inside")).alias("start")), ["part", "seq"]).select("start", "file")
    fields = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if tokens else "")

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                file = rans.parse(batch.column(1)[row].as_py())
                ids = rans.decode_blocks(file).astype("<u4")
                sizes = file.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                raw = ids.tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NO_ID), pa.array(begins + batch.column(0)[row].as_py(), pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                if tokens:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return map_arrow(placed, documents, fields)


def round_trip(df: DataFrame, content: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """Writes the token files of ``df`` to the shared folder and reads its documents back from them."""
    return read(stored(write(df, content, end_id, id_col, text_col), "token-files"), id_col, tokens)
