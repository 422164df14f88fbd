"""Incremental runs of the document operators over files as they arrive.

There is no stream processing of its own here: a file-source stream hands each
batch of new rows to the same DataFrame functions that batch queries use.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

EVENTS = "query string, batch long, rows long, rows_so_far long, percent double, message string"


class Progress(StreamingQueryListener):
    """Keeps what running streams report, a row for each batch, start and end, in the order in which it came.

    ``expected`` is the number of rows that the source holds, if it is known;
    percent is then the part of them read so far, at most 99 before the end and
    100 after it. Streams run without it until they fail or end.
    """

    def __init__(self, expected: int | None = None):
        self.expected = expected
        self.rows: list[tuple] = []
        self.read: dict[str, int] = {}
        self.ended = threading.Event()

    def percent(self, so_far: int) -> float | None:
        return None if self.expected is None else min(99.0, 100.0 * so_far / self.expected) if self.expected else 99.0

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.id), None, 0, 0, None if self.expected is None else 0.0, "started"))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = str(p.id)
        self.read[name] = so_far = self.read.get(name, 0) + p.numInputRows
        self.rows.append((name, p.batchId, p.numInputRows, so_far, self.percent(so_far), f"batch {p.batchId}: {p.numInputRows} rows"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        so_far = self.read.get(str(event.id), 0)
        failed = event.exception.splitlines()[0] if event.exception else None
        done = self.percent(so_far) if failed else None if self.expected is None else 100.0
        self.rows.append((str(event.id), None, 0, so_far, done, f"failed: {failed}" if failed else "ended"))
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, EVENTS)


@contextmanager
def reported(spark: SparkSession, expected: int | None = None, wait: float = 10.0) -> Iterator[Progress]:
    """Progress of the stream that runs inside the block; its last event may come up to ``wait`` seconds behind it."""
    progress = Progress(expected)
    spark.streams.addListener(progress)
    try:
        yield progress
    finally:
        progress.ended.wait(wait)
        spark.streams.removeListener(progress)


def ingest(spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Runs ``work`` over all Parquet files in ``source`` not seen before and writes its rows to ``sink``.

    Each batch is a folder named by its number, written whole and overwritten
    if it is run again, so a batch that failed halfway leaves no rows twice.
    The position in the source is kept in ``checkpoint``; a later call goes on
    from there.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_files(spark: SparkSession, source: str, pattern: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, max_bytes: int = 100 * 1024 * 1024) -> None:
    """The same over whole files (path, modificationTime, length, content) whose names match ``pattern``, none over the size limit."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(source).where(f"length <= {max_bytes}")

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
