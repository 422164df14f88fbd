"""Shared plumbing: column selection, Arrow mapping, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker holds as numpy temporaries at once.
SLICE_BYTES = 1 << 19
#: Ids that may be broadcast, at some 180 bytes each with Spark's hash map.
BROADCAST_IDS = 300_000
#: A key is hot with more than one of so many rows, and more than HOT_ROWS of them.
HOT_SHARE = 4_096
HOT_ROWS = 1_000
#: Rows of a table that need no spreading, whatever their keys.
FEW_ROWS = 20_000
#: Rows that go to a worker at once.
BATCH_ROWS = 1_000


def pick(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """``df`` reduced to ``{new name: old name}``, chosen by position.

    Columns whose names differ only in case, hold dots or occur twice do not
    disturb it: the first exact match wins, else the first match without case.
    An old name of None gives a null string column.
    """
    names = df.columns
    place = {}
    for new, old in columns.items():
        if old is None:
            continue
        place[new] = position(names, old)
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[(F.col(f"_{place[new]}") if new in place else F.lit(None).cast("string")).alias(new) for new in columns])


def position(names: Sequence[str], name: str) -> int:
    """Place of a column: of the first exact match, else of the first match without case."""
    found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r} in {names}")
    return found[0]


def restore(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns ``_0, _1, ...`` of ``df`` under the names of ``schema`` again."""
    return df.select(*[F.col(f"_{i}") for i in range(len(schema.names))]).toDF(*schema.names)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed ``_0, _1, ...`` by position."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def slices(text: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of ``text`` of about ``limit`` bytes each, SLICE_BYTES without one; a long text stands alone."""
    limit = limit or SLICE_BYTES
    sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def map_arrow(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches small enough for whole texts.

    Spark's own batch is 10,000 rows, however long they are. Where the session
    leaves it at that, it is set to ``BATCH_ROWS``.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, text: str, keep: Sequence[str], fields: str | T.StructType, make: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` and the columns ``fields`` computed from its text column.

    ``make`` runs once a task and returns a function from a string array to a
    list of arrays (or lists) of the same length, one for each field. It gets
    about ``limit`` bytes at a time.
    """
    extra = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    kept = T.StructType([df.schema[c] for c in keep])
    out = T.StructType([*kept.fields, *extra.fields])
    place = [df.columns.index(c) for c in keep]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(extra)]
        work = None
        for batch in batches:
            for a, b in slices(batch.column(at), limit):
                work = work or make()
                part = batch.slice(a, b - a)
                made = work(part.column(at))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in place], *arrays], names=out.names)

    return map_arrow(df, run, out)


def strings(array: pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [x or "" for x in array.to_pylist()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the one that driver and executors share.

    That is ``spark.checkpoint.dir``. Only a session on one machine, as in
    tests, may do without: it gets a temporary folder.
    """
    base = checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    return f"{base}/{name}-{jvm.java.util.UUID.randomUUID().toString()}"


def checkpoint_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext.getCheckpointDir()
        if not chosen:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
            chosen = spark.sparkContext.getCheckpointDir()
        base = chosen
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage at files that outlive any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables made by ``stored``, once nothing reads them any more."""
    for f in {x.rsplit("/", 1)[0] for df in tables for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, by: Column, rows: int) -> DataFrame:
    """Left join of ``left``, of some ``rows`` rows, with ``right``, which has one row for each key.

    ``weight`` is a column of ``right`` with the number of left rows of the key.
    A key that holds more than one of ``HOT_SHARE`` rows of ``left`` is hot. As
    there cannot be more hot keys than that, they are joined by broadcast. Hot
    rows, and rows without a key, are then dealt out by the hash of ``by`` and
    match nothing in the join by shuffle that serves the rest. A left side of at
    most ``FEW_ROWS`` is joined plainly.
    """
    if rows <= FEW_ROWS:
        return left.join(right, keys, "left").select(*left.columns, *[c for c in right.columns if c not in keys])
    bound = F.lit(float(max(rows / HOT_SHARE, HOT_ROWS)))
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(weight) > bound).select(*keys, F.struct(*values).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    apart = F.col("__hot").isNotNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    marked = marked.withColumn("__salt", F.when(apart, F.xxhash64(by)).otherwise(F.lit(0)))
    # 0 for every row, but no constant to the optimizer, which would take it out of the key
    cold = right.where(F.col(weight) <= bound).select(*keys, F.struct(*values).alias("__cold"), F.least(F.col(weight), F.lit(0)).cast("long").alias("__salt"))
    joined = marked.join(cold, [*keys, "__salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(F.col("__hot").getField(v), F.col("__cold").getField(v)).alias(v) for v in values])


def only(df: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of ``df`` whose id is among ``ids`` (one column, id, written already).

    Up to ``limit`` ids are broadcast, so that texts are filtered where they
    are read; more are joined by a shuffle.
    """
    if ids.count() <= (BROADCAST_IDS if limit is None else limit):
        return df.join(F.broadcast(ids), "id", "left_semi")
    return df.join(ids.hint("shuffle_hash"), "id", "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Documents that come in fewer parts than there are cores are dealt out to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores, "doc_id")
    return rows


def unsigned_fraction(key: Column, fraction: float) -> Column:
    """True for that fraction of keys, chosen by hash."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(max(1, round(fraction * 1_000_000)))
