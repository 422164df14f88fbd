"""Groups of equal texts, through an extendible-hash index on shared files.

A text's key is a 64-bit hash of its bytes. The index holds one slot for each
distinct key: how many rows have it and which of them is the greatest. A
directory of key prefixes tells the bucket of every slot. It begins as one
bucket and doubles, bit by bit, while a bucket holds more than ``CAPACITY``
slots; a doubling splits only the buckets that are overfull, so buckets have
prefixes of different depths. Buckets at ``DEEPEST`` are not split any more and
only grow. Slots lie in Parquet files in the shared folder, dealt to tasks by
ranges of buckets and sorted by key, so a key range belongs to one owner and a
reader skips the row groups of other ranges.

Keys find what may be equal; bytes decide. The texts of keys with several rows
are grouped by key and whole text, so equal ones meet once for each task that
reads them. A key with one text is settled by its slot alone. A key under which
different texts are chained is resolved text by text.

All work is in DataFrame functions. Only texts of repeated keys move, counted
before they do. Repeated keys are broadcast while they are few; beyond that
rows go to their key by ``spread_join``, which deals out hot keys.

Of equal texts the row with the greatest id stays; a null id is less than any
other. Of repeated rows with the same id and text one stays, chosen by its
place in the table as it was read. A null text counts as empty, and all empty
texts are equal. Texts may be of any length that a row can hold. An empty table
gives an empty result. Columns not asked for are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import BROADCAST_IDS, pick, spread_join, stored

#: Slots of a bucket before it is split.
CAPACITY = 50_000
#: Bits of the longest prefix in the directory, which has at most 2 ** DEEPEST entries.
DEEPEST = 16


def text_key(text: Column, bits: int = 64) -> Column:
    """The leading ``bits`` bits of a text's hash, as a long in the order of its prefixes."""
    return F.shiftright(F.xxhash64(text), 64 - bits)


def _prefix(key: Column, bits: int, depth: int) -> Column:
    """The first ``depth`` bits of a key of ``bits`` bits, as a number from 0."""
    return F.shiftright(key, bits - depth) + (1 << depth - 1) if depth else F.lit(0).cast("long")


def directory(slots: DataFrame, bits: int = 64, capacity: int = CAPACITY, deepest: int = DEEPEST) -> DataFrame:
    """entry (a prefix of full depth), bucket (first entry of its bucket), depth and slots of the bucket.

    ``slots`` has one row for each key. The depth of the directory is that of
    the deepest bucket that could still have to be split, at most ``deepest``.
    """
    full = depth_of(slots.count(), bits, capacity, deepest)
    fine = slots.groupBy(_prefix(F.col("key"), bits, full).alias("entry")).agg(F.count("*").alias("n"))
    levels = fine.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(full)), lambda d: F.struct(d.alias("depth"), F.floor(F.col("entry") / F.pow(F.lit(2.0), full - d)).cast("long").alias("prefix")))).alias("at"))
    buckets = levels.groupBy("at.depth", "at.prefix").agg(F.sum("n").alias("slots"))
    split = buckets.where((F.col("slots") > capacity) & (F.col("depth") < full))
    halves = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    roots = slots.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    leaves = roots.union(halves).join(split, ["depth", "prefix"], "left_anti").join(buckets, ["depth", "prefix"], "left")
    width = F.pow(F.lit(2.0), full - F.col("depth")).cast("long")
    first = F.col("prefix") * width
    return leaves.select(F.explode(F.sequence(first, first + width - 1)).alias("entry"), first.alias("bucket"), "depth", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))


def depth_of(slots: int, bits: int, capacity: int, deepest: int) -> int:
    """Bits of a directory for so many slots; two more than an even spread needs."""
    return min(bits, deepest, max(0, -(-slots // capacity) - 1).bit_length() + 2)


def index(entries: DataFrame, bits: int = 64, capacity: int = CAPACITY, deepest: int = DEEPEST) -> DataFrame:
    """key, n (rows), head (greatest id and row), bucket and depth for each key, on shared files in order of buckets and keys.

    ``entries`` has key, id and row.
    """
    slots = stored(entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("head")), "slots")
    found = directory(slots, bits, capacity, deepest).drop("slots")
    full = depth_of(slots.count(), bits, capacity, deepest)
    placed = slots.withColumn("entry", _prefix(F.col("key"), bits, full)).join(F.broadcast(found), "entry").drop("entry")
    return stored(placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")


def _among(rows: DataFrame, keys: DataFrame, total: int, limit: int) -> DataFrame:
    """Rows whose key is one of ``keys`` (key, n)."""
    if keys.count() <= limit:
        return rows.join(F.broadcast(keys.select("key")), "key", "left_semi")
    return spread_join(rows, keys.select("key", F.col("n").alias("__n")), ["key"], "__n", F.col("text"), total).where("__n is not null").drop("__n")


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    normal: Callable[[Column], Column] = lambda text: text,
    bits: int = 64,
    capacity: int = CAPACITY,
    broadcast_keys: int = BROADCAST_IDS,
) -> DataFrame:
    """id, ``keep`` columns, keep_id, group_size, kept and text_sha256 of every row of ``df``.

    Texts are compared as ``normal`` makes them. ``bits`` of the hash serve as
    key; fewer make more collisions and the same result.
    """
    docs = pick(df, {**{f"keep_{i}": c for i, c in enumerate(keep)}, "id": id_col, "text": text_col})
    docs = docs.withColumn("text", F.coalesce(normal(F.col("text")), F.lit(""))).withColumn("key", text_key(F.col("text"), bits))
    own = [f"keep_{i}" for i in range(len(keep))]
    entries = stored(docs.select(*own, "id", "key", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("sha")), "entries")
    total = entries.count()
    repeated = index(entries, bits, capacity).where("n > 1").select("key", "n", "head")

    # bytes decide: one row for each distinct text of a repeated key
    texts = _among(docs.select("key", "text"), repeated, total, broadcast_keys).groupBy("key", "text").agg(F.count("*").alias("n"))
    chained = stored(texts.groupBy("key").agg(F.count("*").alias("links"), F.sum("n").alias("n")).where("links > 1"), "chained")
    plain = repeated.withColumn("links", F.lit(1)) if chained.isEmpty() else repeated.join(chained.select("key", "links"), "key", "left")
    settled = spread_join(entries, plain, ["key"], "n", F.col("row"), total)
    one, row = F.col("n").isNull(), F.col("head.row") == F.col("row")
    columns = [*own, "id", F.when(one, F.col("id")).otherwise(F.col("head.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(row, F.lit(True)).alias("kept"), "sha"]
    out = settled.where("coalesce(links, 1) = 1").select(*columns)
    if not chained.isEmpty():
        tangled = stored(_among(docs, chained, total, broadcast_keys).select(*own, "id", "key", "text", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("sha")), "tangled")
        classes = tangled.groupBy("key", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("head"))
        out = out.unionByName(spread_join(tangled, classes, ["key", "text"], "n", F.col("row"), total).select(*columns))
    return out.toDF(*keep, id_col, "keep_id", "group_size", "kept", "text_sha256")


#: The same over ``documents``.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
