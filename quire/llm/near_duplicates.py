"""Near-duplicates by circulant MinHash, bands, and exact Jaccard similarity.

1. One pass makes each document's shingle set; its size, band keys and a digest
   of its words are written to the shared folder. Documents of the same words
   form a class, and only the smallest id of a class goes on.
2. In every bucket of a band a pivot is chosen at random, and the others are
   compared with it. Links join documents into components.
3. Buckets that still hold several components are finished exactly: each goes
   to one of its components, its home, and every document outside the home is
   compared with all documents sent there. An index from shingle to document
   counts all intersections of a set at once, so a group of many copies costs
   no pairs.

Documents are compared on full sets: hashes of shingles tell which may be
similar, and a link is made after counting the shingles of both texts as words.

A group is never in one task as a whole: pivots are repeated for every few
hundred documents, and homes are dealt out in blocks of bounded size. Each
outsider visits every block; for many outsiders a block is repeated. Joins by
class, bucket, pivot or home spread the keys that hold many rows.

Only links between documents in different components are sought, as others
change nothing. Sets of at least the similarity sought miss each other in all
bands in less than one of ten million cases.

Null or empty texts, and texts without words, have an empty set, which is
linked with nothing; such a document is its own component. A text may be of any
length that a row can hold; a worker takes a longer one than its usual batch by
itself. Rows of one id are one document and share a component. A row without an
id is linked with nothing, has a null component, and is kept. Ties are settled
by the smallest id. An empty table gives an empty result. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import circulant, wordhash
from quire.llm.components import components
from quire.llm.frames import dropped, map_arrow, map_text, only, pick, slices, spread_join, stored, strings

#: Documents that are compared with one copy of a pivot.
PIVOT_ROWS = 512
#: Shingles of a block of a home.
BLOCK_SHINGLES = 1 << 17
#: Outsiders that are compared with one copy of a block.
PROBE_ROWS = 1_000


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """id, n, d1, d2 (digest of the words; null without any) and bands of every row of ``docs`` (id, text)."""

    def make():
        def work(text: pa.Array) -> list:
            w = wordhash.words(text, lower=True)
            sets = circulant.sets(w, size)
            names = [hashlib.blake2b(b" ".join(t.encode().lower().split()), digest_size=16).digest() for t in strings(text)]
            digests = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            none = np.array([not len(s) for s in sets], bool)
            full = np.flatnonzero(~none).tolist()
            keys = circulant.bands(np.array([circulant.signature(sets[i]) for i in full])) if full else np.zeros((0, 0), np.int64)
            bands = np.full(len(sets), None, object)
            for i, k in zip(full, keys, strict=True):
                bands[i] = k
            return [circulant.set_sizes(w, sets, size, text), *(pa.array(digests[:, k], pa.int64(), mask=none) for k in (0, 1)), pa.array(list(bands), pa.list_(pa.int64()))]

        return work

    return map_text(docs, "text", ["id"], "n long, d1 long, d2 long, bands array<long>", make)


class Index:
    """Sets of a block, by shingle."""

    def __init__(self, ids: list[int], groups: list[int], sets: list[np.ndarray], texts: list[str], size: int):
        self.ids, self.groups, self.texts, self.size = np.array(ids, np.int64), np.array(groups, np.int64), texts, size
        self.words: dict[int, set[bytes]] = {}
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.shingles, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))

    def shared(self, one: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``one`` with each set of the block."""
        at = np.searchsorted(self.shingles, one)
        at = at[(at < len(self.shingles)) & (self.shingles[np.minimum(at, len(self.shingles) - 1)] == one)]
        counts = self.end[at] - self.begin[at]
        place = np.repeat(self.begin[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return np.bincount(self.owner[place], minlength=len(self.ids))


    def linked(self, text: str, one: np.ndarray, group: int, share: int, whole: int) -> list[int]:
        """Ids of the first document of each other group that is similar to ``text``, of the set ``one``."""
        both = self.shared(one)
        hits = np.flatnonzero((self.groups != group) & (both > 0) & (whole * both >= share * (self.sizes + len(one) - both)))
        found: dict[int, int] = {}
        words = circulant.shingles(text, self.size) if hits.size else set()
        for k in hits.tolist():
            if (of := int(self.groups[k])) in found:
                continue
            other = self.words.get(k)
            if other is None:
                other = self.words[k] = circulant.shingles(self.texts[k], self.size)
            n = len(words & other)
            if whole * n >= share * (len(words) + len(other) - n):
                found[of] = int(self.ids[k])
        return list(found.values())


def compare(rows: DataFrame, size: int, share: int, whole: int) -> DataFrame:
    """Links a, b found in ``rows``: home, block, probe, id, grp, text.

    In each block of a home the rows with probe false are indexed, and each row
    with probe true is compared with them; of each group other than its own the
    first similar document gives a link. Links need
    ``whole * intersection >= share * union``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("home", "block", "probe", "id", "grp", "text").repartition(n, "home", "block").sortWithinPartitions("home", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            for a, b in slices(batch.column(5)):
                part = batch.slice(a, b - a)
                sets = circulant.sets(wordhash.words(part.column(5), lower=True), size)
                found_a, found_b = [], []
                for s, home, block, probe, one, group, text in zip(sets, *(c.to_pylist() for c in part.columns), strict=True):
                    if (home, block) != key:
                        key, held, index = (home, block), [], None
                    if not probe:
                        held.append((one, group, s, text))
                        continue
                    if index is None:
                        if not held:
                            continue
                        index = Index(*map(list, zip(*held, strict=True)), size)
                        held = held[:1]
                    others = index.linked(text, s, group, share, whole)
                    found_a += [one] * len(others)
                    found_b += others
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that have one id and different words."""
    several = full.groupBy("id").agg(*[f(d).alias(f"{f.__name__}_{d}") for f in (F.min, F.max) for d in ("d1", "d2")]).where("min_d1 <> max_d1 or min_d2 <> max_d2")
    named = full.join(several.select("id"), "id", "left_semi").select("id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("id", "rep")
    return named.join(named.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")).where("a <> b")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80, whole: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept of every row of ``df``."""
    docs = pick(df, {"id": id_col, "text": text_col})
    rows = stored(profiles(docs, size), "profiles")
    full = rows.where("n > 0 and id is not null")
    classes = stored(full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c")), "classes")
    # the key holds the id, so copies of one text do not meet
    reps = full.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"], "left_semi").dropDuplicates(["d1", "d2", "id"])

    keyed = reps.select(F.explode("bands").alias("key"), "id", "n")
    mask = F.xxhash64("key")
    chosen = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min(F.col("id").bitwiseXOR(mask)).alias("m")).where("c > 1").select("key", "c", F.col("m").bitwiseXOR(mask).alias("pivot"))
    most = 32 * classes.count()
    buckets = stored(spread_join(keyed, chosen, ["key"], "c", F.col("id"), most).where("c > 1"), "buckets")
    entries = buckets.count()

    wanted = stored(buckets.select("id").distinct(), "wanted")
    texts = stored(only(docs, wanted), "texts")

    # compare with pivots
    pairs = stored(buckets.where("id <> pivot").select("pivot", "id", "n").distinct(), "pairs")
    sizes = buckets.select(F.col("id").alias("pivot"), F.col("n").alias("m")).distinct()
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("c")).join(sizes, "pivot")
    close = whole * F.least("n", "m") >= share * F.greatest("n", "m")
    near = stored(spread_join(pairs, sizes, ["pivot"], "c", F.col("id"), entries).where(close).select(F.col("pivot").alias("home"), "id"), "near")
    parts = near.groupBy("home").agg(F.count("*").alias("c"), F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
    index = parts.select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(False).alias("probe"), F.col("home").alias("id"))
    probe = spread_join(near, parts, ["home"], "c", F.col("id"), entries).select("home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("block"), F.lit(True).alias("probe"), "id")
    star = compare(index.union(probe).withColumn("grp", F.col("id")).join(texts, "id"), size, share, whole)
    groups = stored(components(star.union(_same_id(full, classes))), "components")

    # finish buckets that hold several components
    placed = buckets.where("c > 2").select("key", "id", "n").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("grp"))
    counts = placed.groupBy("key", "grp").agg(F.count("*").alias("c"))
    homes = counts.groupBy("key").agg(F.count("*").alias("groups"), F.sum("c").alias("c"), F.max(F.struct("c", (-F.col("grp")).alias("g"))).alias("best")).where("groups > 1").select("key", "c", (-F.col("best.g")).alias("home"))
    sent = stored(spread_join(placed, homes, ["key"], "c", F.col("id"), entries).where("home is not null").select("home", "id", "n", "grp").distinct(), "sent")
    probes = F.greatest(F.lit(1), F.ceil(F.count_if(F.col("grp") != F.col("home")) / PROBE_ROWS))
    blocks = sent.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"), probes.cast("int").alias("probes"), F.count("*").alias("c"))
    dealt = spread_join(sent, blocks, ["home"], "c", F.col("id"), entries)
    own, turn = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("probes")).cast("int")
    index = dealt.select("home", "probes", "id", "grp", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("turn"), F.lit(False).alias("probe"))
    probe = dealt.where("grp <> home").select("home", "probes", "id", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn.alias("turn"), F.lit(True).alias("probe"))
    cells = index.union(probe).select("home", (F.col("part") * F.col("probes") + F.col("turn")).alias("block"), "probe", "id", "grp")
    late = compare(cells.join(texts, "id"), size, share, whole)
    owner = groups.select(F.col("node"), F.col("component"))
    late = late.join(owner.toDF("a", "ga"), "a", "left").join(owner.toDF("b", "gb"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    merged = components(late)

    # component of each class, then of each row
    held = groups.groupBy("component").agg(F.count("*").alias("c"))
    last = merged.select(F.col("node").alias("component"), F.col("component").alias("last")).join(held, "component", "left").na.fill(0, ["c"])
    moved = spread_join(groups, last, ["component"], "c", F.col("node"), entries).select("node", F.coalesce("last", "component").alias("component"))
    moved = moved.union(merged.join(groups, "node", "left_anti").select("node", "component"))
    named = classes.join(moved.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "c", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")
    dropped(df.sparkSession, classes, buckets, wanted, texts, pairs, near, groups, sent)
    out = spread_join(rows, named, ["d1", "d2"], "c", F.rand(7), rows.count())
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
