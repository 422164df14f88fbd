"""Cross-entropy difference of documents under matched n-gram models.

A target model is trained on marked documents, a background model on all
others. Both are bigram models over the tokens of one fixed vocabulary and a
boundary, smoothed alike: a context's counts are joined by ``PRIOR`` more that
follow the model's unigrams, which have ``SMOOTHING`` added to each count. The
score of a document is its mean loss per token under the target model less that
under the background model: the lower, the more like the target.

No document is scored by a model that has seen it: its own counts are taken out
of the model it was trained on. That needs no second training, as each
probability is a ratio of counts.

The background is every document that is not marked. It is not cut down to the
size of the target, as statistics here are to cover the whole corpus; models
are matched in order, vocabulary, smoothing and in leaving out what they score.

Texts are encoded once, and their ids written to the shared folder. Counts cover
every document; each task sums its bigrams before they are shuffled. What
belongs to single tokens or contexts is bounded by the vocabulary and is
broadcast, and so are the counts of at most ``HELD_BIGRAMS`` bigrams, the more
frequent ones. Of the rest, which are as many as the corpus makes them, each
document sends its own to their counts in a shuffle, where only a logarithm is
left to be taken, and the losses are summed up by document. None of those
bigrams is frequent, so no key of that shuffle is hot.

Null and empty texts, and texts without tokens, have 0 tokens and null losses,
and are not trained on. A text may be of any length that a row can hold. Without
a marked document the target model knows nothing and is uniform. Repeated rows
count each time, and each leaves out itself alone. Equal texts have equal losses
if they are marked alike; nothing is ranked, so there are no ties. Rows without
an id are scored, but never marked. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe_codec import encode_array
from quire.llm.frames import map_arrow, pick, slices, stored
from quire.llm.word_bpe import IntMap

#: Counts that a context's distribution gets from the unigrams.
PRIOR = 50.0
#: Added to every unigram count.
SMOOTHING = 0.1
#: Bigrams whose counts are broadcast; they take 48 bytes each in a worker.
HELD_BIGRAMS = 1_000_000
#: Marked documents whose ids may be broadcast, at some 180 bytes each with Spark's hash map.
BROADCAST_IDS = 300_000
#: Distinct bigrams that a task holds before it passes them on.
TASK_BIGRAMS = 1_000_000
#: Tokens that a worker takes at once.
SLICE_TOKENS = 1 << 17
#: Ranges of bigram counts in which to look for the bound of frequent ones, by doubling.
STEPS = 4


def encoded(docs: DataFrame, content: str) -> DataFrame:
    """row (a number of its own), id and token ids of every row of ``docs`` (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, begins = encode_array(shared.value, part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column(0), lists], names=["row", "id", "ids"])
                row += part.num_rows

    return map_arrow(docs.select("id", "text"), run, "row long, id long, ids array<int>")


def _slices(lists: pa.ListArray):
    """Ranges of rows with about ``SLICE_TOKENS`` ids each; a long row stands alone."""
    offsets = lists.offsets.to_numpy()
    begin = 0
    for i in range(1, len(lists) + 1):
        if i == len(lists) or offsets[i + 1] - offsets[begin] > SLICE_TOKENS:
            yield begin, i
            begin = i


def bigrams(lists: pa.ListArray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every bigram of rows of ids; a boundary stands before and after each row with ids."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ids, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    line = np.insert(ids, np.append(offsets[:-1][some], len(ids)), boundary) if len(some) else np.zeros(1, np.int64)
    return np.repeat(some, sizes[some] + 1), line[:-1] * (boundary + 1) + line[1:]


def _summed(codes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes, and sums of the columns by code."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)


def counts(texts: DataFrame, boundary: int) -> DataFrame:
    """code, target and background counts of all bigrams in ``texts`` (ids, marked)."""

    def run(batches):
        held: list[tuple] = []

        def together():
            return _summed(*map(np.concatenate, zip(*held, strict=True)))

        def rows(parts):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["code", "t", "b"])

        for batch in batches:
            for a, b in _slices(batch.column(0)):
                row, code = bigrams(batch.column(0).slice(a, b - a), boundary)
                marked = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                held.append(_summed(code, marked, 1 - marked))
                if sum(len(x[0]) for x in held) > TASK_BIGRAMS:
                    held = [together()]
                    if len(held[0][0]) > TASK_BIGRAMS // 2:
                        yield rows(held[0])
                        held = []
        if held:
            yield rows(together())

    return map_arrow(texts.select("ids", "marked"), run, "code long, t long, b long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


@dataclass
class Base:
    """Counts of both models for single tokens: row 0 target, row 1 background."""

    unigram: np.ndarray  # of each token behind a context
    total: np.ndarray  # of each token as context


def base(table: DataFrame, boundary: int) -> Base:
    size = boundary + 1
    made = []
    for key in (F.col("code") % size, F.floor(F.col("code") / size).cast("long")):
        rows = table.groupBy(key.alias("k")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        sums = np.zeros((2, size))
        sums[:, rows.column("k").to_numpy()] = rows.column("t").to_numpy(), rows.column("b").to_numpy()
        made.append(sums)
    return Base(*made)


def frequent(table: DataFrame, held: int) -> tuple[DataFrame, bool]:
    """The bigrams of at least some count, no more than ``held``, and whether there are others."""
    n = F.col("t") + F.col("b")
    step = F.floor(F.log2(n) * STEPS).cast("int")
    sizes = sorted(((r.step, r.c) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for s, c in sizes:
        if total + c > held:
            break
        total, least = total + c, s
    if least is None:
        return table.limit(0), bool(sizes)
    return table.where(step >= least), least != sizes[-1][0]


@dataclass
class Parts:
    """Distinct bigrams of some rows, in order of rows, and what their probabilities are made of."""

    row: np.ndarray
    code: np.ndarray
    n: np.ndarray
    more: np.ndarray  # for both models: to be added to the bigram's count
    whole: np.ndarray  # what the sum is divided by


def parts(of: Base, row: np.ndarray, code: np.ndarray, marked: np.ndarray) -> Parts:
    """The probability of a bigram is (count + more) / whole, without what its own row adds to the counts."""
    size = of.total.shape[1]
    keys, n = np.unique(row * (size * size) + code, return_counts=True)
    row, code = keys // (size * size), keys % (size * size)
    u, v = code // size, code % size

    def own(key):
        _, place = np.unique(key, return_inverse=True)
        return np.bincount(place, weights=n)[place]

    after, before, all_ = own(row * size + v), own(row * size + u), np.bincount(row, weights=n)[row]
    more, whole = np.empty((2, len(n))), np.empty((2, len(n)))
    for m in (0, 1):
        mine = marked[row] == (m == 0)
        unigram = (of.unigram[m, v] - mine * after + SMOOTHING) / (of.unigram[m].sum() - mine * all_ + SMOOTHING * size)
        more[m], whole[m] = PRIOR * unigram - mine * n, of.total[m, u] - mine * before + PRIOR
    return Parts(row, code, n, more, whole)


_maps: dict[str, tuple[IntMap, np.ndarray]] = {}


def score(df: DataFrame, marked: DataFrame, content: str, boundary: int, id_col: str = "doc_id", text_col: str = "text", marked_col: str = "doc_id", held_bigrams: int = HELD_BIGRAMS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """id, n_tokens, target_loss, background_loss and score (their difference) of every row of ``df``.

    ``marked`` has the ids of target documents; ``content`` is a tokenizer file
    (see ``word_bpe``) all of whose ids are below ``boundary``.
    """
    spark = df.sparkSession
    targets = pick(marked, {"id": marked_col}).where("id is not null").distinct().withColumn("marked", F.lit(True))
    if targets.count() <= broadcast_ids:
        targets = F.broadcast(targets)
    texts = encoded(pick(df, {"id": id_col, "text": text_col}), content).join(targets, "id", "left")
    texts = stored(texts.select("row", "id", "ids", F.coalesce("marked", F.lit(False)).alias("marked")), "encoded")
    table = stored(counts(texts, boundary), "bigrams")
    some, others = frequent(table, held_bigrams)
    rows = some.toArrow()
    known = rows.column("code").to_numpy(), np.array([rows.column("t").to_numpy(), rows.column("b").to_numpy()])
    shared = spark.sparkContext.broadcast((base(table, boundary), *known))
    sums = map_arrow(texts, _sums(shared, boundary), "id long, row long, n_tokens long, logs array<double>, rest array<struct<code: long, n: long, t: double, b: double>>")
    target, background = F.col("logs")[0], F.col("logs")[1]
    if others:
        sums = stored(sums, "sums")
        each = sums.select("row", F.inline("rest")).toDF("row", "code", "n", "mt", "mb").join(table, "code")
        late = each.groupBy("row").agg(*[F.sum(F.col("n") * F.log(F.col(c) + F.col(f"m{c}"))).alias(f"late_{c}") for c in "tb"])
        sums = sums.join(late, "row", "left")
        target, background = (x + F.coalesce(f"late_{c}", F.lit(0.0)) for x, c in ((target, "t"), (background, "b")))
    some = F.col("n_tokens") > 0
    target, background = (F.when(some, -x / (F.col("n_tokens") + 1)) for x in (target, background))
    return sums.select(F.col("id").alias(id_col), "n_tokens", target.alias("target_loss"), background.alias("background_loss"), (target - background).alias("score"))


def _sums(shared, boundary: int):
    """Sums of logarithms of each row's probabilities, but for the counts of bigrams that are not held: these make ``rest``."""

    name = uuid.uuid4().hex

    def run(batches):
        of, codes, held = shared.value
        if name not in _maps:
            _maps.clear()
            _maps[name] = IntMap(codes, np.arange(len(codes))), held
        known, held = _maps[name]
        kind = pa.struct([("code", pa.int64()), ("n", pa.int64()), ("t", pa.float64()), ("b", pa.float64())])
        for batch in batches:
            lists, flags = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("marked"))
            for a, b in _slices(lists):
                size = b - a
                sizes = lists.slice(a, size).value_lengths().to_numpy()
                row, code = bigrams(lists.slice(a, size), boundary)
                p = parts(of, row, code, flags.slice(a, size).to_numpy(zero_copy_only=False))
                at = known.get(p.code)
                there = at >= 0
                logs = -p.n * np.log(p.whole)
                logs[:, there] += p.n[there] * np.log(held[:, at[there]] + p.more[:, there])
                sums = np.array([np.bincount(p.row, weights=x, minlength=size) for x in logs]).reshape(2, size)
                left = ~there
                rest = pa.StructArray.from_arrays([pa.array(x) for x in (p.code[left], p.n[left], *p.more[:, left])], fields=list(kind))
                cuts = np.append(0, np.cumsum(np.bincount(p.row[left], minlength=size)))
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * size + 1, 2), pa.int32()), pa.array(sums.T.ravel()))
                columns = [batch.column(batch.schema.get_field_index(c)).slice(a, size) for c in ("id", "row")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pairs, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest)], names=["id", "row", "n_tokens", "logs", "rest"])

    return run
