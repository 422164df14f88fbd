"""Token counts with a two-tier lookup on the map side.

Every text falls apart into pre-tokens that no merge of the model crosses, so
the count of a text is the sum of the counts of its pre-tokens. Frequent
pre-tokens of all texts and their counts form a small table that is broadcast;
the others are encoded by the library and kept in a bounded cache of the
worker. Texts and their pre-tokens are not shuffled, only one bounded summary
of each task. The table and the caches only save time: every count is the
library's own, so ties among frequent pre-tokens do not matter.

Null and empty texts have 0 tokens, an empty table no rows. Repeated rows each
get their row. A very long text is counted whole, as one slice of its batch.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import dropped, map_arrow, map_text, pick, slices, stored, strings

SPACE = "▁"
#: Entries of a worker's cache before it starts afresh.
CACHE_ENTRIES = 150_000
#: Entries of the broadcast table; with texts of pre-tokens this is about 2 MB.
FREQUENT = 30_000
#: Words that a task holds while it counts; of more, those below the FREQUENT-th count go (see ``thinned``).
HELD = 8 * FREQUENT
#: Sizes of counts in a doubling; there are fewer than 64 doublings.
STEPS = 16
#: Longest pre-token that a cache keeps.
KEEP_CHARS = 64

_models: dict[int, "PieceCounter"] = {}


class PieceCounter:
    """Counts tokens of a sentencepiece model by pre-token."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(model)
        self.frequent: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.splits = self._splits()
        self.spaces: dict[int, int] = {}

    def _splits(self) -> bool:
        """Whether texts may be cut before spaces and newlines: no piece crosses such a place."""
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        special = [i for i, p in enumerate(pieces) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)]
        plain = [p for i, p in enumerate(pieces) if i not in set(special)]
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain)
        probe = self.library.encode(["a", " a", "a ", "\na", "  a", "a  b"], out_type=str)
        kept = [list("".join(x)) for x in probe]
        want = ["▁a", "▁▁a", "▁a▁", None, "▁▁▁a", "▁a▁▁b"]
        same = all(w is None or "".join(k) == w for k, w in zip(kept, want, strict=True)) and probe[3][0] == SPACE
        return not crossing and same

    def pretokens(self, text: str) -> list[str]:
        """Keys of one text; the empty key stands for one more space before the next."""
        return text.replace("\n", " \n").split(" ")

    def encode_counts(self, keys: list[str]) -> list[int]:
        """Tokens of each key in its place: after a space, or a newline without one."""
        return [len(ids) - (k[0] == "\n") for k, ids in zip(keys, self.library.encode(keys, num_threads=1), strict=True)]

    def space_count(self, n: int) -> int:
        if n not in self.spaces:
            self.spaces[n] = len(self.library.encode("a" + " " * n)) - len(self.library.encode("a"))
        return self.spaces[n]

    def whole(self, text: str) -> int:
        return len(self.library.encode(text))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [self.whole(t) if t else 0 for t in texts]
        split = [self.pretokens(t) if t and SPACE not in t else None for t in texts]
        known, hot = self.cache, self.frequent
        missing = {w for ws in split if ws for w in set(ws).difference(hot) if w not in known}
        missing.discard("")
        if len(known) + len(missing) > CACHE_ENTRIES:
            known = self.cache = {}
            missing = {w for ws in split if ws for w in set(ws).difference(hot)}
            missing.discard("")
        order = list(missing)
        fresh = dict(zip(order, self.encode_counts(order), strict=True)) if order else {}
        known.update((k, v) for k, v in fresh.items() if len(k) <= KEEP_CHARS)
        out = []
        for text, ws in zip(texts, split, strict=True):
            if ws is None:
                out.append(self.whole(text) if text else 0)
                continue
            found = list(map(hot.get, ws))
            if None in found or "" in ws:
                found = self._slow(ws, found, known, fresh)
            out.append(sum(found))
        return out

    def _slow(self, ws: list[str], found: list, known: dict, fresh: dict) -> list[int]:
        out, run = [], 0
        for w, n in zip(ws, found, strict=True):
            if not w:
                run += 1
                continue
            if run and w[0] != "\n":
                n = self.encode_counts([" " * run + w])[0]
            elif run:
                out.append(self.space_count(run))
                n = None
            run = 0
            if n is None:
                n = self.frequent.get(w)
            if n is None:
                n = known.get(w)
            out.append(fresh[w] if n is None else n)
        if run:
            out.append(self.space_count(run))
        return out


def _counter(model: bytes, frequent: dict[str, int]) -> PieceCounter:
    """The worker's counter, kept between tasks."""
    key = hash(model)
    if key not in _models:
        _models.clear()
        _models[key] = PieceCounter(model)
    _models[key].frequent = frequent
    return _models[key]


def thinned(seen: Counter[str], entries: int) -> Counter[str]:
    """A summary of at most ``entries`` words: the next count is taken off every word, and words left with nothing go.

    Such summaries may be counted on, added up and thinned again; a word of a
    share above one in ``entries`` of all words is never lost.
    """
    if len(seen) <= entries:
        return seen
    off = heapq.nlargest(entries + 1, seen.values())[-1]
    return Counter({w: c - off for w, c in seen.items() if c > off})


def frequent_table(df: DataFrame, model: bytes, text_col: str, entries: int = FREQUENT) -> dict[str, int]:
    """Counts of the pre-tokens most frequent in all texts.

    Each task sums up its own rows in a summary of bounded size and passes on
    at most ``entries`` words, those seen once left out. To the driver go the
    numbers of words by the size of their count, in steps of ``STEPS`` to a
    doubling, and then the words of the greatest sizes that together are no
    more than ``entries``.
    """
    texts = pick(df, {"text": text_col})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for t in strings(batch.column(0).slice(a, b - a)):
                    seen.update(t.replace("\n", " \n").split(" "))
                if len(seen) > max(HELD, 2 * entries):
                    seen = thinned(Counter({w: c for w, c in seen.items() if len(w) <= KEEP_CHARS}), entries)
        best = [(w, c) for w, c in seen.items() if w and len(w) <= KEEP_CHARS and c > 1]
        best = heapq.nlargest(entries, best, key=lambda x: (x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([c for _, c in best], pa.int64())], names=["w", "c"])

    merged = stored(map_arrow(texts, summed, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")), "pretokens")
    step = F.floor(F.log2("c") * STEPS).cast("long")
    total, least = 0, None
    for size, n in merged.groupBy(step.alias("size")).count().orderBy(F.desc("size")).collect():
        total += n
        if total > entries:
            break
        least = size
    rows = [] if least is None else merged.where(step >= least).collect()
    dropped(df.sparkSession, merged)
    counter = PieceCounter(model)
    words = [r.w for r in rows if SPACE not in r.w]
    return dict(zip(words, counter.encode_counts(words), strict=True)) if words and counter.splits else {}


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, entries: int = FREQUENT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of ``df``.

    ``model`` is the content of a sentencepiece model file. If its pieces cross
    spaces or it rewrites texts, whole texts are given to the library instead.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((model, frequent_table(df, model, text_col, entries)))

    def make():
        counter = _counter(*shared.value)

        def work(text: pa.Array) -> list:
            texts = strings(text)
            counts = counter.counts(texts)
            sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            return [sizes, pa.array(counts, pa.int64()), pa.array([c > max_tokens for c in counts], pa.bool_())]

        return work

    docs = pick(df, {"id": id_col, "text": text_col})
    return map_text(docs, "text", ["id"], "n_bytes long, n_tokens long, over_limit boolean", make).withColumnRenamed("id", id_col)
