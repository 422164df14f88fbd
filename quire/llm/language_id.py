"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space, and the n-grams of
one to three characters that hold a letter are hashed into a fixed number of
buckets. The matrix of log-probabilities, buckets by languages, is broadcast;
its size is set by these parameters alone. Workers score a batch of texts as
one sparse product: a gather of matrix rows and a sum for each text.

Texts that are null or without letters are ``und`` with score 0. Rows with a
null label are not learned from; without any labelled row every text is
``und``. Repeated rows and ties give equal results for equal texts: of
languages with the same score the first in alphabetical order is taken. Only
the text decides a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import map_arrow, map_text, pick, strings, unsigned_fraction

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Labelled rows that are learned from at most, about; whole texts of a hash sample.
FIT_ROWS = 12_000
SMOOTHING = 0.5
#: Overlapping n-grams repeat their evidence; log-likelihoods are divided by this.
TEMPER = 3.0
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

_letters: list[np.ndarray] = []


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities, float32
    prior: np.ndarray


def letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _letters[0]


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and where each text begins; letters of each text."""
    low = [t.lower() for t in texts]
    gap = " " * (max(ORDERS) - 1)
    code = np.frombuffer((gap + gap.join(low) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    begin = np.concatenate([[0], np.cumsum(sizes + len(gap))])  # each with the gap before it
    table = letters()
    letter = table[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if far.size:
        letter[far] = [chr(c).isalpha() for c in code[far].tolist()]
    x = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    n = int(begin[-1])
    running = np.concatenate([[0], np.cumsum(letter[:n])])
    out = []
    h, some = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(max(ORDERS)):
        h = h + (x[k : k + n] + np.uint64(k + 1)) * _MIX[k]
        some |= letter[k : k + n]
        if k + 1 in ORDERS:
            h2 = (h ^ (h >> np.uint64(29))) * _MIX[(k + 1) % 3]
            at = np.flatnonzero(some)
            out.append(((h2[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(at, begin)))
    return out, running[begin[1:]] - running[begin[:-1]]


def fit(labelled: DataFrame, text_col: str, label_col: str, id_col: str, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the non-null labels of ``labelled``, from about ``fit_rows`` rows chosen by a hash of the id."""
    rows = pick(labelled, {"id": id_col, "text": text_col, "label": label_col}).where("label is not null and text is not null and id is not null")
    total = rows.count()
    if not total:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    rows = rows.where(unsigned_fraction(F.col("id"), min(1.0, fit_rows / total))).select("label", "text")

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = strings(batch.column(1))
            for name, text in zip(names, texts, strict=True):
                own = sums.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                docs[name] = docs.get(name, 0) + 1
                for buckets, _ in grams([text])[0]:
                    own += np.bincount(buckets, minlength=len(own))
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own[at], docs[name]), pa.int64())], names=["label", "bucket", "n"])

    sums = map_arrow(rows, counted, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("label").to_numpy(zero_copy_only=False)
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    languages = sorted(set(names.tolist()))
    column = np.searchsorted(np.array(languages, dtype=object), names)
    counts, docs = np.zeros((1 << BUCKET_BITS, len(languages))), np.zeros(len(languages))
    real = bucket >= 0
    counts[bucket[real], column[real]] = n[real]
    docs[column[~real]] = n[~real]
    smooth = counts + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(docs / docs.sum()))


def score(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and its probability for each text."""
    if not texts:
        return [], []
    orders, n_letters = grams(texts)
    total = np.tile(model.prior, (len(texts), 1))
    if model.languages:
        for buckets, begin in orders:
            rows = model.weights[buckets]
            for i in np.flatnonzero(begin[1:] > begin[:-1]):
                total[i] += rows[begin[i] : begin[i + 1]].sum(axis=0, dtype=np.float64)
    names, scores = [], []
    for row, n in zip(total / TEMPER, n_letters.tolist(), strict=True):
        if not n or not model.languages:
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        best = int(row.argmax())
        names.append(model.languages[best])
        scores.append(float(1 / np.exp(row - row[best]).sum()))
    return names, scores


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: checksum of the id modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(text: pa.Array) -> list:
            return list(score(model, strings(text)))

        return work

    text = text_col if text_col in keep else "__text"
    docs = pick(df, {**{k: k for k in keep}, text: text_col})
    return map_text(docs, text, list(keep), "lang_pred string, score double", make)
