"""Quality classifier by importance resampling (hashed n-gram models, Gumbel top-k).

Two generative models over hashed n-grams, one of target text and one of raw text, give every
document the importance log p_target(n-grams) - log p_raw(n-grams). Adding Gumbel noise and
keeping the k largest keys samples k documents without replacement in proportion to their
importance.

n-grams: words and word pairs, and pairs and triples of word shapes (letter case, punctuation,
whether a word repeats the one before), each kind in its own range of buckets.

The target model and the cut are fitted on a bounded sample of labelled documents (``SAMPLE``,
those whose hashed id is least); the raw model counts every document of the table. k is not a
share: it is the number of documents whose importance reaches the cut that best separates the
sample's labels, so it follows the table.

Defined results: a null text is the empty text, which has no n-grams and importance 0. Equal
rows get equal keys and share their fate. Ties at the k-th key all stay. Without labels of both
kinds, or on an empty table, every document stays. Extra columns of any name pass through
``select_documents`` untouched. Long texts count whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.common import cache_of, claim, drop, map_arrow, pick, small_batches, written

#: Buckets of words, word pairs, shape pairs and shape triples.
BUCKETS = (1 << 15, 1 << 16, 1 << 12, 1 << 14)
OFFSETS = np.cumsum((0, *BUCKETS))
TOTAL = int(OFFSETS[-1])
#: Labelled documents to fit on, at most.
SAMPLE = 40_000
#: Pseudo-counts of the target's buckets, on average; they follow the raw model.
PRIOR = 1.0
WORDS_KEPT = 150_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """A word's hash with its shape in the low 8 bits."""

    def __missing__(self, word: str) -> int:
        core = word.strip("\"'.,;:!?()[]{}-*#$%&|_/\\<>=+~^@`")
        case = 0 if not core else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() else 4 if core.isdigit() else 5
        tail = word[len(word.rstrip("\"'.,;:!?()[]{}-*#$%&|_/\\<>=+~^@`")) :]
        mark = 0 if not tail else 1 if tail in (".", ",") else 2 if len(tail) == 1 else 3 + zlib.crc32(tail.encode()) % 28
        value = (zlib.crc32(core.lower().encode()) ^ len(core) << 32) << 8 | case * 32 + mark
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value
        return value


_words = _Words()
cache_of("quality", _words.clear)


def _hash(x: np.ndarray, kind: int) -> np.ndarray:
    """Bucket numbers of a kind's n-grams."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * _M
    bits = BUCKETS[kind].bit_length() - 1
    return (x >> np.uint64(64 - bits)).astype(np.int64) + OFFSETS[kind]


def features(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text."""
    chunks = text.split()
    if not chunks:
        return np.zeros(0, np.int64)
    packed = np.fromiter(map(_words.__getitem__, chunks), np.uint64, len(chunks))
    word, shape = packed >> np.uint64(8), packed & np.uint64(255)
    shape[1:] |= (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(8)
    with np.errstate(over="ignore"):
        two = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]
    shapes = shape[:-1] << np.uint64(9) | shape[1:]
    return np.concatenate([_hash(word, 0), _hash(two, 1), _hash(shapes, 2), _hash(shapes[:-1] << np.uint64(9) | shape[2:], 3)])


@dataclass
class Model:
    """weights: log p_target - log p_raw of each bucket. cut: the importance that separates the sample best."""

    weights: np.ndarray
    cut: float

    def importance(self, text: str) -> float:
        return float(self.weights[features(text)].sum())


def bounded_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """One label (the greatest) for each labelled document, of the bound documents with the least hashed ids."""
    rows = pick(labels, doc_id="doc_id", label=column).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket, over all rows."""

    def run(batches):
        claim("quality")
        total = np.zeros(TOTAL, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, features(text or ""), 1)
        found = np.flatnonzero(total)
        for lo in range(0, len(found), 20_000):
            part = found[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    rows = map_arrow(docs.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TOTAL, np.float64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model | None:
    """The model of docs (doc_id, text); label 1 marks target text. None if the sample lacks a kind."""
    # At most `bound` rows of two numbers: a size that the parameter proves.
    chosen = F.broadcast(bounded_labels(labels, label, bound))
    sample = pick(docs, doc_id="doc_id", text="text").join(chosen, "doc_id").select("label", "text", "doc_id")
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    if not {0, 1} <= kinds:
        return None
    target = _counts(sample.where("label = 1").select("text"))
    raw = _counts(pick(docs, text="text"))
    weights = np.zeros(TOTAL)
    for lo, hi in zip(OFFSETS, OFFSETS[1:]):
        q = raw[lo:hi] + 1e-3
        q /= q.sum()
        mass = PRIOR * (hi - lo)  # the target is smoothed towards the raw model: without evidence the ratio is 1
        weights[lo:hi] = np.log((target[lo:hi] + mass * q) / (target[lo:hi].sum() + mass)) - np.log(q)
    model = Model(weights.astype(np.float32), 0.0)

    def run(batches):
        claim("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([model.importance(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "label", "importance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = map_arrow(sample, run, f"doc_id {kind}, label int, importance double")
    # One row a labelled document, however often its id stands in docs: at most `bound`.
    seen = marked.groupBy("doc_id").agg(F.max(F.struct("label", "importance")).alias("x")).select("x.*").toPandas().sort_values("importance")
    good = (seen["label"] == 1).to_numpy()
    x = seen["importance"].to_numpy()
    # Errors of a cut before each position: share of good ones below it and of others from it on, each kind weighing the same.
    wrong = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    at = int(best[np.argmax(edges[best + 1] - edges[best])])
    model.cut = float((edges[at] + edges[at + 1]) / 2)
    return model


def gumbel(doc_id, text: str, seed: int) -> float:
    """Standard Gumbel noise that a row's content decides, so that a recomputed task repeats it."""
    h = zlib.crc32(text.encode(), zlib.crc32(f"{seed}:{doc_id}".encode()))
    h = (h * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1
    u = ((h ^ h >> 31) & (1 << 52) - 1 | 1) / (1 << 52)
    return -float(np.log(-np.log(u)))


def scores(docs: DataFrame, model: Model, seed: int = 7) -> DataFrame:
    """doc_id, log_ratio and gumbel_key of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        claim("quality")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            ratio = [model.importance(t) for t in texts]
            key = [r + gumbel(i, t, seed) for r, i, t in zip(ratio, ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio, pa.float64()), pa.array(key, pa.float64())], ["doc_id", "log_ratio", "gumbel_key"])

    return map_arrow(pick(docs, doc_id="doc_id", text="text"), run, f"doc_id {kind}, log_ratio double, gumbel_key double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value (of k or more rows), by counting in ever finer bins; at most `bins` counts reach the driver at once."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        seen = 0
        for b, n, least, most in inside.groupBy(at.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).orderBy(F.desc("bin")).collect():
            if seen + n >= k:
                k, low, high = k - seen, least, most
                break
            seen += n
    if low == high:
        return low
    values = sorted((r[0] for r in rows.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(column).count().orderBy(F.desc(column)).limit(k).collect()), reverse=True)
    return values[-1]


def sampled(docs: DataFrame, model: Model, seed: int = 7) -> DataFrame:
    """The rows of scores() that Gumbel top-k keeps, k being the number of rows whose importance reaches the cut."""
    rows = written(scores(docs, model, seed))
    k = rows.where(F.col("log_ratio") >= model.cut).count()
    return rows.where(F.col("gumbel_key") >= kth_largest(rows, "gumbel_key", k)) if k else rows.where(F.lit(False))


def select_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 7) -> DataFrame:
    """The documents that the sampling keeps, with all their columns: the same decision for the same row, so texts need no shuffle."""
    model = fit(docs, labels, label)
    if model is None:
        return docs
    rows = written(scores(docs, model, seed))
    k = rows.where(F.col("log_ratio") >= model.cut).count()
    if not k:
        drop(rows)
        return docs.where(F.lit(False))
    least = kth_largest(rows, "gumbel_key", k)
    drop(rows)
    small_batches(docs.sparkSession)
    where_id, where_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        claim("quality")
        for batch in batches:
            ids, texts = batch.column(where_id).to_pylist(), [t or "" for t in batch.column(where_text).to_pylist()]
            yield batch.filter(pa.array([model.importance(t) + gumbel(i, t, seed) >= least for i, t in zip(ids, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
