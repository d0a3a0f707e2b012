"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one closed vocabulary, the token ids of a public
BPE file, so every text has a probability under both. A document's score is the mean over its
tokens of the target loss less the background loss; the lower, the more like the target text.

Both models are matched: the same order, vocabulary and smoothing, and the background counts
are scaled to the target's number of tokens, so smoothing weighs the same. Token, context and
pair counts are exact and cover every document; the target text is that of every document
labelled 1 (of several labels the greatest counts). The probabilities of a context sum to 1.

Pair counts stay a distributed table, which grows with the corpus. Documents are scored in
chunks of about ``CHUNK`` tokens: a chunk asks the table for its own distinct pairs and gets
their counts, so a worker holds no more than a chunk's pairs, whatever the corpus. Only token
and context counts, at most 2 V + 1 numbers in each model, go to the driver and all workers.

p(w | u) = (pairs(u, w) + MU p(w)) / (contexts(u) + MU), p(w) = (tokens(w) + ALPHA) / (tokens + ALPHA V)

Defined results: a null text is the empty text; without tokens losses and score are 0. Repeated
rows are counted and scored each. Without target documents all target counts are 0 and the
model is uniform. An empty table gives no rows. Further columns are ignored. Texts count whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm import word_tokens
from cinderloom.llm.common import map_arrow, pick, written

MU, ALPHA = 20.0, 0.5
#: Tokens of a chunk, a longer document being one of its own.
CHUNK = 2_000_000


def id_type(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, vocab_path: str, target: Column, chunk: int = CHUNK) -> DataFrame:
    """doc_id, target flag, ids (16 bits each where the vocabulary allows) and chunk of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = id_type(word_tokens.encoder(vocab_path).library.get_vocab_size())

    def run(batches):
        encoder = word_tokens.encoder(vocab_path)
        at, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            found = [np.frombuffer(encoder.ids(t or ""), "<u4") for t in batch.column(2).to_pylist()]
            ids, chunks = [x.astype(width).tobytes() for x in found], []
            for x in found:
                if held + len(x) > chunk and held:
                    at, held = at + 1, 0
                held += len(x)
                chunks.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(chunks, pa.int64())], ["doc_id", "target", "ids", "chunk"])

    return map_arrow(pick(docs, doc_id="doc_id", target=target, text="text"), run, f"doc_id {kind}, target boolean, ids binary, chunk bigint")


def pairs(ids: np.ndarray, vocab: int) -> np.ndarray:
    """A number for each token and the one before it (``vocab`` at the start): context (vocab + 1) + token."""
    left = np.empty(len(ids), np.int64)
    left[:1] = vocab
    left[1:] = ids[:-1]
    return left * (vocab + 1) + ids


def pair_counts(encoded: DataFrame, vocab: int) -> DataFrame:
    """chunk, pair, n, target: how often a chunk has a pair, in all its documents and in the target's."""

    def run(batches):
        def sums(chunk: int, parts: list[tuple[bool, np.ndarray]]):
            found, at = np.unique(np.concatenate([p for _, p in parts]), return_inverse=True)
            marked = np.concatenate([np.full(len(p), t) for t, p in parts])
            for lo in range(0, len(found), 50_000):
                some = slice(lo, lo + 50_000)
                n, t = np.bincount(at, minlength=len(found))[some], np.bincount(at, marked, len(found))[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(found[some]), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], ["chunk", "pair", "n", "target"])

        held: list[tuple[bool, np.ndarray]] = []
        last = None
        for batch in batches:
            for flag, raw, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != last and held:
                    yield from sums(last, held)
                    held = []
                last = chunk
                held.append((bool(flag), pairs(np.frombuffer(raw, id_type(vocab)), vocab)))
        if held:
            yield from sums(last, held)

    return map_arrow(encoded.select("target", "ids", "chunk"), run, "chunk bigint, pair bigint, n bigint, target bigint")


class Model:
    """token: p(w). context: count(u) + MU, from the sums over pairs."""

    def __init__(self, token: np.ndarray, context: np.ndarray, scale: float = 1.0):
        self.scale = scale
        self.token = (token * scale + ALPHA) / (token.sum() * scale + ALPHA * len(token))
        self.context = context * scale + MU

    def losses(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        left, right = np.divmod(pair, len(self.token) + 1)
        return np.log(self.context[left]) - np.log(count * self.scale + MU * self.token[right])


def fit(totals: DataFrame, vocab: int) -> tuple[Model, Model]:
    """Target and background model of the pairs' totals (pair, n, target)."""

    def by(key: Column, size: int) -> np.ndarray:
        # At most V + 1 rows, a fixed number.
        rows = totals.groupBy(key.cast("int").alias("k")).agg(F.sum("target").alias("t"), F.sum("n").alias("n")).toPandas()
        out = np.zeros((2, size))
        out[:, rows["k"].to_numpy()] = rows[["t", "n"]].to_numpy().T
        return out

    token, context = by(F.col("pair") % (vocab + 1), vocab), by(F.floor(F.col("pair") / (vocab + 1)), vocab + 1)
    n = token.sum(1)
    return Model(token[0], context[0]), Model(token[1], context[1], n[0] / n[1] if n.all() else 1.0)


def score(docs: DataFrame, labels: DataFrame, vocab_path: str, label: str = "quality") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token, natural logarithm) and score, their difference."""
    chosen = pick(labels, chosen="doc_id", label=label).dropna().groupBy("chosen").agg(F.max("label").alias("label")).where("label = 1").select("chosen")
    # Labels grow with the documents: both sides are shuffled at every size, and a hot id's partition can be split.
    flagged = pick(docs, doc_id="doc_id", text="text").join(chosen.hint("merge"), F.col("doc_id") == F.col("chosen"), "left")
    encoded = written(tokens(flagged, vocab_path, F.col("chosen").isNotNull()))
    vocab = word_tokens.encoder(vocab_path).library.get_vocab_size()
    counts = written(pair_counts(encoded, vocab))
    totals = written(counts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("target").alias("target")))
    models = docs.sparkSession.sparkContext.broadcast(fit(totals, vocab))
    kind = encoded.schema["doc_id"].dataType

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        target, background = models.value
        known, first = np.unique(asked.column("pair").to_numpy(), return_index=True)
        n, t = asked.column("n").to_numpy()[first], asked.column("target").to_numpy()[first]
        # The loss of every pair of the chunk, once.
        a, b = target.losses(known, t), background.losses(known, n)
        out = []
        for raw in mine.column("ids").to_pylist():
            at = np.searchsorted(known, pairs(np.frombuffer(raw, id_type(vocab)), vocab))
            size = max(1, len(at))
            x, y = float(a[at].sum()) / size, float(b[at].sum()) / size
            out.append((len(at), x, y, x - y))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([mine.column("doc_id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    asked = counts.select("chunk", "pair").join(totals, "pair")
    return encoded.select("doc_id", "ids", "chunk").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double")
