"""Toxicity by maximum-scoring segments over token log-odds.

Tokens: word characters, lower case. A token's score is its log-odds between toxic and other
training texts under an informative Dirichlet prior (pseudo-counts in proportion to the number
of all training texts that hold the token), less two standard errors and a drift that makes ordinary text
lose score. A rare word takes the score of its longest stem (its first letters) that was seen
often enough, so an inflection that training lacks still counts.

A linear-time scan finds all maximal scoring segments of a document. Their significance follows
the extreme-value law P(S >= x) ~ 1 - exp(-K n exp(-lambda x)) for n tokens, lambda solved from
the score distribution of other text and K fitted to its best segments. The documents' excess
over that law (best segment, and all significant segments together) goes through a logistic
calibration that the training texts fit.

Training: at most ``SAMPLE`` labelled documents (those whose hashed id is least), and of these
only documents that the caller lets through; labels, language, source and id never enter a score.

Defined results: a null text is the empty text and has no segment; its score is that of a
text without evidence. Repeated rows are scored each. Without labels of both kinds every score
is 0. Further columns are ignored by ``scores`` and kept by ``clean_documents``. Empty tables
give no rows. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.common import claim, drop, map_arrow, pick, small_batches, written
from cinderloom.llm.quality import bounded_labels

SAMPLE = 40_000
#: Prefix lengths that stand for a rare word, longest first.
STEMS = (7, 6, 5, 4)
#: Texts that a token or stem needs for a score of its own.
SEEN = 4
#: Pseudo-counts of the prior: a share of the token's own frequency, and the same for all; standard errors taken off; loss of score of any token.
PRIOR, FLAT, ERRORS, DRIFT = 0.001, 0.5, 2.0, 0.75
#: Expected number of such segments in other text, below which a segment is significant.
E_VALUE = 0.05
WORDS_KEPT = 150_000
WORD = re.compile(r"\w+")


def maximal_segments(scores: list[tuple[int, float]], drift: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score), by a linear-time scan.

    scores: positions and positive scores; every other of the n tokens scores -drift.
    """
    # Candidate segments as [first, last, total before it, total through it, index of the last candidate with a smaller total before].
    stack: list[list] = []
    total, before = 0.0, 0
    for at, gain in scores:
        total -= drift * (at - before)
        left, right = total, total + gain
        total, before = right, at + 1
        new = [at, at, left, right, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class _Gains(dict):
    """Positive score of each word; 0 for the rest."""

    def __init__(self, table: dict[str, float], known: set[str]):
        super().__init__()
        self.table, self.known = table, known

    def __missing__(self, word: str) -> float:
        gain = self.table.get(word)
        if gain is None and word not in self.known:
            for k in STEMS:
                if len(word) >= k and (gain := self.table.get(word[:k] + "*")) is not None:
                    break
        gain = max(0.0, gain or 0.0)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = gain
        return gain


@dataclass
class Model:
    """table: score of words, and of stems under their letters and a star; known: words that have a score of their own but no positive one."""

    table: dict[str, float]
    known: set[str] = field(default_factory=set)
    lam: float = 1.0
    k: float = 0.01
    weights: tuple[float, float, float] = (-5.0, 1.0, 1.0)
    gains: _Gains | None = None

    def __getstate__(self):
        return self.__dict__ | {"gains": None}

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments."""
        if self.gains is None:
            self.gains = _Gains(self.table, self.known)
        words = WORD.findall(text.lower())
        gains = list(map(self.gains.__getitem__, words))
        hits = [(i, g) for i, g in enumerate(gains) if g] if any(gains) else []
        return len(words), maximal_segments(hits, DRIFT, len(words)) if hits else []

    def excess(self, n: int, score: float) -> float:
        """-ln of the expected number of segments of that score in n tokens of other text; 0 if one or more are."""
        return max(0.0, self.lam * score - math.log(max(self.k * n, 1e-9)))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        each = [self.excess(n, s) for _, _, s in found]
        return math.log1p(max(each, default=0.0)), math.log1p(sum(e for e in each if e >= -math.log(E_VALUE)))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        a, b = self.evidence(n, found)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _token_counts(sample: DataFrame) -> DataFrame:
    """token, and the toxic and other texts of the sample that hold it; stems carry a star.

    A toxic text counts only as far as it brings a new left neighbour of the token, estimated
    from a 64-bit mask of the neighbours' hashes: neither a word repeated within a text nor
    the copies of one text are more evidence than the first.
    """

    def run(batches):
        claim("toxicity")
        count: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((text or "").lower())
                seen: dict[str, int] = {}
                for word, left in zip(words, ["", *words]):
                    seen[word] = seen.get(word, 0) | 1 << (zlib.crc32(left.encode()) & 63) if label else 0
                for word, mask in list(seen.items()):
                    for k in STEMS:
                        if len(word) >= k:
                            seen[word[:k] + "*"] = seen.get(word[:k] + "*", 0) | mask
                for token, mask in seen.items():
                    n = count.setdefault(token, [0, 0, 0])
                    n[label] += 1
                    n[2] |= mask
            if len(count) > 500_000:
                yield from out(count)
                count = {}
        yield from out(count)

    def out(count):
        rows = list(count.items())
        for lo in range(0, len(rows), 20_000):
            some = rows[lo : lo + 20_000]
            masks = np.array([n[2] for _, n in some], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some]), pa.array([n[1] for _, n in some], pa.int64()), pa.array([n[0] for _, n in some], pa.int64()), pa.array(masks)], ["token", "toxic", "other", "lefts"])

    rows = map_arrow(sample, run, "token string, toxic bigint, other bigint, lefts bigint")
    counts = rows.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_count(F.bit_or("lefts")).alias("lefts"))
    distinct = F.when(F.col("lefts") < 64, -64 * F.log(1 - F.col("lefts") / 64)).otherwise(F.col("toxic").cast("double"))
    return counts.select("token", F.least(distinct, F.col("toxic").cast("double")).alias("toxic"), "other")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, learn_from: Column | None = None) -> Model | None:
    """learn_from: a condition on the labels' doc_id. None if the sample lacks a kind."""
    allowed = labels.where(learn_from) if learn_from is not None else labels
    # At most `bound` rows of two numbers: a size that the parameter proves.
    chosen = F.broadcast(bounded_labels(allowed, label, bound))
    sample = pick(docs, doc_id="doc_id", text="text").join(chosen, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text").where("label in (0, 1)")
    counts = written(_token_counts(sample.select("label", "text")))
    n1, n0 = counts.where(~F.col("token").endswith("*")).agg(F.sum("toxic"), F.sum("other")).first()
    if not n1 or not n0:
        return None
    n = n1 + n0
    y1, y0 = F.col("toxic"), F.col("other")
    prior = (y1 + y0) * PRIOR + FLAT
    delta = F.log((y1 + prior) / (n1 + PRIOR * n - y1 - prior)) - F.log((y0 + prior) / (n0 + PRIOR * n - y0 - prior))
    score = delta - ERRORS * F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)) - DRIFT
    scored = counts.where(y1 + y0 >= SEEN).withColumn("score", score)
    # Only what stands out: words and stems of positive score, and words below such a stem that have a lower one. Bounded by the sample.
    good = scored.where("score > 0").select("token", "toxic", "other", "score").toPandas()
    table = dict(zip(good["token"], good["score"]))
    stems = scored.where("score > 0 and endswith(token, '*')").select(F.col("token").alias("stem"))
    under = F.explode(F.array(*[F.concat(F.substring("token", 1, k), F.lit("*")) for k in STEMS]))
    of_stem = scored.where("score <= 0 and not endswith(token, '*')").select("token", under.alias("stem")).join(stems, "stem", "left_semi")
    known = {r[0] for r in of_stem.select("token").distinct().collect()}
    drop(counts)
    model = Model(table, known)

    # lambda: the root of sum p exp(lambda s) = 1 over the tokens of other text, one pseudo-occurrence for the best score.
    words = good[~good["token"].str.endswith("*")]
    s = np.append(words["score"].to_numpy(float), [max(table.values(), default=1.0), -DRIFT])
    p = np.append(words["other"].to_numpy(float), [1.0, 0.0])
    p[-1] = max(n0 - p.sum(), 1.0)
    p /= p.sum()
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (low, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, high)
    model.lam = min(max(low, 0.05), 5.0)

    def run(batches):
        claim("toxicity")
        for batch in batches:
            found = [model.segments(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([k for k, _ in found], pa.int64()), pa.array([[x for _, _, x in f] for _, f in found], pa.list_(pa.float64()))], ["doc_id", "label", "n", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = map_arrow(sample.select("label", "text", "doc_id"), run, f"doc_id {kind}, label int, n bigint, found array<double>")
    # One row a labelled document, however often its id stands in docs: at most `bound`.
    seen = marked.groupBy("doc_id").agg(F.max(F.struct("label", "n", "found")).alias("x")).select("x.*").toPandas()
    other = seen[seen["label"] == 0]
    x0 = min(table.values(), default=1.0)
    with_segment = sum(len(f) > 0 for f in other["found"])
    model.k = float((with_segment + 1) * math.exp(min(model.lam * x0, 50)) / max(other["n"].sum(), 1))
    x = np.array([(1.0, *model.evidence(int(k), [(0, 0, s) for s in f])) for k, f in zip(seen["n"], seen["found"])])
    y = seen["label"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge-penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-1, 1e-1])
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag(ridge), x.T @ (q - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(map(float, w))
    return model


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and segments: significant passages as first and last token, character span, score and expected number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    segment = pa.list_(pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("first_char", pa.int32()), ("end_char", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def spans(text: str, n: int, found: list) -> list[dict]:
        told = [(a, b, s, e) for a, b, s in found if (e := model.excess(n, s)) >= -math.log(E_VALUE)]
        if not told:
            return []
        at = [m.span() for m in WORD.finditer(text.lower())]
        return [{"first_token": a, "last_token": b, "first_char": at[a][0], "end_char": at[b][1], "score": s, "e_value": math.exp(-e)} for a, b, s, e in told]

    def run(batches):
        claim("toxicity")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [model.segments(t) if model else (0, []) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([model.probability(*f) if model else 0.0 for f in found], pa.float64()),
                    pa.array([spans(t, *f) if f[1] else [] for t, f in zip(texts, found)], segment),
                ],
                ["doc_id", "score", "segments"],
            )

    return map_arrow(pick(docs, doc_id="doc_id", text="text"), run, f"doc_id {kind}, score double, segments array<struct<first_token:int,last_token:int,first_char:int,end_char:int,score:double,e_value:double>>")


def clean_documents(docs: DataFrame, model: Model | None, limit: float = 0.3) -> DataFrame:
    """The documents whose score stays below the limit, with all their columns."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches):
        claim("toxicity")
        for batch in batches:
            keep = [model.probability(*model.segments(t or "")) < limit for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
