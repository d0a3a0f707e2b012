"""Exact top-k by integer inner product with MaxScore.

Vectors become integers, floor(scale * x). A query's terms are its non-zero dimensions with
their sign; the postings of a term are a shard's vectors whose component in the dimension has
the same sign (only they gain), highest first, and its score bound is |q| times the largest
such component. Terms are sorted by bound. The non-essential ones are the longest tail of low
bounds whose sum stays below the threshold (the k-th best score so far): a vector found in no
essential posting can't reach it. Essential postings are traversed, the remaining terms probed
while a vector's gains and open bounds still reach the threshold, and survivors get their
losses (components of opposite sign) for the exact score. Shards merge by score.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
neither do null ids. A query never returns its own row (rows of the same id). Ties go to the
smaller id. Repeated ids stand for one vector each and are all candidates. Fewer candidates
than k give fewer rows. Vectors of another length than the query's are no candidates for it.
Further columns are ignored. Scores are 64-bit: vectors whose scores might not fit raise.

Scale: the stated query set goes against all rows. A task indexes one shard of a bounded number
of rows, which the shuffle brings once, and the queries stream past it a batch at a time; a
query gives at most k rows a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.llm.common import map_arrow, pick

#: Rows of a shard.
SHARD = 8192


def _largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class Shard:
    """Candidates' integer vectors with an index of postings by dimension and sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.largest = _largest(vectors)
        dims = vectors.shape[1]
        self.postings: list[dict[int, np.ndarray]] = []
        self.bounds = np.zeros((dims, 2), np.int64)
        for d in range(dims):
            c = self.columns[d]
            plus, minus = np.flatnonzero(c > 0), np.flatnonzero(c < 0)
            self.postings.append({1: plus[np.argsort(-c[plus], kind="stable")], -1: minus[np.argsort(c[minus], kind="stable")]})
            self.bounds[d] = c.max(initial=0), -c.min(initial=0)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the k best candidates and their scores, best first."""
        n = len(self.ids)
        others = self.ids != query_id
        dims = np.flatnonzero(q)
        sign = (q[dims] < 0).astype(np.int64)
        bound = np.abs(q[dims]) * self.bounds[dims, sign]
        by = np.argsort(-bound, kind="stable")
        dims, bound = dims[by], bound[by]
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])  # bound of the terms from here on
        # A first threshold: exact scores of the heads of the strongest postings.
        heads = np.unique(np.concatenate([self.postings[d][1 if q[d] > 0 else -1][: 8 * k] for d in dims[:6]] or [np.zeros(0, np.int64)]))
        heads = heads[others[heads]]
        least = -(1 << 62)
        if len(heads) >= k:
            least = int(np.partition(self.vectors[heads] @ q, -k)[-k])
        if least > 0:
            essential = int(np.searchsorted(-rest, -least, side="right"))  # terms from `essential` on can't reach it alone
            touched = np.zeros(n, bool)
            for d in dims[:essential]:
                touched[self.postings[d][1 if q[d] > 0 else -1]] = True
                if touched.all():
                    break
            alive = np.flatnonzero(touched & others)
        else:  # a score of 0 or less may be among the best: every row competes
            alive = np.flatnonzero(others)
        gain = np.zeros(len(alive), np.int64)
        step = 8
        for lo in range(0, len(dims), step):
            some = dims[lo : lo + step]
            part = self.columns[some][:, alive] * q[some, None]
            gain += np.maximum(part, 0).sum(0)
            reach = gain + rest[min(lo + step, len(dims))] >= least
            if not reach.all():
                alive, gain = alive[reach], gain[reach]
            if len(alive) <= 4 * k:
                break
        score = self.vectors[alive] @ q
        best = np.lexsort((self.ids[alive], -score))[:k]
        return alive[best], score[best]


def quantised(vectors: Column, scale: float) -> Column:
    """Integer vector, or null if it takes no part."""
    good = vectors.isNotNull() & F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vectors, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: Column | str = "vec_id", vector: Column | str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all rows but its own. is_query is a condition on vec_id."""
    vectors = pick(rows, vec_id=vec_id, v=vector).where(F.col("vec_id").isNotNull()).select("vec_id", quantised(F.col("v"), scale).alias("v")).where("v is not null")
    shards = max(1, -(-vectors.count() // shard))
    candidates = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("s"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = vectors.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(1).alias("kind"), "vec_id", "v")
    # A shard's candidates come first, then all queries.
    dealt = candidates.unionAll(queries).repartition(shards, "s").sortWithinPartitions("s", "kind", "vec_id")

    def arrays(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids and matrix of the rows of each vector length."""
        ids, v = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        flat, ends = v.values.to_numpy(), v.offsets.to_numpy()
        sizes = np.diff(ends)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            yield ids[at], flat[ends[at][:, None] + np.arange(size)]

    def search(batches):
        at, held, index = None, [], {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            s, kind = table.column("s").to_numpy(), table.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(s)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if s[lo] != at:
                    at, held, index = s[lo], [], {}
                part = table.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if held:
                    index = {v.shape[1]: Shard(i, v) for i, v in arrays(pa.concat_tables(held))}
                    held = []
                out: list[tuple[int, int, int]] = []
                for ids, vectors in arrays(part):
                    if (found := index.get(vectors.shape[1])) is None:
                        continue
                    # Python's integers: the product of two bounds may not fit 64 bits itself.
                    if vectors.size and vectors.shape[1] * _largest(vectors) * found.largest >= 1 << 62:
                        raise ValueError("scores of these vectors may not fit 64 bits")
                    for i, q in zip(ids.tolist(), vectors):
                        which, score = found.top(i, q, k)
                        out += [(i, c, x) for c, x in zip(found.ids[which].tolist(), score.tolist())]
                columns = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    parts = map_arrow(dealt, search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
