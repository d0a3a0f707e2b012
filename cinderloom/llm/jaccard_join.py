"""n-gram Jaccard self-join by chosen paths.

A document is its set of hashed shingles of five words (lower case). Documents of equal sets
are copies and form one class, which takes part once. In every run each set picks tokens whose
seeded hash falls below 1 / (0.8 |set|) - sets that share a token tend to pick the same - and
splits by them into buckets; buckets over ``LIMIT`` split again by tokens sampled anew, up to
``DEPTH`` times, and the rest is compared by brute force. A pair of similarity 0.8 meets in a
run with probability at least 1 - exp(-p), p being that of the level above (1 at the top): 0.37
at depth 3, so ``runs_for`` repeats runs until the target recall. More similar pairs meet more often.

Within buckets, set sizes and 64 one-byte minhashes filter pairs; each pair is taken up only in
the first bucket that both documents share, and there verified exactly on the sets. No pair is
written: tasks emit link counts per document and a spanning forest of the links. Large buckets
are dealt in blocks against blocks, each block pair to its own task, so no bucket has a cap.

Defined results: a null text is the empty text. A text of one to four words is one shingle; a
text without words is in no class and has no links. Repeated rows are copies of each other.
Ids are of any type that Spark orders. Rows with a null doc_id take no part: their class is null and they have 0 links. Similarity is
at least 0.8, the bound included. An empty table gives no rows. Further columns are ignored by
``links`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.llm.common import cache_of, claim, drop, map_arrow, pick, small_batches, whole_groups, written
from cinderloom.llm.components import connected_components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Members of a bucket that are compared directly; times that larger ones split; members of a block.
LIMIT, DEPTH, CHUNK = 128, 3, 512
SKETCH = 64
#: Agreeing minhashes that a pair needs: four standard errors below the threshold.
AGREE = math.floor(SKETCH * (THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)))
WORD = re.compile(r"\w+")
WORDS_KEPT = 150_000


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the given probability."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


RUNS = runs_for(RECALL)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
cache_of("jaccard", _hashes.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_seeds = mix(np.arange(1, 1000, dtype=np.uint64))
_RUN_SEEDS, _SKETCH_SEEDS = _seeds[:200, None], _seeds[200 : 200 + SKETCH, None] | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The sorted set of hashed shingles."""
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    out = h[: n - size + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i]
    return np.unique(mix(out))


def sketch(s: np.ndarray) -> bytes:
    """One byte of each of 64 minhashes."""
    best = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 2048):
            part = s[None, lo : lo + 2048] * _SKETCH_SEEDS
            np.minimum(best, (part ^ (part >> np.uint64(32))).min(1), out=best)
    return (mix(best) & np.uint64(255)).astype(np.uint8).tobytes()


def _picks(s: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of seeds: which row picked a token, and the path from there."""
    least = np.uint64(min((1 << 64) - 1, int((1 << 64) / (THRESHOLD * len(s)))))
    which, path = [], []
    step = max(1, 200_000 // len(s))
    for lo in range(0, len(seeds), step):
        h = mix(s[None] ^ seeds[lo : lo + step])
        row, at = np.nonzero(h <= least)
        which.append(row + lo)
        path.append(mix(h[row, at] ^ seeds[lo + row, 0]))
    return np.concatenate(which), np.concatenate(path)


def paths(s: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chosen paths of each depth, with the index of their prefix in the depth before (the run at depth 1)."""
    out, seeds = [], _RUN_SEEDS[:runs]
    for _ in range(DEPTH):
        parent, path = _picks(s, seeds) if len(seeds) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        out.append((parent, path))
        seeds = path[:, None]
    return out


SIGNATURE = "doc_id {kind}, text_hash bigint, k1 bigint, k2 bigint, n int, sketch binary, p1 array<bigint>, p2 array<struct<prefix:bigint,path:bigint>>, p3 array<struct<prefix:bigint,path:bigint>>"
_LINK = pa.list_(pa.struct([("prefix", pa.int64()), ("path", pa.int64())]))


def signatures(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """Set name (k1, k2), size, sketch and paths of every row; nulls for rows without an id or a word."""

    def long(x: np.ndarray) -> np.ndarray:
        return x.view(np.int64)

    def run(batches):
        claim("jaccard")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                s = shingles(text or "")
                if doc is None or not len(s):
                    rows.append((None,) * 7)
                    continue
                name = xxhash.xxh3_128_digest(s.tobytes())
                tree = paths(s, runs)
                levels = [long(p) for _, p in tree]
                below = [[{"prefix": a, "path": b} for a, b in zip(levels[d - 1][tree[d][0]].tolist(), levels[d].tolist())] for d in (1, 2)]
                rows.append((int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), len(s), sketch(s), levels[0].tolist(), *below))
            c = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), _LINK, _LINK)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(c, types))], ["doc_id", "text_hash", "k1", "k2", "n", "sketch", "p1", "p2", "p3"])

    return map_arrow(pick(docs, doc_id="doc_id", text_hash=F.xxhash64("text"), text="text"), run, SIGNATURE.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def buckets(classes: DataFrame) -> DataFrame:
    """k1, leaf, size: the final buckets of every class, those with two members or more."""

    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"), "leaf")

    found = counted(classes.select("k1", F.explode("p1").alias("leaf")))
    out = None
    for depth in range(1, DEPTH + 1):
        found = written(found.select("k1", "leaf", "size"))
        small = found if depth == DEPTH else found.where(F.col("size") <= LIMIT)
        out = small if out is None else out.unionByName(small)
        if depth < DEPTH:
            large = found.where(F.col("size") > LIMIT).select("k1", F.col("leaf").alias("prefix"))
            links = classes.select("k1", F.explode(f"p{depth + 1}").alias("link")).select("k1", "link.prefix", "link.path")
            found = counted(links.join(large, ["k1", "prefix"]).select("k1", F.col("path").alias("leaf")).distinct())
    return out


def _pairs(starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each group; all groups of one size at once, a bounded number of pairs at a time."""
    begin, size = np.array(starts[:-1]), np.diff(starts)
    for m in np.unique(size).tolist():
        if m < 2:
            continue
        groups = begin[size == m]
        rows = max(1, 2_000_000 // (m * m))
        if m > 1500:
            for g in groups.tolist():
                for i in range(g, g + m - 1):
                    yield np.full(g + m - 1 - i, i), np.arange(i + 1, g + m)
            continue
        a, b = np.triu_indices(m, 1)
        for lo in range(0, len(groups), rows):
            g = groups[lo : lo + rows, None]
            yield (g + a).ravel(), (g + b).ravel()


class _Members:
    """Columns of bucket members that both passes compare."""

    def __init__(self, table: pa.Table):
        self.leaf, self.i, self.j = (table.column(c).to_numpy() for c in ("leaf", "i", "j"))
        self.k1, self.n, self.block = (table.column(c).to_numpy() for c in ("k1", "n", "block"))
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        self.table = table
        self._leaves: dict[int, tuple[list, set]] = {}

    def leaves(self, i: int) -> tuple[list, set]:
        found = self._leaves.get(i)
        if found is None:
            x = self.table.column("leaves")[i].as_py()
            found = self._leaves[i] = (x, set(x))
        return found

    def candidates(self, starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that sizes and sketches let through, in the first bucket that they share."""
        for a, b in _pairs(starts):
            # In a block against another, pairs within one block belong to another task.
            cross = (self.i[a] == self.j[a]) | (self.block[a] != self.block[b])
            near = np.minimum(self.n[a], self.n[b]) >= THRESHOLD * np.maximum(self.n[a], self.n[b]) - 1e-9
            ok = np.flatnonzero(cross & near)
            a, b = a[ok], b[ok]
            keep = [np.zeros(0, bool)]
            for lo in range(0, len(a), 65_536):
                keep.append((self.sketch[a[lo : lo + 65_536]] == self.sketch[b[lo : lo + 65_536]]).sum(1) >= AGREE)
            ok = np.flatnonzero(np.concatenate(keep))
            a, b = a[ok], b[ok]
            first = np.empty(len(a), bool)
            for t, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                own, other = self.leaves(x)[0], self.leaves(y)[1]
                first[t] = next(z for z in own if z in other) == self.leaf[x]
            yield a[first], b[first]


KEYS = ("leaf", "i", "j")


def _dealt(members: DataFrame, *more: str) -> DataFrame:
    """Rows of a bucket, or of two blocks of a large one, sorted together."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "k1").select(*KEYS, "k1", "n", "block", "sketch", "leaves", *more)


def _taking_part(members: DataFrame) -> DataFrame:
    """leaf, i, j, k1 of members with a pair to verify there."""

    def run(batches):
        claim("jaccard")
        for table, starts in whole_groups(batches, 3):
            m = _Members(table)
            used = np.zeros(table.num_rows, bool)
            for a, b in m.candidates(starts):
                used[a] = used[b] = True
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(m.leaf[at]), pa.array(m.i[at]), pa.array(m.j[at]), pa.array(m.k1[at])], [*KEYS, "k1"])

    small_batches(members.sparkSession)
    return _dealt(members).mapInArrow(run, "leaf bigint, i int, j int, k1 bigint")


def _once(table: pa.Table) -> tuple[pa.Table, list[int]]:
    """Whole groups sorted by their keys and k1, without rows that repeat these, and the groups' starts and end."""
    columns = [table.column(c).to_numpy() for c in (*KEYS, "k1")]
    new = np.ones((4, table.num_rows), bool)
    for k, c in enumerate(columns):
        new[k, 1:] = c[1:] != c[:-1]
    keep = new.any(0)
    starts = np.flatnonzero(new[:3].any(0)[keep]).tolist()
    return table.filter(pa.array(keep)), [*starts, int(keep.sum())]


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    used = np.unique(np.concatenate([a, b]))
    if len(a) > 8 * len(used) and len(used) <= 2 * CHUNK:
        # Many pairs among few sets: products of incidence blocks, over tokens that two sets or more hold.
        row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
        token, column, seen = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
        number = np.cumsum(seen > 1) - 1
        ok = seen[column] > 1
        row, column = row[ok], number[column[ok]]
        out = np.zeros((len(used), len(used)), np.float32)
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            u, v = np.searchsorted(column, [lo, lo + 4096])
            block = np.zeros((len(used), 4096), np.float32)
            block[row[u:v], column[u:v] - lo] = 1
            out += block @ block.T
        return out[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for t, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        s, big = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
        at = np.searchsorted(big, s)
        at[at == len(big)] = 0
        out[t] = (big[at] == s).sum()
    return out


def _verified(members: DataFrame) -> DataFrame:
    """a, b, links: link counts of classes (b null; in documents), and edges of a spanning forest (links 0)."""

    def run(batches):
        claim("jaccard")
        for table, _ in whole_groups(batches, 3):
            table, starts = _once(table)
            m = _Members(table)
            weight = table.column("copies").to_numpy()
            texts = table.column("text")
            sets: dict[int, np.ndarray] = {}

            def set_of(i):
                if i not in sets:
                    sets[i] = shingles(texts[i].as_py() or "")
                return sets[i]

            links = np.zeros((2, table.num_rows), np.int64)
            parent = list(range(table.num_rows))

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            edges = []
            for a, b in m.candidates(starts):
                if not len(a):
                    continue
                # One group at a time at most is large; its sets are let go afterwards.
                own = {i: set_of(i) for i in {*a.tolist(), *b.tolist()}}
                both = _overlaps(own, a, b)
                good = 10 * both >= 8 * (m.n[a].astype(np.int64) + m.n[b] - both)
                a, b = a[good], b[good]
                np.add.at(links[0], a, weight[b])
                np.add.at(links[0], b, weight[a])
                np.add.at(links[1], a, 1)
                np.add.at(links[1], b, 1)
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((m.k1[x], m.k1[y]))
            at = np.flatnonzero(links[1])
            u, v = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(m.k1[at]), pa.array(u)]), pa.concat_arrays([none, pa.array(v)]), pa.array(np.concatenate([links[0, at], np.zeros(len(u), np.int64)])), pa.array(np.concatenate([links[1, at], np.zeros(len(u), np.int64)]))],
                ["a", "b", "links", "class_links"],
            )

    small_batches(members.sparkSession)
    return _dealt(members, "copies", "text").mapInArrow(run, "a bigint, b bigint, links bigint, class_links bigint")


def links(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id, group_id, n_links, n_class_links, stays.

    class_id: the least id among the documents of the same shingle set. group_id: the least id
    of all that links connect. n_links: the other documents at similarity 0.8 or more (copies
    included); n_class_links: the other classes. stays: whether it is its group's one document
    (the least id; of several texts under that id, one).
    """
    if not 0 < runs <= len(_RUN_SEEDS):
        raise ValueError(f"there are 1 to {len(_RUN_SEEDS)} runs")
    every = written(signatures(docs, runs))
    signed = every.where("k1 is not null")
    named = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = written(
        signed.join(named, ["k1", "k2"]).where("doc_id = class_id").dropDuplicates(["k1", "k2"]).select("k1", "k2", "class_id", "text_hash", "copies", "n", "sketch", "p1", "p2", "p3")
    )
    found = buckets(classes)
    # A class has some 13 buckets at depth 1 and fewer as they split; the first shared one takes a pair up.
    leaves = found.groupBy("k1").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    members = written(
        found.join(leaves, "k1")
        .join(classes.select("k1", "n", "sketch", "copies", "class_id", "text_hash"), "k1")
        .withColumn("blocks", F.ceil(F.col("size") / CHUNK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("k1", "leaf"), F.col("blocks")).cast("int"))
        # A small bucket is one task's; of a large one each block meets every block, itself included.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k1", "n", "sketch", "leaves", "copies", "class_id", "text_hash")
    )
    part = members.join(_taking_part(members), [*KEYS, "k1"])
    texts = pick(docs, class_id="doc_id", text_hash=F.xxhash64("text"), text="text")
    seen = written(_verified(part.join(texts, ["class_id", "text_hash"])))
    drop(members)
    counts = seen.where("b is null").groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    groups = connected_components(seen.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    per_class = classes.select("k1", "k2", "class_id", "copies").join(groups.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    first = per_class.groupBy("component").agg(F.min(F.struct("class_id", "k1")).alias("first"))
    per_class = per_class.join(first, "component").join(counts, "k1", "left").select(
        "k1",
        "k2",
        "class_id",
        F.col("first.class_id").alias("group_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("class_links", F.lit(0)).alias("n_class_links"),
        (F.col("first.k1") == F.col("k1")).alias("heads"),
    )
    return every.select("doc_id", "text_hash", "k1", "k2").join(per_class, ["k1", "k2"], "left").select(
        "doc_id",
        "text_hash",
        "class_id",
        "group_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"),
        (F.col("k1").isNull() | (F.col("heads") & (F.col("doc_id") == F.col("group_id")))).alias("stays"),
    )


def one_of_each(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The documents of docs with all their columns, one of each group; rows that repeat an id and a text go too.

    Rows with a null id or no word all stay.
    """
    gone = links(docs, runs).where("not stays").select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(F.struct("*").alias("r"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("h")).join(gone, ["k", "h"], "left_anti")
    again = F.row_number().over(Window.partitionBy("k", "h").orderBy("k"))
    return rows.withColumn("again", again).where("again = 1 or k is null").select("r.*")
