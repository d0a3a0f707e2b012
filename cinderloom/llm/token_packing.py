"""Token-id output: best-fit-decreasing packing into fixed-length id matrices.

Documents become ids and one end id; longer ones are split losslessly into full pieces and a
rest. Pieces are packed a window at a time, longest first, each into the bin with the least
room that holds it; a segment tree over remaining capacities finds that bin in log(length)
steps. A packed row is one matrix row of ids (little-endian unsigned 32-bit, padded), with the
cumulative segment lengths, position numbers that restart with every segment, and the segments'
documents, so the ids of every document can be read back.

Defined results: a null text is the empty text, whose document is the end id alone. Repeated
rows are packed each. Of bins with equal room the one that reached it last is taken; among
pieces of equal length the earlier comes first. An empty table gives no rows. Further columns
are ignored.

Scale: tokens never cross a shuffle. Each task packs its own part of the table in windows of
bounded tokens, so memory does not follow the input, and a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from cinderloom.llm import word_tokens
from cinderloom.llm.common import map_arrow, pick

CAPACITY = 2048
#: Tokens that a task packs at once.
WINDOW_TOKENS = 4_000_000


class CapacityTree:
    """Counts of bins by remaining capacity in a segment tree; the leftmost leaf from a size on is the best fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin with the least room that is at least so much, and that room; the bin leaves the tree."""
        count, i = self.count, least + self.size
        # Climb until a subtree to the right (or the leaf itself) has bins, then descend to its leftmost leaf.
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The items of each bin, in the order they were placed."""
    tree, out = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if (found := tree.take(n)) is None:
            name, room = len(out), capacity
            out.append([])
        else:
            name, room = found
        out[name].append(i)
        if room > n:
            tree.add(room - n, name)
    return out


def _segment(kind: pa.DataType) -> pa.DataType:
    return pa.struct([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])


def packed(docs: DataFrame, vocab_path: str, end_id: int = 0, pad_id: int = 0, capacity: int = CAPACITY, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids, positions (unsigned 16-bit), cu_seqlens, segments."""
    if not 0 < capacity < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 tokens")

    kind = docs.select(doc_id).schema[0].dataType
    arrow = to_arrow_type(kind)

    def rows(window: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        bins = best_fit_decreasing([len(x[3]) // 4 for x in window], capacity)
        steps = np.arange(capacity, dtype="<u2")
        pad = pad_id.to_bytes(4, "little")
        for lo in range(0, len(bins), 256):
            some = bins[lo : lo + 256]
            ids, positions, ends, segments = [], [], [], []
            for items in some:
                sizes = [len(window[i][3]) // 4 for i in items]
                ends.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                spare = capacity - int(ends[-1][-1])
                ids.append(b"".join([*(window[i][3] for i in items), pad * spare]))
                positions.append(b"".join([steps[:n].tobytes() for n in (*sizes, spare)]))
                segments.append([{"doc_id": window[i][0], "piece": window[i][1], "start": window[i][2], "length": n} for i, n in zip(items, sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(lo, lo + len(some), dtype=np.int64) + first), pa.array([int(e[-1]) for e in ends], pa.int32()), pa.array(ids, pa.binary()),
                    pa.array(positions, pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(segments, pa.list_(_segment(arrow))),
                ],
                ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "segments"],
            )

    def run(batches):
        encoder = word_tokens.encoder(vocab_path)
        last, width = end_id.to_bytes(4, "little"), 4 * capacity
        part = TaskContext.get().partitionId() << 40
        window, tokens, done = [], 0, 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(body or "") + last
                window += [(doc, k, at // 4, ids[at : at + width]) for k, at in enumerate(range(0, len(ids), width))]
                tokens += len(ids) // 4
                if tokens >= WINDOW_TOKENS:
                    for out in rows(window, part + done):
                        done += out.num_rows
                        yield out
                    window, tokens = [], 0
        if window:
            yield from rows(window, part + done)

    schema = f"sequence_id bigint, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, segments array<struct<doc_id:{kind.simpleString()},piece:int,start:bigint,length:int>>"
    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, schema)


def write_packed(sequences: DataFrame, path: str) -> None:
    """Write the rows of packed() as Parquet shards: the column ids of a shard is its id matrix, row after row."""
    sequences.write.option("compression", "zstd").parquet(path)


def unpacked(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start and ids of every segment, read back from the matrices."""
    kind = sequences.schema["segments"].dataType.elementType["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            out = []
            for ids, ends, segments in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += [(s["doc_id"], s["piece"], s["start"], ids[4 * a : 4 * b]) for s, a, b in zip(segments, ends, ends[1:])]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow, pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "ids"])

    return map_arrow(sequences.select("ids", "cu_seqlens", "segments"), run, f"doc_id {kind.simpleString()}, piece int, start bigint, ids binary")
