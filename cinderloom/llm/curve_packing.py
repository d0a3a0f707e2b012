"""Packing along a space-filling curve: documents that are alike share sequences.

A document is its ids and one end id. Its hashed vector (counts of ids by hash bucket, as shares
of its length) is projected by a seeded normal matrix to ``DIMENSIONS`` numbers, whose ``BITS``
bit cells give a key on the Hilbert curve: neighbours on the curve are neighbours in space. The
table is range-sorted by that key, and each range is one stream of tokens that fills sequences
one after the other; a document is cut only where a sequence ends. What a range leaves over at its
end goes to sequences of powers of two, largest first, so no sequence is padded.

Defined results: a null text is the empty text, whose document is the end id alone. Repeated rows
are packed each. Equal keys are ordered by a hash of document and ids, then by id and ids, so a
group of copies of any size spreads over ranges. An empty table gives no rows. Further columns are
ignored. Texts of any length are cut losslessly.

Scale: documents are tokenised once and written with their keys to the shared folder, ids in two
bytes where the vocabulary allows. The range sort is the one shuffle; its sampling reads that table. A
task streams its range and holds one batch and one open sequence. A recomputed task gives the
same rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm import word_tokens
from cinderloom.llm.common import map_arrow, pick, written

CAPACITY = 4096
#: Hash buckets of a vector, numbers that are left of it, bits of each; numbers lie within SPAN of 0.
BUCKETS, DIMENSIONS, BITS, SPAN = 4096, 4, 15, 4.0


@lru_cache(4)
def projection(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = 13) -> np.ndarray:
    """The projection of one occurrence of each id: its bucket's row of the normal matrix."""
    bucket = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return np.random.default_rng(seed).standard_normal((BUCKETS, dimensions)).astype(np.float32)[bucket.astype(np.int64)]


def vectors(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Projected hashed vector of each document; ids are all documents' ids, none without any."""
    sizes = np.diff(np.append(starts, len(ids)))
    return np.add.reduceat(table[ids], starts, axis=0) / sizes[:, None]


def cells(points: np.ndarray, bits: int = BITS, span: float = SPAN) -> np.ndarray:
    """Grid cells of points, clipped to the span."""
    side = 1 << bits
    return np.clip(np.floor((points + span) * (side / (2 * span))), 0, side - 1).astype(np.int64)


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (bits x columns is 62 at most).

    The curve visits the 2^d cells of a cube in Gray-code order, and each smaller cube is the
    whole curve reflected and turned. From the highest bit on, those reflections and swaps are
    undone for the lower bits; the Gray code of what is left is the place, digit by digit.
    """
    x = [grid[:, k].copy() for k in range(grid.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(len(x)):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for part in x:
            key = (key << 1) | (((part ^ turn) >> level) & 1)
    return key


def keyed(docs: DataFrame, vocab_path: str, end_id: int = 2, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, curve_key and ids (little-endian, two bytes an id if the vocabulary allows, else four)."""
    kind = docs.select(doc_id).schema[0].dataType

    def run(batches):
        encoder = word_tokens.encoder(vocab_path)
        vocabulary = max(encoder.library.get_vocab_size(), end_id + 1)
        table, width, last = projection(vocabulary), np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4"), end_id.to_bytes(4, "little")
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [encoder.ids(text or "") + last for text in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(found), "<u4")
            ends = np.cumsum([len(f) // 4 for f in found])
            keys = hilbert_keys(cells(vectors(ids, np.append(0, ends[:-1]), table)))
            small = ids.astype(width)
            bounds = pa.array(np.append(0, ends) * width.itemsize, pa.int64())
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, bounds.buffers()[1], pa.py_buffer(small)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), packed], ["doc_id", "curve_key", "ids"])

    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, f"doc_id {kind.simpleString()}, curve_key bigint, ids binary")


def ordered(rows: DataFrame) -> DataFrame:
    """keyed() rows in ranges of the curve; equal keys go by a hash, so that ranges can part them."""
    tie = F.xxhash64(F.col("doc_id").cast("string"), "ids")
    return rows.withColumn("tie", tie).repartitionByRange("curve_key", "tie").sortWithinPartitions("curve_key", "tie", F.col("doc_id").cast("string"), "ids").select("doc_id", "ids")


class Stream:
    """Cuts a stream of documents into sequences. Gives (row, start, length, sequence, offset) of pieces whose sequence is settled."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.open: list[tuple] = []  # (row, start, length) of the sequence being filled
        self.filled = 0

    def add(self, row, n: int):
        at = 0
        while at < n:
            take = min(n - at, self.capacity - self.filled)
            self.open.append((row, at, take))
            self.filled += take
            at += take
            if self.filled == self.capacity:
                yield from self._close(self.capacity)

    def _close(self, length: int):
        """Settle the first ``length`` open tokens as one sequence."""
        done, offset, rest = 0, 0, []
        for row, start, n in self.open:
            now = min(n, length - done)
            if now:
                yield row, start, now, self.sequence, offset
                done, offset = done + now, offset + now
            if now < n:
                rest.append((row, start + now, n - now))
        self.open, self.filled = rest, self.filled - length
        self.sequence += 1

    def end(self):
        while self.filled:
            yield from self._close(1 << (self.filled.bit_length() - 1))


def packed(rows: DataFrame, wide: bool, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ordered() rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = rows.schema["doc_id"].dataType
    if capacity < 1:
        raise ValueError("a sequence has a token at least")

    def run(batches):
        width = np.dtype("<u4" if wide else "<u2")
        stream = Stream(capacity, TaskContext.get().partitionId() << 40)
        schema = None

        def told(pieces):
            columns = list(zip(*[(r[0], start, n, zlib.crc32(r[1][4 * start : 4 * (start + n)]), len(r[1]) // 4, q, o) for r, start, n, q, o in pieces])) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            schema = batch.schema
            done = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(np.frombuffer(raw, width).astype("<u4").tobytes())
                done += stream.add((doc, ids), len(ids) // 4)
            yield told(done)
        if schema is not None:
            yield told(stream.end())

    return map_arrow(rows, run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")))


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 2, capacity: int = CAPACITY, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    wide = max(word_tokens.encoder(vocab_path).library.get_vocab_size(), end_id + 1) > 1 << 16
    return packed(ordered(written(keyed(docs, vocab_path, end_id, doc_id, text))), wide, capacity)
