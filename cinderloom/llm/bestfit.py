"""Bounded-space online best-fit packing of documents into token sequences.

A document is its ids and one end id. Only documents longer than a sequence are cut, into full
pieces and a rest. Pieces arrive in a seeded random order and each is placed when it arrives. A
fixed number of bins is open; a bitset keyed by free space gives the open bin that a piece fits
best in one bit scan, and when a bin must open beyond that number the fullest closes first.

Defined results: a null text is the empty text, whose document is the end id alone. Repeated
rows are packed each. Ties (bins of equal free space) go to the bin that reached that space
last. An empty table gives no rows. Further columns are ignored. Texts of any length are cut
losslessly.

Scale: tokens leave the workers as piece lengths and checksums only. Pieces are dealt to groups
of about ``GROUP`` by a hash of document and piece, so no key gathers rows, and a group packs
in memory of its own size; a group wastes at most its last open bins.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm import word_tokens
from cinderloom.llm.common import map_arrow, pick, written

CAPACITY = 2048
#: Bins open at once, pieces of a group.
OPEN, GROUP = 1024, 262_144


class OpenBins:
    """Open bins by free space: one bit for each space that some bin has, a stack of bins below it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = self.count = self.opened = 0
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        name = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return name

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that an item of 1 to capacity gets."""
        fits = self.bits >> length
        if length == self.capacity:  # it never is open
            self.opened += 1
            return self.opened - 1, 0
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.count -= 1
            free, name = self.capacity, self.opened
            self.opened += 1
            self.count += 1
        left = free - length
        if left:
            if not self.stacks[left]:
                self.bits |= 1 << left
            self.stacks[left].append(name)
        else:
            self.count -= 1
        return name, self.capacity - free


def pack(lengths: np.ndarray, capacity: int = CAPACITY, most: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order of arrival."""
    bins = OpenBins(capacity, most)
    placed = np.array([bins.put(n) for n in lengths.tolist()], np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1]


def pieces(docs: DataFrame, vocab_path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    kind = docs.select(doc_id).schema[0].dataType

    def run(batches):
        encoder = word_tokens.encoder(vocab_path)
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, most: int = OPEN, group: int = GROUP) -> DataFrame:
    """items (with doc_id, piece, length) with sequence_id and offset. items is read twice."""
    groups = -(-items.count() // group) or 1
    order = F.xxhash64(F.col("doc_id").cast("string"), "piece", "length", F.lit(20))
    keyed = items.select("*", order.alias("arrival")).withColumn("bin_group", F.pmod(F.shiftright("arrival", 8), F.lit(groups)))
    names = [f.name for f in items.schema]

    def one(table: pa.Table) -> pa.Table:
        by = [("arrival", "ascending"), *((n, "ascending") for n in names)]
        table = table.combine_chunks().sort_by(by)
        name, offset = pack(table.column("length").to_numpy(), capacity, most)
        # Packing groups are far fewer than 2^20, sequences of one far fewer than 2^40.
        first = table.column("bin_group")[0].as_py() << 40
        return table.select(names).append_column("sequence_id", pa.array(name + first)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return keyed.groupBy("bin_group").applyInArrow(one, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(written(pieces(docs, vocab_path, end_id, capacity)), capacity)
