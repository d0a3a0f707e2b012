"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation looks up a class for every codepoint, composes the automaton's transition
functions with an associative scan over equal-length blocks, and reads token boundaries off
the states. The slices between boundaries are merged by rank, each distinct slice once per
cache generation; ids are little-endian unsigned 32-bit integers.

Defined results: a null text is the empty text; the empty text has no ids; a null or empty id
string decodes to no bytes. Repeated rows are encoded each; further columns are ignored. Very
long texts are processed whole, in time linear in their length (a very long single slice:
n log n). Text that is not well-formed UTF-8 can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame

from cinderloom.llm.common import cache_of, claim, map_arrow, pick, slices

#: Characters whose codepoints are processed in one go.
CHUNK = 1_000_000
#: Distinct slices kept by a worker; two generations are alive at most.
CACHE = 150_000
#: Codepoints of a block, whose transitions are composed one after the other for all blocks at once.
BLOCK = 512

# Codepoint classes. s/t/m/d end a contraction at once; r, v and l need one more letter.
LETTER, STMD, R_, V_, L_, E_, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, STOP = range(12)
# States: what stands before the next codepoint. TICK to DONE follow an apostrophe that may begin a contraction.
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_WHITE, TICK, TICK_R, TICK_V, TICK_L, DONE = range(11)
N_CLASSES, N_STATES = 12, 11


def _next(state: int, kind: int) -> int:
    if kind == STOP:
        return START
    if kind <= E_:
        if state == TICK:
            return {STMD: DONE, R_: TICK_R, V_: TICK_V, L_: TICK_L}.get(kind, IN_LETTER)
        if (state in (TICK_R, TICK_V) and kind == E_) or (state == TICK_L and kind == L_):
            return DONE
        return IN_LETTER
    if kind == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, AFTER_SPACE, TICK) else TICK
    return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE}[kind]


@lru_cache(1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that compositions of the classes' functions can reach.

    Returns the function of each class, the table of compositions (first, then second) and the
    images (function, state). Composition is associative, so prefixes can be scanned by blocks.
    """
    images = [tuple(range(N_STATES))]
    index = {images[0]: 0}
    of_class = []
    for kind in range(N_CLASSES):
        f = tuple(_next(s, kind) for s in range(N_STATES))
        if f not in index:
            index[f] = len(images)
            images.append(f)
        of_class.append(index[f])
    generators = sorted(set(of_class))
    todo = list(range(len(images)))
    while todo:
        f = images[todo.pop()]
        for g in generators:
            h = tuple(images[g][s] for s in f)
            if h not in index:
                index[h] = len(images)
                images.append(h)
                todo.append(index[h])
    table = np.array([[index[tuple(g[s] for s in f)] for g in images] for f in images], np.uint16)
    return np.array(of_class, np.uint16), table, np.array(images, np.uint8)


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, as the tokenizer library's own Unicode tables have it."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, codes))
    single = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        only = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(only.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for chars, kind in (("stmd", STMD), ("r", R_), ("v", V_), ("l", L_), ("e", E_), ("'", APOSTROPHE), (" ", SPACE)):
        for c in chars:
            out[ord(c)] = kind
    return out


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The state after each codepoint.

    Each block's transitions are composed for all blocks side by side; the blocks' own
    functions are then combined by a log-step scan, and each block starts from the state that
    it gives.
    """
    of_class, table, images = transition_monoid()
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, STOP, np.uint8)
    padded[:n] = kinds
    steps = of_class[padded.reshape(rows, BLOCK).T]
    size = np.uint32(table.shape[0])
    flat = table.ravel()
    prefix = np.empty((BLOCK, rows), np.uint16)
    prefix[0] = steps[0]
    for j in range(1, BLOCK):
        np.take(flat, prefix[j - 1] * size + steps[j], out=prefix[j])
    whole, shift = prefix[-1].copy(), 1
    while shift < rows:
        whole[shift:] = flat[whole[:-shift] * size + whole[shift:]]
        shift *= 2
    before = np.full(rows, START, np.uint8)
    before[1:] = images[whole[:-1], START]
    width = np.uint32(images.shape[1])
    return np.take(images.ravel(), prefix * width + before).T.ravel()[:n]


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Where tokens start, for classes of texts each followed by STOP; STOPs count as starts too."""
    n = len(kinds)
    after = scan_states(kinds)
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = after[:-1]
    ahead = np.full(n, STOP, np.uint8)
    ahead[:-1] = kinds[1:]
    later = np.full(n, START, np.uint8)
    later[:-1] = after[1:]
    white = kinds >= SPACE
    was_white = (before == AFTER_SPACE) | (before == AFTER_WHITE)
    letter = kinds <= E_
    number = kinds == NUMBER
    other = (kinds == OTHER) | (kinds == APOSTROPHE)
    held = before == AFTER_SPACE  # the one space before a run belongs to it
    in_word = (before == IN_LETTER) | ((before >= TICK_R) & (before <= TICK_L))
    contracted = (before == TICK) & ((after == DONE) | ((after >= TICK_R) & (after <= TICK_L) & (later == DONE)))
    starts = letter & ~held & ~in_word & ~contracted
    starts |= number & ~held & (before != IN_NUMBER)
    starts |= other & ~held & (before != IN_OTHER) & (before != TICK)
    starts |= white & (~was_white | (ahead < SPACE))
    starts[0] = True
    starts |= kinds == STOP
    starts[1:] |= kinds[:-1] == STOP
    return starts


class Vocabulary:
    """Ranks of a byte-level BPE file and a cache of merged slices."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 60:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same result with a heap of pairs and linked parts, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or part[i] is not left or part[j] is not right:
                continue
            part[i], part[j] = left + right, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return tuple(out)

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        young = self.young
        got = list(map(young.get, words))
        if None in got:
            old = self.old
            for i, ids in enumerate(got):
                if ids is None:
                    w = words[i]
                    ids = young.get(w)
                    if ids is None:
                        ids = old.get(w)
                        if ids is None:
                            ids = self.merge(w.encode())
                        if len(w) <= 64:
                            young[w] = ids
                            if len(young) >= CACHE:
                                self.old, self.young = young, {}
                                young, old = self.young, self.old
                    got[i] = ids
        return got


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        out = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    cache_of("bpe", out.forget)
    return out


def vocabulary(path: str) -> Vocabulary:
    claim("bpe")
    return _vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of each text, as uint32."""
    classes = codepoint_classes()
    for lo, hi in slices([len(t) for t in texts], CHUNK):
        joined = "\0".join(texts[lo:hi]) + "\0"
        kinds = classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]]) - 1
        kinds[ends] = STOP
        cuts = np.flatnonzero(token_starts(kinds))
        at = cuts.tolist()
        words = [joined[a:b] for a, b in zip(at, at[1:])]
        words.append("")
        which = np.searchsorted(cuts, ends)
        first = 0
        for w in which.tolist():
            ids = list(chain.from_iterable(vocab.ids_of(words[first:w])))
            yield np.array(ids, np.uint32)
            first = w + 1


def encode(docs: DataFrame, vocab_path: str, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and ends (where each token ends among the text's bytes) of every row."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) for t in texts], 2 * CHUNK):
                ids = list(encode_texts(texts[lo:hi], vocab))
                ends = [np.cumsum(vocab.sizes[i]).astype("<u4").tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "ids", "ends"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, f"doc_id {kind}, ids binary, ends binary")


def decode(encoded: DataFrame, vocab_path: str, ids: Column | str = "ids") -> DataFrame:
    """The rows of encode() with one more column, decoded: the bytes that the ids stand for."""

    def run(batches):
        pieces = vocabulary(vocab_path).pieces
        for batch in batches:
            raw = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(1).to_pylist()]
            out = [b"".join([pieces[i] for i in x]) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(pick(encoded, doc_id="doc_id", ids=ids), run, f"doc_id {kind}, ids binary, decoded binary")


def decode_span(ids: np.ndarray, ends: np.ndarray, first: int, last: int, pieces: list[bytes]) -> tuple[int, bytes]:
    """The byte offset of token ``first`` in its text, and the bytes of the tokens from there to before ``last``."""
    return (int(ends[first - 1]) if first else 0), b"".join(pieces[i] for i in ids[first:last].tolist())
