"""MPEG audio columns: a frame parser, and a container that keeps any bytes in valid frames.

The parser resynchronises on frame headers (layers I to III, versions 1, 2 and 2.5), reads ID3v2,
ID3v1, APE tags and Xing/Info/VBRI tables, verifies the frames' CRC-16, and gives the exact
duration (samples over rate, as integers) and the byte offset of every frame.

The container writes MPEG-1 layer III mono frames at 48 kHz and 80 kbit/s: 240 bytes each, of
which 23 are header, CRC and side information of a silent granule pair, 192 carry the payload
as ancillary data (its unit), and the rest is zero. An ID3v2 tag in front names the unpadded
length, an Info frame holds frame count, byte count and the seek table.

Defined results: a null text is the empty text; the empty text gives one unit of spaces; equal
texts give equal values; repeated rows are stored each; further columns are ignored. Parsing
never fails: bytes without any frame have 0 frames, and junk between frames is skipped and
counted.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from cinderloom.llm.common import map_arrow, pick, slices

#: Payload bytes of a frame, and the byte that pads the last.
UNIT, PAD = 192, 32
#: Characters of text whose media bytes are held at once.
CHUNK = 4_000_000

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index, Hz by sampling index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mode: int
    mode_extension: int
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return ((17, 32) if self.version == 1 else (9, 17))[self.mode != 3]


@lru_cache(4096)
def parse_header(word: int) -> Header | None:
    """The header of a frame from its four bytes, or None if they are no header. Free format counts as none."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate_index, hertz_index = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or rate_index in (0, 15) or hertz_index == 3 or word & 3 == 2:
        return None
    kbits = KBITS[1 if version == 1 else 2, layer][rate_index]
    rate, padding = HERTZ[version][hertz_index], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * kbits * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    return Header(version, layer, not word >> 16 & 1, kbits, rate, word >> 6 & 3, word >> 4 & 3, size, samples)


@lru_cache(1)
def crc_table() -> np.ndarray:
    """CRC-16 of polynomial 0x8005, most significant bit first."""
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ 0x8005, out << 1) & 0xFFFF
    return out.astype(np.uint16)


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of a byte matrix, from 0xFFFF."""
    table, crc = crc_table(), np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)) ^ column]
    return crc


@dataclass
class Parsed:
    offsets: np.ndarray
    sizes: np.ndarray
    samples: int = 0
    rate: int = 0
    kinds: list[str] = field(default_factory=list)
    kbits: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    #: Xing: file parts in 256ths that stand before each hundredth of the time. VBRI: bytes of each entry.
    seek: list[int] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Bytes of the tags in front; text frames go to tags."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        end = at + 10 + _synchsafe(data[at + 6 : at + 10])
        p, wide = at + 10, data[at + 3] >= 4
        while p + 10 <= min(end, len(data)) and data[p : p + 4].strip(b"\0"):
            size = _synchsafe(data[p + 4 : p + 8]) if wide else int.from_bytes(data[p + 4 : p + 8], "big")
            name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : p + 10 + size]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            p += 10 + size
        at = end + (10 if data[at + 5] & 16 else 0)
    return min(at, len(data))


def _trailing_tags(data: bytes, start: int, tags: dict[str, str]) -> int:
    """Where the audio ends before ID3v1 and APE tags."""
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(start, end - size - (32 if flags >> 31 else 0))
        tags["APE"] = "1"
    return end


def _vbr_table(data: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]]:
    """Counts and seek table of a Xing, Info or VBRI header in the frame, if it has one; what the file cuts off is left out."""
    p = at + 4 + (2 if h.protected else 0) + h.side
    number = lambda q, n: int.from_bytes(data[q : q + n], "big")
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags, q, out = number(p + 4, 4), p + 8, {"xing": int(data[p : p + 4] == b"Xing")}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = number(q, 4)
                q += 4
        seek = list(data[q : q + 100]) if flags & 4 else []
        q += 100 * bool(flags & 4)
        if flags & 8 and q + 4 <= len(data):
            out["quality"] = number(q, 4)
        return out, seek
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= len(data):
        out = {"vbri": 1, "delay": number(p + 6, 2), "quality": number(p + 8, 2), "bytes": number(p + 10, 4), "frames": number(p + 14, 4), "frames_an_entry": number(p + 24, 2)}
        count, scale, width = number(p + 18, 2), number(p + 20, 2), number(p + 22, 2)
        ends = range(p + 26, min(p + 26 + count * width, len(data) - width + 1), width) if 1 <= width <= 4 else ()
        return out, [number(q, width) * scale for q in ends]
    return {}, []


# Fixed values of ISO/IEC 11172-3 (tables B.2a to d) and 13818-3 (table B.1): bits of the
# allocation of each subband of layer II.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(h: Header) -> tuple[int, ...]:
    if h.version != 1:
        return ALLOCATION["lsf"]
    each = h.kbits // (1 if h.mode == 3 else 2)
    if each <= 48:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or each <= 80 else "b"]


def _layer2_crc(data: bytes, at: int, h: Header) -> int:
    """The checksum of a layer II frame: header, bit allocation and scale factor selection, to the bit."""
    channels, bands = 1 if h.mode == 3 else 2, _allocation(h)
    shared = min(4 * (h.mode_extension + 1), len(bands)) if h.mode == 1 else len(bands)
    body = int.from_bytes(data[at + 6 : at + h.size], "big")
    room = 8 * max(0, min(h.size, len(data) - at) - 6)
    used = selected = 0
    for band, bits in enumerate(bands):
        for _ in range(channels if band < shared else 1):
            if used + bits > room:
                return -1
            if body >> (room - used - bits) & ((1 << bits) - 1):
                # Above the bound both channels share the allocation but not the selection.
                selected += 1 if band < shared else channels
            used += bits
    used += 2 * selected
    if used > room:
        return -1
    crc = int(crc16(np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + used // 8], np.uint8)[None])[0])
    for k in range(used - used % 8, used):
        top = crc >> 15 ^ (body >> (room - k - 1) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _crc_span(h: Header) -> int:
    """Bytes after the CRC that it covers in layers I (the bit allocation) and III (the side information)."""
    if h.layer == 3:
        return h.side
    channels = 1 if h.mode == 3 else 2
    bound = 4 * (h.mode_extension + 1) if h.mode == 1 else 32
    return (bound * channels + 32 - bound) // 2


def _check(data: bytes, view: np.ndarray, h: Header, at: np.ndarray) -> int:
    """How many of the frames at these offsets, all with this header but for padding, have the right checksum."""
    said = view[at + 4].astype(np.uint16) * np.uint16(256) + view[at + 5]
    if h.layer == 2:
        return sum(_layer2_crc(data, p, parse_header(int.from_bytes(data[p : p + 4], "big"))) == c for p, c in zip(at.tolist(), said.tolist()))
    covered = np.concatenate([[2, 3], np.arange(6, 6 + _crc_span(h))])
    good, step = 0, max(1, 4_000_000 // len(covered))
    for lo in range(0, len(at), step):
        good += int((crc16(view[at[lo : lo + step, None] + covered]) == said[lo : lo + step]).sum())
    return good


def parse(data: bytes) -> Parsed:
    """Find the frames. A lone header counts only if another follows where it says, or the data ends there."""
    out = Parsed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = start = _id3v2(data, out.tags)
    end = _trailing_tags(data, start, out.tags)
    view = np.frombuffer(data, np.uint8)
    offsets: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    checked: dict[tuple, tuple[Header, list[np.ndarray]]] = {}
    locked, first = False, True
    while at + 4 <= end:
        word = int.from_bytes(data[at : at + 4], "big")
        h = parse_header(word)
        good = h is not None and at + h.size <= end
        if good and not locked:
            after = at + h.size
            follows = parse_header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            good = after == end or (follows is not None and (follows.version, follows.layer, follows.rate) == (h.version, h.layer, h.rate))
        if not good:
            out.resyncs += locked or at == start
            locked = False
            found = data.find(b"\xff", at + 1, end)
            to = end if found < 0 else found
            out.skipped += to - at
            at = to
            continue
        locked = True
        # Frames of the same size with the same header (but for its padding, which changes the size) follow each other.
        # The window grows, so that headers that change at every frame cost no more than they are.
        most, n, window = (end - at) // h.size, 1, 4
        while n < most:
            take = min(window, most - n)
            heads = view[at + n * h.size : at + (n + take) * h.size].reshape(take, h.size)[:, :4]
            same = (heads == view[at : at + 4]).all(1)
            if not same.all():
                n += int(np.argmin(same))
                break
            n, window = n + take, window * 4
        run = at + h.size * np.arange(n, dtype=np.int64)
        if first:
            first = False
            out.rate = h.rate
            if h.layer == 3 and (told := _vbr_table(data, at, h))[0]:
                out.table, out.seek = told
                run, n = run[1:], n - 1  # it holds no sound
                at += h.size
        if n:
            if h.protected:
                checked.setdefault((h.version, h.layer, h.kbits, h.rate, h.mode, h.mode_extension), (h, []))[1].append(run)
            offsets.append(run)
            sizes.append(np.full(n, h.size, np.int64))
            out.samples += n * h.samples
            kind = f"{h.version:g}.{h.layer}"
            if kind not in out.kinds:
                out.kinds.append(kind)
            if h.kbits not in out.kbits:
                out.kbits.append(h.kbits)
            at += n * h.size
    if at < end:
        out.skipped += end - at
    for h, runs in checked.values():
        found = np.concatenate(runs)
        good = _check(data, view, h, found[found + 6 + (0 if h.layer == 2 else _crc_span(h)) <= len(data)])
        out.crc_ok += good
        out.crc_bad += len(found) - good
    if offsets:
        out.offsets, out.sizes = np.concatenate(offsets), np.concatenate(sizes)
    return out


#: MPEG-1, layer III, CRC, 80 kbit/s, 48 kHz, mono.
HEAD = bytes([0xFF, 0xFA, 0x64, 0xC4])
SIDE = 17
BODY = 4 + 2 + SIDE


@lru_cache(1)
def _silent() -> np.ndarray:
    frame = np.zeros(parse_header(int.from_bytes(HEAD, "big")).size, np.uint8)
    frame[:4] = list(HEAD)
    crc = int(crc16(np.frombuffer(HEAD[2:] + bytes(SIDE), np.uint8)[None])[0])
    frame[4:6] = crc >> 8, crc & 255
    return frame


def padded(payload: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of the unit."""
    return payload.ljust(-(-max(len(payload), 1) // UNIT) * UNIT, bytes([PAD]))


def write(payload: bytes) -> bytes:
    """The payload, padded, as an MPEG audio file."""
    body = np.frombuffer(padded(payload), np.uint8).reshape(-1, UNIT)
    frames = np.repeat(_silent()[None], len(body) + 1, 0)
    frames[1:, BODY : BODY + UNIT] = body
    size = frames.shape[1]
    toc = bytes(256 * i // 100 for i in range(100))  # constant bit rate: seek points lie evenly
    info = b"Info" + struct.pack(">III", 7, len(body), size * len(frames)) + toc
    frames[0, BODY : BODY + len(info)] = list(info)
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    n = len(frame)
    tag = b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame
    return tag + frames.tobytes()


def read(media: bytes, parsed: Parsed | None = None) -> bytes:
    """The padded payload that write() stored, gathered at the offsets of the parsed frames; of any other file, no bytes."""
    p = parsed or parse(media)
    if "payload_bytes" not in p.tags or not len(p.offsets) or p.sizes.min() < BODY + UNIT:
        return b""
    return np.frombuffer(media, np.uint8)[(p.offsets + BODY)[:, None] + np.arange(UNIT)].tobytes()


def feature(p: Parsed) -> str:
    return json.dumps(
        {
            "frames": len(p.offsets), "samples": p.samples, "rate": p.rate, "kinds": p.kinds, "kbits": sorted(p.kbits), "crc_ok": p.crc_ok, "crc_bad": p.crc_bad,
            "skipped": p.skipped, "resyncs": p.resyncs, "table": p.table, "seek_entries": len(p.seek), "seek_last": p.seek[-1] if p.seek else -1, "first": int(p.offsets[0]) if len(p.offsets) else -1, "last": int(p.offsets[-1]) if len(p.offsets) else -1,
        },
        sort_keys=True,
    )


def store(docs: DataFrame, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the file as binary) of every row."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) for t in texts], CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([write(t) for t in texts[lo:hi]], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, f"doc_id {kind}, n_bytes bigint, media binary")


def probe(media: DataFrame) -> DataFrame:
    """What parse() finds in a column media, beside the rows' doc_id and n_bytes.

    payload: the stored bytes, read back. duration: duration_samples over sample_rate seconds,
    exactly. frame_offsets: little-endian unsigned 64-bit byte offsets, one for each frame.
    Null media counts as empty.
    """

    def run(batches):
        for batch in batches:
            files = [m or b"" for m in batch.column(2).to_pylist()]
            for lo, hi in slices([len(m) for m in files], CHUNK):
                found = [parse(m) for m in files[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi], batch.column(1)[lo:hi], batch.column(2)[lo:hi],
                        pa.array([read(m, p) for m, p in zip(files[lo:hi], found)], pa.binary()),
                        pa.array([len(p.offsets) for p in found], pa.int64()), pa.array([p.samples for p in found], pa.int64()), pa.array([p.rate for p in found], pa.int64()),
                        pa.array([p.offsets.astype("<u8").tobytes() for p in found], pa.binary()), pa.array([feature(p) for p in found]),
                    ],
                    ["doc_id", "n_bytes", "media", "payload", "n_frames", "duration_samples", "sample_rate", "frame_offsets", "feature"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, media binary, payload binary, n_frames bigint, duration_samples bigint, sample_rate bigint, frame_offsets binary, feature string"
    return map_arrow(pick(media, doc_id="doc_id", n_bytes="n_bytes", media="media"), run, schema)
