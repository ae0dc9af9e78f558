"""Media columns: byte payloads as MPEG-1 Layer III streams, and a parser for such streams.

A stream starts with an ID3v2.3 tag (TLEN: length in milliseconds, TXXX:bytes: length before padding) and a Xing frame
(frame count, byte count, 100 seek points), then come frames with a checksum. A frame's part2_3_length fields say how many
bytes of its main data are in use; these bytes are the payload, so the bitrate varies with what a frame has to carry.
The parser takes no frame for granted: it resynchronises on two agreeing headers, reads tags at either end (ID3v1, ID3v2.3 and
2.4) and Xing, Info, VBRI and LAME tables, verifies CRC-16, and derives the duration from the frames it found less the encoder's
delay and padding, the seek offsets being the frames' own positions.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import id_and_text, slices

#: Fixed values of the format (ISO 11172-3): kbit/s of Layer III in MPEG-1 and MPEG-2, sample rates by version.
BITRATES_V1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATES_V2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLY = 0x8005

UNIT = 64  # the payload is padded to a multiple of so many bytes
FULL = 960  # payload bytes of a full frame
SIDE = 17  # side information of a mono MPEG-1 frame
HEAD = 4 + 2 + SIDE


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLY) & 0xFFFF if c & 0x8000 else c << 1
        table[i] = c
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of a byte matrix."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for col in rows.T:
        crc = ((crc << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC[(crc >> np.uint32(8)) ^ col]
    return crc


def pad(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _frame(payload: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame with so many payload bytes, and the frame's length."""
    index = next(i for i, k in enumerate(BITRATES_V1) if k and 144_000 * k // 44_100 - HEAD >= payload)
    first = payload // 2
    bits = f"{0:09b}{0:05b}{0:04b}" + "".join(f"{8 * n:012b}{'0' * 47}" for n in (first, payload - first))
    side = int(bits, 2).to_bytes(SIDE, "big")
    head = bytes([0xFF, 0xFA, index << 4, 0xC0])
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + side, 144_000 * BITRATES_V1[index] // 44_100


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        text = b"\0" + (key[5:].encode("latin-1") + b"\0" if key.startswith("TXXX:") else b"") + value.encode("latin-1")
        body += key[:4].encode() + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\3\0\0" + _syncsafe(len(body)) + body


def encode(payload: bytes, n_bytes: int) -> bytes:
    """Stream of a payload whose length is a positive multiple of 64; n_bytes is its length before padding."""
    whole, rest = divmod(len(payload), FULL)
    parts, offsets = [], []
    if whole:
        head, size = _frame(FULL)
        rows = np.zeros((whole, size), np.uint8)
        rows[:, :HEAD] = np.frombuffer(head, np.uint8)
        rows[:, HEAD : HEAD + FULL] = np.frombuffer(payload, np.uint8, whole * FULL).reshape(whole, FULL)
        parts.append(rows.tobytes())
        offsets += range(0, whole * size, size)
    if rest:
        head, size = _frame(rest)
        offsets.append(sum(map(len, parts)))
        parts.append((head + payload[whole * FULL :]).ljust(size, b"\0"))
    audio = b"".join(parts)
    xing_size = 144_000 * 48 // 44_100
    total = xing_size + len(audio)
    toc = bytes(min(255, (xing_size + offsets[len(offsets) * i // 100]) * 256 // total) for i in range(100))
    xing = bytes([0xFF, 0xFB, 3 << 4, 0xC0]) + bytes(SIDE) + b"Xing" + (7).to_bytes(4, "big")
    xing = (xing + len(offsets).to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(xing_size, b"\0")
    tag = _tag({"TLEN": str(len(offsets) * 1152 * 1000 // 44_100), "TXXX:bytes": str(n_bytes)})
    return tag + xing + audio


@dataclass
class Stream:
    """What parse() finds. Durations are exact: (samples - delay - padding) / sample_rate seconds."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    sample_rate: int = 0
    offsets: list[int] = field(default_factory=list)  # of the audio frames: the seek table
    bitrates: list[int] = field(default_factory=list)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    delay: int = 0  # samples that the encoder put before and after the sound
    padding: int = 0
    crc_checked: int = 0
    crc_failed: int = 0
    damaged: list[int] = field(default_factory=list)  # offsets of frames whose checksum failed; their payload is kept
    skipped: int = 0  # bytes between frames that belong to none
    payload: bytes = b""


def _header(h: bytes) -> tuple[int, int, int, int, bool, int, int] | None:
    """Size, samples, sample rate, kbit/s, has a checksum, side information, version of a Layer III header."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE6 != 0xE2:
        return None
    version, rate, mono = (h[1] >> 3) & 3, (h[2] >> 2) & 3, h[3] >> 6 == 3
    if version == 1 or rate == 3 or not 0 < h[2] >> 4 < 15:
        return None
    hz, kbits = RATES[version][rate], (BITRATES_V1 if version == 3 else BITRATES_V2)[h[2] >> 4]
    size = (144_000 if version == 3 else 72_000) * kbits // hz + ((h[2] >> 1) & 1)
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, 1152 if version == 3 else 576, hz, kbits, not h[1] & 1, side, version


def parse(blob: bytes) -> Stream:
    """Tags, frames, checksums and payload of a stream; damaged stretches are skipped and counted."""
    out, at, end = Stream(), 0, len(blob)
    while blob[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _read_tag(blob, at, end, out.tags)
    if end - at >= 128 and blob[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["TIT2"] = blob[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    known: dict[bytes, tuple | None] = {}
    held, uses, first = [], [], True
    while at + 4 <= end:
        h = blob[at : at + 4]
        info = known[h] if h in known else known.setdefault(h, _header(h))
        if info and not held and first and at + info[0] < end:  # the first frame counts only if the next one agrees
            nxt = _header(blob[at + info[0] : at + info[0] + 4])
            info = info if nxt and nxt[2] == info[2] and nxt[6] == info[6] else None
        if not info or at + info[0] > end:
            if (nxt := _resync(blob, at + 1, end)) is None:
                out.skipped += end - at
                break
            out.skipped += nxt - at
            at = nxt
            continue
        size, samples, hz, kbits, protected, side, _ = info
        x = at + 4 + side + 2 * protected
        if first and blob[at + 36 : at + 40] == b"VBRI":  # 32 bytes behind the header, whatever the version
            out.vbr_bytes, out.vbr_frames = int.from_bytes(blob[at + 46 : at + 50], "big"), int.from_bytes(blob[at + 50 : at + 54], "big")
        elif first and blob[at + 4 + side : at + 8 + side] in (b"Xing", b"Info"):
            q, flags = at + 12 + side, int.from_bytes(blob[at + 8 + side : at + 12 + side], "big")
            if flags & 1:
                out.vbr_frames, q = int.from_bytes(blob[q : q + 4], "big"), q + 4
            if flags & 2:
                out.vbr_bytes, q = int.from_bytes(blob[q : q + 4], "big"), q + 4
            if flags & 4:
                out.toc, q = blob[q : q + 100], q + 100
            q += 4 * (flags >> 3 & 1)
            if blob[q : q + 4] in (b"LAME", b"Lavc", b"Lavf") and q + 24 <= min(end, at + size):
                both = int.from_bytes(blob[q + 21 : q + 24], "big")
                out.delay, out.padding = both >> 12, both & 0xFFF
        else:
            out.offsets.append(at)
            out.bitrates.append(kbits)
            out.samples += samples
            out.sample_rate = hz
            if protected:
                held.append((at, side))
            if side == SIDE and info[6] == 3:
                s = blob[x - side : x]
                used = ((s[2] & 0x3F) << 6 | s[3] >> 2) + ((s[9] & 0x07) << 9 | s[10] << 1 | s[11] >> 7)
                uses.append(blob[x : x + (used >> 3)])
        first = False
        at += size
    out.frames, out.payload = len(out.offsets), b"".join(uses)
    for side in {s for _, s in held}:
        where = np.array([a for a, s in held if s == side])
        raw = np.frombuffer(blob, np.uint8)
        good = where + 6 + side <= len(raw)
        rows = raw[where[good, None] + np.r_[2, 3, 6 : 6 + side]]
        want = raw[where[good] + 4].astype(np.uint32) << 8 | raw[where[good] + 5]
        out.crc_checked += len(where)
        failed = np.concatenate([where[good][crc16(rows) != want], where[~good]])
        out.crc_failed += len(failed)
        out.damaged = sorted([*out.damaged, *failed.tolist()])
    return out


_ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]


def _number(raw: bytes, bits: int) -> int:
    """Big-endian number of bytes of which bits count."""
    out = 0
    for b in raw:
        out = out << bits | b & (1 << bits) - 1
    return out


def _read_tag(blob: bytes, at: int, end: int, tags: dict[str, str]) -> int:
    """Add the text fields of the ID3v2 tag at a place to tags; returns where the tag ends. What is cut off or unknown is passed over."""
    version, flags = blob[at + 3], blob[at + 5]
    bits = 7 if version >= 4 else 8  # of each byte of a field's length
    stop = min(end, at + 10 + _number(blob[at + 6 : at + 10], 7))
    p = at + 10
    if flags & 0x40:  # extended header; its length counts itself from version 4 on
        p += _number(blob[p : p + 4], bits) + (0 if version >= 4 else 4)
    while p + 10 <= stop and blob[p : p + 4].strip(b"\0"):
        key, n = blob[p : p + 4].decode("latin-1"), _number(blob[p + 4 : p + 8], bits)
        if key[0] == "T" and n and p + 10 + n <= stop:
            value = blob[p + 11 : p + 10 + n].decode(_ENCODINGS[blob[p + 10] & 3], "replace")
            name, _, rest = value.partition("\0")
            rest = rest.removeprefix("\ufeff")
            tags.update({f"TXXX:{name}": rest.rstrip("\0")} if key == "TXXX" else {key: value.rstrip("\0")})
        p += 10 + n
    return stop + 10 * (version >= 4 and bool(flags & 0x10))  # a footer


def _resync(blob: bytes, at: int, end: int) -> int | None:
    """Next position whose header is followed by an agreeing one, or by the end."""
    while (at := blob.find(b"\xff", at, end)) >= 0:
        if info := _header(blob[at : at + 4]):
            nxt = _header(blob[at + info[0] : at + info[0] + 4])
            if at + info[0] == end or nxt and nxt[2] == info[2] and nxt[6] == info[6]:
                return at
        at += 1
    return None


def encode_media(df: DataFrame) -> DataFrame:
    """doc_id, media: the stream of each text's UTF-8 bytes. A null text counts as empty; no row is dropped."""

    def run(batches):
        for part in slices(batches, 32):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([encode(pad(t), len(t)) for t in texts], pa.binary())], ["doc_id", "media"])

    return id_and_text(df).mapInArrow(run, "doc_id long, media binary")


PROBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, samples long, sample_rate int, duration_us long, n_skipped long, crc_failed long, seek_offsets array<long>"
)


def feature(s: Stream) -> str:
    """Compact description: frames, samples at the rate, mean kbit/s, checksums, then mean, deviation and change of the samples."""
    x = np.frombuffer(s.payload, np.uint8).astype(np.float64) - 128
    change = float(np.abs(np.diff(x)).mean()) if len(x) > 1 else 0.0
    kbits = sum(s.bitrates) / max(1, s.frames)
    return f"f{s.frames} s{s.samples}@{s.sample_rate} k{kbits:.2f} c{s.crc_checked - s.crc_failed}/{s.crc_checked} m{x.mean():.3f} d{x.std():.3f} v{change:.3f}"


def probe_media(df: DataFrame, seek_every: int = 1) -> DataFrame:
    """What the stored streams (doc_id, media) say once read back, with the offsets of the frames (of every seek_every-th one).

    A null or empty stream gives zero frames and a null n_bytes; n_bytes is also null where a foreign tag holds no number of bytes.
    """

    def run(batches):
        for part in slices(batches, 32):
            rows = []
            for doc_id, blob in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                s = parse(blob := blob or b"")
                n = s.tags.get("TXXX:bytes")
                rows.append((
                    doc_id, int(n) if n is not None and re.fullmatch("[0-9]{1,18}", n) else None, len(s.payload), hashlib.sha256(s.payload).hexdigest(),
                    zlib.crc32(s.payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(s) if s.payload else "", s.frames, s.samples,
                    s.sample_rate, max(0, s.samples - s.delay - s.padding) * 1_000_000 // s.sample_rate if s.sample_rate else 0, s.skipped, s.crc_failed, s.offsets[::seek_every],
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return df.select("doc_id", "media").mapInArrow(run, PROBED)


_NAMES = [x.split()[0] for x in PROBED.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_TYPES = [_KINDS[x.split()[1]] for x in PROBED.split(", ")]
