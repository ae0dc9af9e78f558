"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 characters cuts a text into chunks of about 1,000 characters, so passages that documents share fall
into equal chunks wherever they stand. Each distinct chunk is encoded once for as long as the task's cache holds it. A cut
can fall inside a word, so every join of two chunks is repaired: the last piece before the cut is encoded again together
with more and more of the next chunk, until a piece of the repaired stretch ends exactly where one of the chunk's own pieces
ends. From there on both agree, since the library's pre-tokenization only looks ahead; the chunk's ids are taken over.

Documents are encoded where they are read: a shuffle that would bring equal chunks of the whole corpus together moves every
text once, which costs more than encoding the repeated share again on another executor.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import id_and_text, slices
from ._units import SPACED, WHOLE, UnitEncoder

LEAST, MOST, MASK_BITS = 128, 8192, 10
HEADS = 12  # piece ends kept at the head of a chunk for the repair


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    factor = 0x01000193
    for step in (1, 2, 4, 8):
        h = h[:-step] * np.uint32(pow(factor, step, 1 << 32)) + h[step:]
    found, last = [], 0
    for at in (np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - MASK_BITS) == 0) + 16).tolist():
        while at - last > MOST:
            last += MOST
            found.append(last)
        if at - last >= LEAST:
            found.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        found.append(last)
    return [*found, n] if last < n else found


def _cut(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: Before a space and a letter that follow one of these, the library's pre-tokenization has a boundary whatever stands around.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?= [A-Za-z])")


def _runs(text: str) -> list[tuple[bool, str]]:
    """The text in runs; those that are true hold a character or mark of WHOLE and go to the library as they are."""
    if not WHOLE.search(text):
        return [(False, text)]
    return [(whole, "".join(own)) for whole, own in groupby(_SAFE.split(text), lambda r: bool(WHOLE.search(r)))]


class Chunk:
    """Encoding of one chunk: ids of all pieces, the ends of its first pieces, and where its last piece begins."""

    __slots__ = ("ids", "heads", "last_char", "last_byte")

    def __init__(self, units: list[str], ids: list[bytes]):
        self.ids = b"".join(ids)
        self.heads, char, byte = {0: 0}, 0, 0
        for u, i in zip(units[:HEADS], ids[:HEADS], strict=True):
            char, byte = char + len(u), byte + len(i)
            self.heads[char] = byte
        self.last_char = sum(map(len, units[:-1]))
        self.last_byte = len(self.ids) - len(ids[-1])
        self.heads = {c: b for c, b in self.heads.items() if c <= self.last_char}


class ChunkEncoder:
    """Encodes texts exactly as the library does; keeps at most 2 * capacity chunks. reused and encoded count chunks."""

    def __init__(self, path: str, capacity: int = 2000):
        self.units = UnitEncoder(path, SPACED)
        self.capacity = capacity
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.reused = self.encoded = 0

    def chunks(self, texts: list[str]) -> dict[str, Chunk]:
        found, new = {}, []
        for t in texts:
            if t in found:
                self.reused += 1
            elif c := self.young.get(t) or self.old.get(t):
                found[t] = self.young[t] = c
                self.reused += 1
            else:
                found[t] = None
                new.append(t)
        self.encoded += len(new)
        split = [self.units.split(t) for t in new]
        ids = self.units.encode([u for s in split for u in s])
        at = 0
        for t, s in zip(new, split, strict=True):
            found[t] = self.young[t] = Chunk(s, ids[at : at + len(s)])
            at += len(s)
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        runs = [_runs(t) for t in texts]
        cut = [[None if whole else _cut(r) for whole, r in own] for own in runs]
        found = self.chunks([c for own in cut for p in own if p for c in p])
        each = lambda own, parts: (self.units.library([r])[0] if p is None else self._join(p, found) for (_, r), p in zip(own, parts, strict=True))
        return [b"".join(each(own, parts)) for own, parts in zip(runs, cut, strict=True)]

    def _join(self, parts: list[str], found: dict[str, Chunk]) -> bytes:
        """Ids of a text from its chunks; carry is what stands open before the next one.

        Where a join finds no agreement, its chunk joins what is open, and the next try waits until that has doubled: however long
        a text goes on without agreement, its characters are split a bounded number of times.
        """
        out, carry, held, due = [], [], 0, 0
        for part in parts:
            chunk = found[part]
            at = 0
            if held:
                got = self._repair("".join(carry), part, chunk) if held >= due else None
                if got is None:
                    due = max(due, 2 * held)
                    carry.append(part)
                    held += len(part)
                    continue
                ids, at = got
                out += ids
            out.append(chunk.ids[chunk.heads[at] : chunk.last_byte])
            carry = [part[chunk.last_char :]]
            held, due = len(carry[0]), 0
        if held:
            out += self.units.encode(self.units.split("".join(carry)))
        return b"".join(out)

    def _repair(self, carry: str, part: str, chunk: Chunk) -> tuple[list[bytes], int] | None:
        """Ids from the start of carry up to a place in part where both encodings agree; None if they don't within part."""
        width = 48
        while True:
            units, pos = self.units.split(carry + part[:width]), -len(carry)
            for k, u in enumerate(units):
                if pos in chunk.heads:
                    return self.units.encode(units[:k]), pos
                pos += len(u)
            if width >= len(part) or width > 64 * max(chunk.heads) + 4096:
                return None
            width *= 4


@cache
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so its caches live from task to task."""
    return ChunkEncoder(path)


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
    table: list[bytes] = [b""] * (1 + max([*j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"])]))
    for token, i in j["model"]["vocab"].items():
        table[i] = bytes(byte[c] for c in token)
    for t in j["added_tokens"]:
        table[t["id"]] = t["content"].encode()
    return table


def decode(ids: np.ndarray | list[int], path: str) -> str:
    """Text of ids; special tokens stay, invalid UTF-8 becomes U+FFFD, unknown ids vanish."""
    table = pieces(path)
    return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids) if i < len(table)]).decode("utf-8", "replace")


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))]))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every document. A null text has no ids; repeated rows are encoded row by row."""
    path = path or default_vocabulary()

    def run(batches):
        enc = encoder(path)
        for part in slices(batches):
            ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids). Null ids give an empty text."""
    path = path or default_vocabulary()

    def run(batches):
        for part in slices(batches):
            texts = [decode(i or [], path) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: its encoding, and the decoding of these very ids, in one pass.

    with_ids adds the ids themselves (array<int>).
    """
    path = path or default_vocabulary()

    def run(batches):
        enc = encoder(path)
        for part in slices(batches):
            ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
            decoded = [hashlib.sha256(decode(np.frombuffer(i, "<u4"), path).encode()).hexdigest() for i in ids]
            columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(_lists(ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
