"""Cached encoding of text pieces by the tokenizers library.

A text is cut where the library's own pre-tokenization has a boundary whatever stands around it, so the ids of the pieces
follow each other unchanged. Each distinct piece goes to the library once for as long as the cache holds it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Runs of Latin letters before closing marks and white space, those marks, other runs without white space, white space.
SPACED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?]*(?:\s|\Z))|[.,;:!?]+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
#: The same for tokenizers that drop white space.
UNSPACED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?]*(?:\s|\Z))|[.,;:!?]+(?=\s|\Z)|\S+")
#: Characters that count as white space in one library only, and what may begin a special token: what holds one is encoded whole.
WHOLE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]|<\|")


#: Characters of the longest piece that a cache keeps, so that it is bounded in bytes too.
KEPT = 64


class UnitEncoder:
    """Ids of pieces as little-endian 32-bit integers. The cache holds about 2 * capacity pieces of KEPT characters at most, in two generations."""

    def __init__(self, path: str, pattern: re.Pattern, capacity: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pattern, self.capacity = pattern, capacity
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _ensure(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of the pieces that are too long to be kept; all others stand in young afterwards."""
        missing = [u for u in set(units) if u not in self.young]
        new = []
        for u in missing:
            if (ids := self.old.get(u)) is None:
                new.append(u)
            else:
                self.young[u] = ids
        long = {u: b"" for u in new if len(u) > KEPT}
        if long:
            long = dict(zip(long, self.library(list(long)), strict=True))
            new = [u for u in new if u not in long]
        if new:
            self.young.update(zip(new, self.library(new), strict=True))
        return long

    def _age(self) -> None:
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}

    def encode(self, units: list[str]) -> list[bytes]:
        long = self._ensure(units)
        got = [long[u] if u in long else self.young[u] for u in units] if long else list(map(self.young.__getitem__, units))
        self._age()
        return got

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        whole = [bool(WHOLE.search(t)) for t in texts]
        split = [[] if w else self.split(t) for t, w in zip(texts, whole, strict=True)]
        long = self._ensure(chain.from_iterable(split))
        get = (self.young | long).__getitem__ if long else self.young.__getitem__
        out = [self.library([t])[0] if w else b"".join(map(get, s)) for t, w, s in zip(texts, whole, split, strict=True)]
        self._age()
        return out


#: Classes of Latin-1 characters: 0 white space, 1 letters, 2 others, 3 those that WHOLE names.
_CLASS = np.array([3 if WHOLE.match(c) else 0 if c.isspace() else 1 if c.isalpha() else 2 for c in map(chr, range(256))], np.uint8)
_APOSTROPHE = ord("'")
#: How byte-level vocabularies write the bytes above 126 that stand for no visible character.
_BYTE_LEVEL = {c: 289 + i for i, c in enumerate([*range(127, 161), 173])}
#: Bytes of text that are cut into words at once.
WINDOW = 1 << 22
#: Bytes of words and ids in one generation of a cache.
WORD_BYTES = 24 << 20


class _Words:
    """Ids of distinct words, one after the other in one array."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places that the new words get."""
        n, used = len(self.at), int(self.ends[len(self.at)])
        if n + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(n + len(words), np.int64)])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used + len(ids), np.uint32)])
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.bytes += sum(map(len, words)) + 4 * len(ids)
        self.ends[n + 1 : n + 1 + len(words)] = used + lengths.cumsum()
        self.ids[used : used + len(ids)] = ids
        return np.arange(n, n + len(words))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after the other, and how many each has."""
        first = self.ends[which]
        lengths = self.ends[which + 1] - first
        ends = lengths.cumsum()
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class WordEncoder:
    """Ids of whole texts for a vocabulary that drops white space, ignores case and marks the ends of words.

    Latin-1 texts are cut into words by numpy, a whole slice at once: at white space and between letters and other characters, but
    not after an apostrophe (it may begin a contraction). Each distinct word of a slice is looked up once, and words not yet known
    go to the library in one text; the slice's ids are then gathered in one step. Other texts go piece by piece.
    The cache holds about 2 * capacity words, and 2 * WORD_BYTES and a window's words, in two generations.
    """

    def __init__(self, path: str, capacity: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.units = UnitEncoder(path, UNSPACED, capacity // 8)
        tokenizer = self.units.tokenizer
        # for words of letters in lower case, white space is all that the library's normalizer and patterns look for
        self.letters = Tokenizer(tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.capacity, self.young, self.old = capacity, _Words(), _Words()

    def _letter_ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words of Latin-1 letters in lower case."""
        texts = [b" ".join(words[at : at + 64]).decode("latin-1") for at in range(0, len(words), 64)]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(_BYTE_LEVEL) for t in texts]
        return np.array([i for e in self.letters.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words in another order, their ids in this order and the numbers of ids."""
        kind = np.array([0 if w.isalpha() else 1 if w.decode("latin-1").isalpha() else 2 for w in words], np.int8)
        plain, rest = np.concatenate([np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)]), np.flatnonzero(kind == 2)
        ids = self._letter_ids([words[i] for i in plain.tolist()])
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(plain):  # a word without an end of its own
            plain, rest, ids, ends = plain[:0], np.arange(len(words)), ids[:0], ends[:0]
        each = self.units.library([words[i].decode("latin-1") for i in rest.tolist()]) if len(rest) else []
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) // 4 for e in each], np.int64)])
        return np.concatenate([plain, rest]), np.concatenate([ids, np.frombuffer(b"".join(each), "<u4")]), lengths

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words in young, where they now all stand."""
        which = np.array([-1 if k is None else k for k in map(self.young.at.get, words)], np.int64)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            names = [words[i] for i in missing.tolist()]
            old = np.array([-1 if k is None else k for k in map(self.old.at.get, names)], np.int64)
            known, new = missing[old >= 0], missing[old < 0]
            which[known] = self.young.add([words[i] for i in known.tolist()], *self.old.take(old[old >= 0]))
            order, ids, lengths = self._new([words[i] for i in new.tolist()])
            which[new[order]] = self.young.add([words[i] for i in new[order].tolist()], ids, lengths)
        return which

    def _window(self, raw: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 bytes in lower case, and how many of them stand before each of stops."""
        x = np.frombuffer(raw, np.uint8)
        kind = _CLASS[x]
        inside = kind > 0
        cut, end = inside.copy(), inside.copy()
        cut[1:] &= (kind[1:] != kind[:-1]) & ~((kind[1:] == 1) & (x[:-1] == _APOSTROPHE))
        end[:-1] &= cut[1:] | ~inside[1:]
        starts, ends = np.flatnonzero(cut), np.flatnonzero(end) + 1
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(x[inside])]).dictionary_encode()
        which = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        ids, lengths = self.young.take(which)
        before = np.concatenate([[0], lengths.cumsum()])
        if len(self.young.at) > self.capacity or self.young.bytes > WORD_BYTES:
            self.old, self.young = self.young, _Words()
        return ids, before[np.searchsorted(starts, stops)]

    def _latin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        raw, stops = b"\n".join(texts), np.cumsum([len(t) + 1 for t in texts])
        ids, ends, done, at = [], np.zeros(len(texts), np.int64), 0, 0
        while at < len(raw):
            stop = len(raw)
            if stop - at > WINDOW and (space := _SPACE.search(raw, at + WINDOW)):
                stop = space.start()
            own = (stops > at) & (stops <= stop + 1)
            got, before = self._window(raw[at:stop], np.minimum(stops[own] - at, stop - at))
            ends[own] = done + before
            ids.append(got)
            done, at = done + len(got), stop + 1
        ends[stops > at] = done
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.diff(ends, prepend=0)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        latin, others = [], {}
        for i, t in enumerate(texts):
            try:
                raw = t.lower().encode("latin-1") if t.isascii() or t.encode("latin-1") is not None else b""
                plain = "<|" not in t and len(raw.translate(None, _ODD)) == len(raw)
            except UnicodeEncodeError:
                plain = False
            if plain:
                latin.append(raw)
            else:
                others[i] = None
        ids, counts = self._latin(latin)
        if not others:
            return ids, counts
        others = dict(zip(others, self.units.texts([texts[i] for i in others]), strict=True))
        parts, total, at, k = [], [], 0, 0
        for i in range(len(texts)):
            if i in others:
                parts.append(np.frombuffer(others[i], "<u4"))
            else:
                parts.append(ids[at : at + counts[k]])
                at, k = at + counts[k], k + 1
            total.append(len(parts[-1]))
        return np.concatenate(parts), np.array(total, np.int64)


_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r\xa0]")
_ODD = b"\x1c\x1d\x1e\x1f\x85"
