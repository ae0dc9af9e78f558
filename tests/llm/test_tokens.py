"""op1 and op9: exact agreement with the library, round trips, and random access."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from corpusloom.llm import _units, bpe, wavelet


PIECES = ["a", "b", "é", "'", "'s", "'t", " ", "  ", "\n", "\t", ".", ",", "1", "22", "中", "ß", "́", "re", "<", "|", "Hello", "world", " ", "　", "😀", "!", "_", "-", "İ", "Σ", "\x1c", "\x85"]


def texts(seed=3, n=200):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(0, 1500))) for _ in range(n)]
    return out + ["", "a" * 20000, " " * 9000, "'" * 5000, "foo<|endoftext|>bar  <|endoftext|> x" * 30] + [a[:400] + out[i * 7 % n][100:900] for i, a in enumerate(out[:60])]


@pytest.mark.parametrize("bits,least", [(4, 8), (10, 128)])
def test_chunks_agree_with_library(monkeypatch, bits, least):
    monkeypatch.setattr(bpe, "MASK_BITS", bits)
    monkeypatch.setattr(bpe, "LEAST", least)
    enc = bpe.ChunkEncoder(path("byte_bpe_50k.json"), capacity=50)
    enc.units.capacity = 300
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = texts()
    for got, text in zip(enc.encode(rows), rows, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert bpe.decode(want, path("byte_bpe_50k.json")) == lib.decode(want, skip_special_tokens=False)
    assert enc.reused > 0


def test_odd_characters_leave_the_rest_to_chunks():
    enc, lib = bpe.ChunkEncoder(path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    plain = " ".join(random.Random(4).choices(["some", "words", "of", "text,", "and.", "more"], k=3000))
    rows = [f"{plain}{odd}{plain} {odd} {plain}" for odd in ("\u200b", "\x85", " \x1c ", "<|endoftext|>", " <| a", "a\u200d b", "\x85 b")]
    for got, text in zip(enc.encode(rows), rows, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert enc.reused > enc.encoded


def test_decode_invalid_bytes():
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = random.Random(1).choices(range(50257), k=500)
    assert bpe.decode(ids, path("byte_bpe_50k.json")) == lib.decode(ids, skip_special_tokens=False)


def word_ids(enc, rows):
    flat, counts = enc.texts(rows)
    return [x.astype("<u4").tobytes() for x in np.split(flat, counts.cumsum()[:-1])]


@pytest.mark.parametrize("window", [1, 50, 1 << 22])
def test_word_units_agree_with_library(monkeypatch, window):
    monkeypatch.setattr(_units, "WINDOW", window)
    enc = _units.WordEncoder(path("word_bpe_49k.json"), 300)
    latin = [x for x in PIECES if x.isascii() or x.encode("latin-1", "ignore")]
    rng = random.Random(2)
    rows = texts(5, 120) + ["".join(rng.choices(latin, k=rng.randint(0, 300))) for _ in range(100)] + ["it's 'tis don't ''s !'s x'S 1'll a'b'c", "ÀÉ ªº µ²³¼ x\xa0y \xad-", "", ""]
    assert word_ids(enc, rows) == enc.units.library(rows)
    assert word_ids(enc, rows[::-1]) == enc.units.library(rows[::-1])
    assert word_ids(enc, [""]) == [b""]


def test_pairs_of_latin_characters_agree_with_library():
    enc = _units.WordEncoder(path("word_bpe_49k.json"))
    rows = [" ".join(f"a{chr(i)}{chr(j)}b" for j in range(256)) for i in range(256)] + ["".join(f"{chr(i)}'{chr(j)}" for j in range(256)) for i in range(0, 256, 7)]
    assert word_ids(enc, rows) == enc.units.library(rows)


def test_edge_rows(spark, edge, empty):
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(str((r.doc_id, hashlib.sha256(np.array(lib.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())) for r in edge.collect())
    assert sorted(str((r.doc_id, r.ids_sha256, r.decoded_sha256)) for r in bpe.digest_documents(edge).collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(edge))
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in edge.collect())
    assert bpe.digest_documents(empty).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 70000):
        x = (rng.zipf(1.3, n) % 49408).astype(np.uint32)
        s = wavelet.Shard(wavelet.build(x, [3, None], [n, 0]))
        assert (s.tokens() == x).all() and s.doc_ids == [3, None] and s.count(60000) == 0
        for i in rng.integers(0, n, 20).tolist() if n else []:
            t = int(x[i])
            assert s.access(i) == t and s.count(t, 0, i) == (x[:i] == t).sum() and s.occurrence(t, int((x[:i] == t).sum())) == i
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


def test_shards(spark, edge, empty, docs, tmp_path):
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    for source in (edge, docs):
        rows = source.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
        rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text or ""))
        start, want = 0, []
        for r in rows:
            ids = lib.encode(r.text or "", add_special_tokens=False).ids + [wavelet.END_ID]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        for ranges in (1, 100):
            folder = tmp_path / f"{len(rows)}-{ranges}"
            files = wavelet.write_shards(source, docs_per_shard=3, max_tokens=500, max_ranges=ranges, directory=folder.as_uri())
            got = [tuple(r) for r in wavelet.read_shards(files).collect()]
            assert sorted(got, key=lambda r: r[1]) == want
            told = {r.file.rsplit("/", 1)[1]: r for r in files.collect()}
            assert set(told) == {f.name for f in folder.iterdir()} and all(r.n_docs <= 3 and r.n_docs == wavelet.open_shard(r.file).n_docs for r in told.values())
    assert wavelet.read_shards(wavelet.write_shards(empty)).count() == 0
    assert len(wavelet.read_shards(wavelet.write_shards(docs)).collect()) == docs.count()


def test_text_without_agreement_is_split_a_bounded_number_of_times(monkeypatch):
    """A long text in which no two encodings agree: exact, and its characters are split in proportion to its length."""
    rng = random.Random(3)
    enc = bpe.ChunkEncoder(path("byte_bpe_50k.json"))
    seen = []
    split = enc.units.split
    monkeypatch.setattr(enc.units, "split", lambda t: seen.append(len(t)) or split(t))
    for n in (20_000, 160_000):
        seen.clear()
        text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
        assert enc.encode([text]) == enc.units.library([text])
        assert sum(seen) < 16 * n
    mixed = " ".join("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.randint(1, 9000))) + " and words, too" for _ in range(40))
    assert enc.encode([mixed]) == enc.units.library([mixed])


def test_caches_keep_no_long_pieces():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    units = _units.UnitEncoder(path("byte_bpe_50k.json"), _units.SPACED)
    text = " ".join(word(rng.choice([3, 64, 65, 5000])) for _ in range(300))
    assert units.texts([text]) == units.library([text])
    assert max(map(len, units.young)) <= _units.KEPT
    words = _units.WordEncoder(path("word_bpe_49k.json"))
    for _ in range(12):
        words.texts([" ".join(word(20_000) for _ in range(200))])
        assert words.young.bytes < _units.WORD_BYTES + 3 * _units.WINDOW
