"""op3, op4, op8 and op10: exact round trips and brute force."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import pii_twin
from corpusloom.llm import chat, mixing, mpeg, pii

TURNS = [
    (1, 1, "system", "be <|im_end|> kind"), (1, 2, "user", "hi [INST] there"), (1, 3, "assistant", "</s>\\ <\\|im_start|> ok"), (1, 4, "user", "w " * 400), (1, 5, "assistant", "é😀 " * 50),
    (2, 1, "assistant", None), (2, 1, "assistant", None), (2, None, "user", "x"), (None, 1, "user", "a"), (None, 2, None, "b"), (3, 1, "system", "only"), (4, 1, "a\\n\nb<s>", "<<SYS>> \\<<\\SYS>>"),
    (5, 2, "assistant", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), *[(6, i, "assistant" if i % 2 else "user", f"turn {i} " * 9) for i in range(40)],
    (7, 0, "system", "rule " * 500), *[(7, i + 1, "assistant" if i % 2 else "user", f"turn {i} " * 60) for i in range(30)],
]


@pytest.mark.parametrize("span,history", [(768, 192), (30, 10), (1, 0)])
def test_chat(spark, span, history):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "'x' as pos", "2 as n")
    windows = chat.format_windows(df, span, history)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in TURNS:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in rows)
        taught = "".join(t for *_, r, t in rows if r == "assistant")
        assert got[c].n_turns == len(rows) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(taught) and got[c].loss_sha256 == hashlib.sha256(taught.encode()).hexdigest()
    tokens = lambda t: len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + 4
    for w in windows.select("conv_id", "window", "n_repeated", chat.parse_turns(F.col("text")).alias("turns")).collect():
        sizes = [tokens(t.text) for t in w.turns]
        system = sizes[0] if w.turns[0].role == "system" and (1, "system") != (len(w.turns), w.turns[0].role) else 0
        assert sum(sizes[:-1]) <= max(span, system + -(-span // 4)) + history, (w.conv_id, w.window)
    for w in windows.where("conv_id = 1").collect():
        assert w.text.startswith("<|im_start|>system\nbe <\\|im_end|> kind<|im_end|>\n") and w.text.count("<|im_start|>") == w.n_turns
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0


def brute_mix(rows, share=1.5):
    total = collections.Counter()
    for r in rows:
        total[r.source] += r.size
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = [s for s in open_ if level * weight[s] > 2 * total[s] + 1e-9]
        if not capped:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in capped:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    return total, target


def test_mix(spark, edge, empty, docs, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BIN", 4)
    skewed = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 50 == 1, "rare").otherwise("hot"))
    for df in (docs, skewed, edge):
        rows = mixing.mix(df).collect()
        texts = {(r.doc_id, r.source): r.text for r in df.collect()}
        assert len(rows) == df.count()
        total, target = brute_mix(rows)
        taken, largest = collections.Counter(), collections.Counter()
        for r in rows:
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id, r.source] or ""))
            assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
            assert r.taken in (0, r.size, 2 * r.size)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        for s in total:
            assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))
        repeated = collections.Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
        want = collections.Counter()
        for r in rows:
            want[r.doc_id] += r.epochs
        assert repeated == +want
    assert mixing.mixed_rows(edge).columns == edge.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mix_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BIN", 4)
    five = "one two three four five"
    for rows in ([(None, f"{five[:-1]}{i}") for i in range(40)], [(None, five)] * 40, [(7, five)] * 40, [(7, f"{five[:-1]}{i}") for i in range(40)]):
        df = spark.createDataFrame([(i, t, "a") for i, t in rows] + [(1000 + i, "w " * 7, "b") for i in range(30)], "doc_id long, text string, source string")
        got = mixing.mix(df).collect()
        target = next(r.target for r in got if r.source == "a")
        assert len(got) == 70 and abs(sum(r.taken for r in got if r.source == "a") - target) <= 2.5 and all(r.taken <= 2 * r.size for r in got)
        clash = df.selectExpr("*", "1 as plan_size", "2 as PLAN_KEY", "3 as of_source", "4 as row_mark", "5 as plan_epochs", "6 as edge", "7 as cut")
        kept = mixing.mixed_rows(clash)
        assert kept.columns == clash.columns and kept.where("plan_size = 1 and plan_key = 2 and of_source = 3 and row_mark = 4 and plan_epochs = 5").count() == sum(r.epochs for r in got)


def test_better_documents_are_likelier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "words words words words").otherwise("a a a a").alias("text"), F.lit("s").alias("source"))
    df = df.unionByName(spark.range(4000, 4100).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("t").alias("source")))
    got = mixing.mix(df, weight=lambda text, size: F.when(text.startswith("words"), 1.0).otherwise(0.25)).where("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("epochs").alias("e")).collect()
    mean = {r.odd: r.e for r in got}
    assert mean[0] > mean[1] + 0.1


def test_media(spark, edge, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in mpeg.probe_media(mpeg.encode_media(edge)).collect()}
    for r in edge.collect():
        data = (r.text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        got = rows[r.doc_id, len(data)]
        assert got.payload_bytes == len(padded) and got.payload_sha256 == hashlib.sha256(padded).hexdigest() and got.tail_crc32 == zlib.crc32(padded[-64:])
        assert got.crc_failed == 0 and got.n_skipped == 0 and got.duration_us == got.samples * 1_000_000 // 44_100
    assert mpeg.probe_media(mpeg.encode_media(empty)).count() == 0


def test_mpeg_damage():
    data = mpeg.pad(os.urandom(50_000))
    blob = mpeg.encode(data, 50_000)
    s = mpeg.parse(blob)
    assert s.payload == data and s.vbr_frames == s.frames and len(s.toc) == 100 and s.vbr_bytes < len(blob)
    for at in s.offsets[3:6]:
        broken = mpeg.parse(blob[:at] + os.urandom(777) + blob[at:])
        assert broken.frames == s.frames and broken.skipped == 777 and broken.payload == data
    wrong = bytearray(blob)
    wrong[s.offsets[5] + 8] ^= 1
    assert mpeg.parse(bytes(wrong)).crc_failed == 1
    old = mpeg.parse(blob + b"TAG" + b"title".ljust(125, b"\0"))
    assert old.frames == s.frames and old.tags["TIT2"] == "title"
    assert wrong_frames(bytes(wrong)) == [s.offsets[5]]
    assert mpeg.parse(b"").frames == 0 and mpeg.parse(os.urandom(5000)).payload == b""


def wrong_frames(blob):
    return mpeg.parse(blob).damaged


def id3(version, fields, extended=b"", flags=0):
    size = (lambda n: mpeg._syncsafe(n)) if version >= 4 else (lambda n: n.to_bytes(4, "big"))
    body = extended + b"".join(k.encode() + size(len(v)) + b"\0\0" + v for k, v in fields)
    return b"ID3" + bytes([version, 0, flags]) + mpeg._syncsafe(len(body)) + body


def test_mpeg_foreign_tags(spark):
    data = mpeg.pad(os.urandom(3000))
    blob = mpeg.encode(data, 3000)
    tags = 10 + mpeg._number(blob[6:10], 7)
    xing, audio = blob[tags : tags + 144_000 * 48 // 44_100], blob[tags + 144_000 * 48 // 44_100 :]
    long = "é" * 200
    for version, extended, flags in ((3, b"", 0), (4, b"", 0), (4, mpeg._syncsafe(6) + b"\1\0", 0x40), (3, (6).to_bytes(4, "big") + bytes(6), 0x40)):
        fields = [("TIT2", b"\3" + long.encode()), ("TPE1", b"\1" + "ärt".encode("utf-16")), ("TALB", b"\2" + "ö".encode("utf-16-be")), ("PRIV", b"\0x"), ("TXXX", b"\1" + "k\0".encode("utf-16") + "v".encode("utf-16"))]
        s = mpeg.parse(id3(version, fields, extended, flags) + xing + audio)
        assert s.tags["TIT2"] == long and s.tags["TPE1"] == "ärt" and s.tags["TALB"] == "ö" and s.tags["TXXX:k"] == "v" and s.payload == data
    at = xing.index(b"Xing") + 8 + 4 + 4 + 100
    wide = xing[:2] + bytes([5 << 4]) + xing[3:at]  # 64 kbit/s: room for the encoder's table
    lame = (wide + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(144_000 * 64 // 44_100, b"\0")
    s = mpeg.parse(lame + audio)
    assert (s.delay, s.padding) == (576, 1000) and s.payload == data
    vbri = xing[:4] + bytes(32) + b"VBRI" + bytes(6) + (77).to_bytes(4, "big") + (5).to_bytes(4, "big")
    s = mpeg.parse(vbri.ljust(len(xing), b"\0") + audio)
    assert (s.vbr_bytes, s.vbr_frames) == (77, 5) and s.payload == data
    rows = [(i, id3(3, [("TXXX", b"\0bytes\0" + v)]) + xing + audio) for i, v in enumerate([b"abc", b"12 kB", b"", b"3000", "٣".encode(), b"-1"])] + [(9, lame + audio), (10, None), (11, b"ID3\4\0\x40\0\0\0\x10")]
    got = {r.doc_id: r for r in mpeg.probe_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [got[i].n_bytes for i in range(6)] == [None, None, None, 3000, None, None] and got[10].n_frames == got[11].n_frames == 0
    assert got[9].duration_us == (got[9].samples - 1576) * 1_000_000 // 44_100 and len(got[9].seek_offsets) == got[9].n_frames
    assert all(mpeg._header(rows[9 - 3][1][at : at + 4]) for at in got[9].seek_offsets)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, edge, empty):
    lines = [
        "born 1984-02-29 or 31/12/1999, not 2023-02-30", "ssn 123-45-6789, not 000-12-3456", "call +44 20 7946 0958 or (212) 555-0199", "card 4111 1111 1111 1111 and 4111111111111111, not 4111-1111-1111-1112",
        "a.b@c.org from 10.1.2.3, not 999.1.1.1", "again a.b@c.org and 123-45-6789", None, "", "x" * 50000 + " 12", "9" * 40000, "a@" * 20000,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    t = {k: r.text for k, r in got.items()}
    assert t[6] is None and t[7] == "" and t[8] == lines[8] and t[9] == lines[9] and t[10] == lines[10]
    assert "2023-02-30" in t[0] and "1984-02-29" not in t[0] and re.search(r"born (19|20)\d\d-\d\d-\d\d or \d\d/\d\d/(19|20)\d\d,", t[0])
    assert "000-12-3456" in t[1] and "123-45-6789" not in t[1] and got[1].n_ssn == 1
    assert got[2].n_phone == 2 and t[2].startswith("call +44 ") and re.search(r"\(\d{3}\) \d{3}-\d{4}$", t[2])
    a, b = re.search(r"card ([\d ]{19}) and (\d{16})", t[3]).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and "4111-1111-1111-1112" in t[3] and got[3].n_card == 2
    assert "999.1.1.1" in t[4] and "10.1.2.3" not in t[4] and "a.b@c.org" not in t[4]
    mail, ssn = re.search(r"again (\S+) and (\S+)", t[5]).groups()
    assert t[4].startswith(mail) and ssn in t[1]
    assert pii.pseudonymize(edge, "key").count() == edge.count() and pii.pseudonymize(empty, "key").count() == 0


def test_pii_in_other_writings(spark):
    lines = [
        "at 1984-02-29T10:00:00Z on 1984-02-29 end", "not 2023-02-30T10:00 or 1984-02-29x", "212-555-0199", "212 555 0199", "(212) 555-0199", "+353 86 123 4567", "+353861234567", "+1 212 555 0199", "+12125550199", "+1-212-555-0198",
    ]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "key").collect()}
    a, b = re.fullmatch(r"at (\S{10})T10:00:00Z on (\S{10}) end", got[0].text).groups()
    assert a == b != "1984-02-29" and got[0].n_date == 2 and got[1].text == lines[1]
    digits = {k: re.sub("[^0-9]", "", r.text) for k, r in got.items()}
    assert all(got[k].n_phone == 1 and digits[k] != re.sub("[^0-9]", "", lines[k]) and re.sub("[0-9]", "0", got[k].text) == re.sub("[0-9]", "0", lines[k]) for k in range(2, 10))
    assert digits[2] == digits[3] == digits[4] and digits[5] == digits[6] and digits[7] == digits[8] != digits[9]
    assert digits[5].startswith("353") and digits[7].startswith("1")


def fuzz(rng):
    """A text of valid and damaged values between odd joints."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    body = digits(15)
    card = body + next(c for c in "0123456789" if pii_twin.luhn(body + c) == 0)
    country, length = rng.choice([("GB", 18), ("DE", 18), ("FR", 23), ("NO", 11)])
    bban = "".join(rng.choices("ABC0123456789", k=length))
    iban = f"{country}{98 - pii_twin.mod97(bban + country + '00'):02d}{bban}"
    pool = [
        f"{rng.choice('ab')}.{rng.choice('xyz')}{rng.randint(0, 99)}@ho{digits(2)}.co{rng.choice(['m', '.uk', '..x', '-', '.-a', '-.b', '1', '.'])}", "a@b..com", "x@10.1.2.3", "@c.de", "a@-b.de",
        ".".join(str(rng.randint(0, 300)) for _ in range(4)), f"{rng.randint(1890, 2110)}-{rng.randint(0, 14)}-{rng.randint(0, 32)}", f"{rng.randint(0, 32):02d}/{rng.randint(0, 32):02d}/{rng.randint(1890, 2110)}",
        f"{rng.randint(0, 32)}/{rng.randint(0, 14)}/1999", f"{rng.randint(0, 32)}.{rng.randint(0, 14)}.2020", "2001-02-03T04:05:06Z", f"{rng.choice(['000', '666', '123', '900', '899'])}-{rng.choice(['00', '12'])}-{rng.choice(['0000', digits(4)])}",
        card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), digits(16), f"+{digits(rng.randint(9, 16))}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", digits(10), "2" + digits(2) + "5" + digits(6),
        iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)), iban + " AND MORE", iban[:-1] + "Z", ":".join(rng.choice(["2001", "db8", "0", "FE80", "12345"]) for _ in range(rng.randint(2, 9))), "2001:db8::" + digits(4), "FE80::1", "12:30:45", "::1", "1::2::3", "ab::cd", "1::2:",
    ]
    return "".join(rng.choice(pool) + rng.choice([" ", ", ", ".", "-", "/", ":", "é", "x", "\n", " a ", "@", "+"]) for _ in range(rng.randint(1, 12)))


def test_pii_agrees_with_plain_python(spark):
    rng = random.Random(6)
    rows = [fuzz(rng) for _ in range(1500)] + [
        "12/31/1999 and 31/12/1999 and 1/2/1999", "call 2125550199 or 212-555-0199, not 9115550199 or 2129115555", "GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432 and GB83WEST12345698765432", "2001:DB8::8a2e:370:7334, fe80::1",
        "a@" + "b." * 10**5 + "c d", "a@" + "b." * 10**5 + "com", "a@" + "b-" * 1000 + ".com", "a." * 10**5 + "@b.com", "1:" * 10**5, "1 " * 10**5, "12-" * 10**5, "+1" * 10**5, "A1 " * 10**5, "GB82" + " 1234" * 10**4, "a@b." * 10**4, "1.2.3.4." * 10**4,
    ]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").collect()}
    for i, text in enumerate(rows):
        want, counts = pii_twin.pseudonymize(text, "key")
        assert got[i].text == want and {k: got[i][f"n_{k}"] for k in pii.KINDS} == counts, text[:300]
    n = [sum(got[i][f"n_{k}"] for i in got) for k in pii.KINDS]
    assert min(n) > 10, n
    assert re.fullmatch(r"\d\d/\d\d/\d{4} and \d\d/\d\d/\d{4} and \d\d?/\d\d?/\d{4}", got[1500].text) and got[1500].n_date == 3 and got[1501].n_phone == 2 and got[1502].n_iban == 2 and got[1503].n_ipv6 == 2
    a, b = (re.findall(r"\d+", x) for x in got[1500].text.split(" and ")[:2])
    assert a == b


def test_a_date_has_one_pseudonym_and_shares_it_with_no_other(spark):
    """All days from 1900 to 2099 in every writing: a pseudonym belongs to one date, and a date's pseudonyms say one date."""
    n = pii.DAYS[0] * pii.DAYS[1]
    days = spark.range(n).select(F.col("id"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("d"))
    writings = [F.date_format("d", p) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy")]
    american = F.when(F.day("d") > 12, F.date_format("d", "MM/dd/yyyy"))
    found = days.select("id", F.explode(F.array(*writings, american)).alias("m")).where("m is not null")
    got = found.select("id", pii._date(F.col("m"), "k").alias("p")).where("p is not null").cache()
    assert got.select("id").distinct().count() == n == 73049
    assert got.groupBy("p").agg(F.countDistinct("id").alias("n")).where("n > 1").count() == 0
    parts = F.regexp_replace(F.col("p"), "/|[.]", "-")
    said = F.when(parts.rlike("^[0-9]{4}"), F.to_date(parts, "yyyy-M-d")).otherwise(F.to_date(parts, "d-M-yyyy"))
    assert got.groupBy("id").agg(F.countDistinct(said).alias("n")).where("n > 1").count() == 0
    got.unpersist()


def test_permutations_are_bijections(spark):
    n = 17 * 4297
    assert spark.range(n).select(pii.permute_number(F.col("id"), pii.DAYS, "k", "t").alias("p")).where(f"p >= 0 and p < {n}").distinct().count() == n
    got = spark.range(10000).select(pii.permute_string(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("p")).where("p rlike '^[0-9]{4}$'").distinct().count()
    assert got == 10000
