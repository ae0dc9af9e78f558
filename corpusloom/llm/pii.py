"""PII: validated numbers, dates and addresses become pseudonyms of the same format. DataFrame expressions only.

A pseudonym is a keyed permutation of the values of one format, so equal values get equal pseudonyms in all documents and
different ones stay different. Strings go through a Feistel network over their characters: in each round the letters and
digits of one half are shifted, within their own class, by a key stream hashed from the other half. IP addresses, US social
security numbers and dates go through a Feistel network over two residues whose product is exactly the number of valid values.

email  all before the last dot of the host; labels are not empty and don't begin or end with a hyphen
ip     four numbers up to 255
date   a calendar date from 1900 to 2099, as y-m-d (a time may follow after T), d/m/y, m/d/y where the second number can only be the
       day, or d.m.y; written without leading zeros where the date found is. All pseudonyms between slashes are d/m/y: m/d/y
       would read as another date's d/m/y
ssn    a valid area, group and serial number
card   13-19 digits that pass the Luhn check; the first stays, the check digit is made anew
phone  10-15 digits in groups, or ten in a row with a valid North American area and exchange; the country code and the separators
       stay, and the digits alone make the pseudonym
iban   of its country's length, with the right remainder by 97; the country stays, the check digits are made anew
ipv6   eight groups of hexadecimal digits, or two at least around one ::, with a digit; equal addresses in other writings differ

No pattern repeats a group without a bound, which Java's matcher would do by recursion: the run time is linear in the text and the
stack's depth doesn't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import between, bind, matches

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = (
    r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?=[Tt][0-9]{2}|(?![0-9A-Za-z/-]))"
    r"|(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z/-]))"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{10,15}(?![0-9A-Za-z])"
)
#: Ten digits in a row: area and exchange begin with 2 to 9 and don't end with 11.
TEN = r"(?<![0-9A-Za-z.,+-])[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{6}(?![0-9A-Za-z])"
#: Lengths of IBANs by country (ISO 13616).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def _iban() -> str:
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS:
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    own = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{own})(?![0-9A-Za-z])"


IBAN = _iban()
IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{0,34}:)[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:]|\.[0-9])"
ANY = "|".join([EMAIL, IP, DATE, SSN, CARD, PHONE, TEN, IBAN, IPV6])
#: Country codes by their digits alone, however they are set off.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = ["email", "ip", "date", "ssn", "card", "phone", "iban", "ipv6"]

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Areas 001-899 without 666, groups 01-99, serials 0001-9999.
SSNS = (898, 99 * 9999)


def _stream(key: str, tweak: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other, F.lit(key)), 256)


def _shift(text: Column, stream: Column, hexadecimal: bool) -> Column:
    def one(c, j, mask):
        by = F.conv(F.substring(mask, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        if hexadecimal:
            value = F.when(code.between(48, 57), code - 48).otherwise(code - 87)
            return F.when(c == ":", c).otherwise(F.lower(F.hex(((value + by) % 16).cast("long"))))
        moved = lambda base, n: F.char(F.lit(base) + (code - base + by) % n)
        return F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return bind(stream, lambda mask: F.array_join(F.transform(chars, lambda c, j: one(c, j, mask)), ""))


def permute_string(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """Feistel network over an ASCII string; digits, lower-case and upper-case letters stay such, all else stays as it is.

    hexadecimal: digits and the letters a to f are one class, and only colons stay.
    """
    cut = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shift(acc["l"], _stream(key, tweak, i, acc["r"]), hexadecimal)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(_shift(acc["r"], _stream(key, tweak, i, acc["l"]), hexadecimal)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_number(x: Column, radix: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel network over 0 .. radix[0] * radix[1] - 1."""
    a, b = radix
    start = F.struct(F.floor(x.cast("long") / F.lit(b)).cast("long").alias("l"), F.pmod(x.cast("long"), F.lit(b)).cast("long").alias("r"))

    def step(acc, i):
        mix = lambda other: F.conv(F.substring(_stream(key, tweak, i, other.cast("string")), 1, 13), 16, 10).cast("long")
        even = i % 2 == 0
        return F.struct(F.when(even, (acc["l"] + mix(acc["r"])) % a).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise((acc["r"] + mix(acc["l"])) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(m: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """m with its digits (or characters of another kind) replaced by others, one by one."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def fill(new):
        def step(acc, c):
            digit = c.rlike(kind)
            return F.struct((acc["k"] + digit.cast("int")).alias("k"), F.concat(acc["out"], F.when(digit, F.substring(new, acc["k"], F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(m, ""), start, step, lambda acc: acc["out"])

    return bind(digits, fill)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permute_string(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _fill(m, bind(body, lambda x: F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    code = F.when(m.startswith("+"), F.regexp_extract(d, COUNTRY, 0)).otherwise("")
    return _fill(m, F.concat(code, permute_string(F.substring(d, F.length(code) + 1, F.length(d)), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    part = lambda i: F.get(o, F.lit(i)).cast("long")
    p = permute_number(((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3), (65536, 65536), key, "ip")
    return bind(p, lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    x = (F.when(area > 666, area - 2).otherwise(area - 1)) * SSNS[1] + (group - 1) * 9999 + serial - 1

    def write(p):
        a, rest = F.floor(p / F.lit(SSNS[1])).cast("int"), F.pmod(p, F.lit(SSNS[1]))
        return F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1), F.floor(rest / F.lit(9999)).cast("int") + 1, F.pmod(rest, F.lit(9999)).cast("int") + 1)

    return bind(permute_number(x, SSNS, key, "ssn"), write)


def _date_parts(m: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whether m is y-m-d, whether m/d/y, year, month, day."""
    iso, p = F.length(F.regexp_extract(m, "^([0-9]+)", 1)) == 4, F.split(m, "[-/.]")
    num = lambda i: F.get(p, F.lit(i)).cast("int")
    american = m.contains("/") & (num(0) <= 12) & (num(1) > 12)
    return iso, american, F.when(iso, num(0)).otherwise(num(2)), F.when(american, num(0)).otherwise(num(1)), F.when(iso, num(2)).when(american, num(1)).otherwise(num(0))


def _date_value(m: Column) -> Column:
    """The date, or null if there is no such day from 1900 to 2099."""
    *_, y, mo, d = _date_parts(m)
    found = F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    return F.when(y.between(1900, 2099), found)


def _date(m: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    iso = _date_parts(m)[0]
    padded, mark = ~m.rlike("(?<![0-9])[0-9](?![0-9])"), F.regexp_extract(m, "[-/.]", 0)

    def write(days):
        new = F.date_add(first, days.cast("int"))
        day = F.when(padded, F.date_format(new, "dd")).otherwise(F.date_format(new, "d"))
        month = F.when(padded, F.date_format(new, "MM")).otherwise(F.date_format(new, "M"))
        year = F.date_format(new, "yyyy")
        return F.when(iso, F.concat(year, mark, month, mark, day)).otherwise(F.concat(day, mark, month, mark, year))

    return bind(permute_number(F.datediff(_date_value(m), first), DAYS, key, "date"), write)


def email_value(m: Column) -> Column:
    """The address at the start of a match of EMAIL, as far as its host is one; empty if it isn't."""
    host = F.get(F.split(F.regexp_extract(m, "@(.*)", 1), r"\.\.|\.-|-\."), F.lit(0))
    return F.concat(F.regexp_extract(m, "^[^@]*@", 0), F.nullif(F.regexp_extract(host, r"^(.*\.[A-Za-z]{2,})", 1), F.lit("")))


def _email(m: Column, key: str) -> Column:
    def write(value):
        cut = F.length(value) - F.length(F.substring_index(value, ".", -1)) - 1  # before the last dot
        return F.concat(permute_string(F.substring(value, F.lit(1), cut), key, "email"), F.substring(m, cut + 1, F.length(m)))

    return bind(email_value(m), write)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and capital letters, which count as 10 to 35."""
    step = lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban_check(m: Column) -> Column:
    d = F.replace(m, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1


def _new_iban(m: Column, key: str) -> Column:
    d = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(d, 1, 2), permute_string(F.substring(d, F.lit(5), F.length(d)), key, "iban")
    check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
    return _fill(m, bind(body, lambda x: F.concat(country, check(x), x)), "[A-Z0-9]")


def _ipv6_check(m: Column) -> Column:
    halves = F.split(m, "::")
    groups = F.filter(F.split(m, ":"), lambda g: g != "")
    compressed = (F.size(halves) == 2) & F.size(groups).between(2, 7)
    clean = ~F.contains(m, F.lit(":::")) & ~m.rlike("(?<!:):$") & F.forall(groups, lambda g: F.length(g) <= 4) & m.rlike("[0-9]")
    return clean & (compressed | ((F.size(halves) == 1) & (F.size(groups) == 8)))


def _ipv6(m: Column, key: str) -> Column:
    new = permute_string(F.lower(m), key, "ipv6", hexadecimal=True)
    return F.when((F.upper(m) == m) & (F.lower(m) != m), F.upper(new)).otherwise(new)


def kind_of(m: Column) -> Column:
    """Index in KINDS of a match of ANY whose value is valid, else null."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    digits = F.length(_digits(m))
    octets = F.forall(F.split(m, r"\."), lambda o: o.try_cast("int") <= 255)
    ssn = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return (
        F.when(m.contains("@"), F.when(email_value(m).isNotNull(), 0))
        .when(m.contains(":"), F.when(_ipv6_check(m), 7))
        .when(whole(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), F.when(_iban_check(m), 6))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(octets, 1))
        .when(whole(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"), F.when(_date_value(m).isNotNull(), 2))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(ssn, 3))
        .when(whole(r"[0-9](?:[ -]?[0-9]){12,18}") & (_luhn(_digits(m)) % 10 == 0), 4)
        .when(whole(r"[0-9]{10}") | (digits.between(10, 15) & m.rlike("[+ .()-]")), 5)
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == 0, _email(m, key)).when(kind == 1, _ip(m, key)).when(kind == 2, _date(m, key)).when(kind == 3, _ssn(m, key))
        .when(kind == 4, _card(m, key)).when(kind == 5, _phone(m, key)).when(kind == 6, _new_iban(m, key)).when(kind == 7, _ipv6(m, key)).otherwise(m)
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values of each kind. A null text stays null, with zeros.

    Numbers that fail their kind's check stay as they are. A plan shows the key: take it from a secret store for real use.
    """
    text = F.col(text_col).cast("string")
    found = F.when(text.rlike("[0-9@]"), matches(text, ANY)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    rows = rows.withColumn("found", F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    new = F.transform("found", lambda x: pseudonym(x["m"], x["kind"], key))
    gaps = between(F.col("text"), ANY)
    pieces = F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), *counts)
