"""pseudonymize() in plain Python, one text at a time."""

import datetime
import hashlib
import re

from corpusloom.llm import pii

FIRST = datetime.date(1900, 1, 1)


def stream(key, tweak, i, other):
    return hashlib.sha256("|".join([key, tweak, str(i), other, key]).encode()).hexdigest()


def shift(text, mask, hexadecimal):
    out = []
    for j, c in enumerate(text):
        by = int(mask[2 * (j % 32) : 2 * (j % 32) + 2], 16)
        for alphabet in ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]:
            if c in alphabet:
                c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
                break
        out.append(c)
    return "".join(out)


def string(text, key, tweak, hexadecimal=False):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(10):
        if i % 2 == 0:
            left = shift(left, stream(key, tweak, i, right), hexadecimal)
        else:
            right = shift(right, stream(key, tweak, i, left), hexadecimal)
    return left + right


def number(x, radix, key, tweak):
    left, right = divmod(x, radix[1])
    for i in range(20):
        if i % 2 == 0:
            left = (left + int(stream(key, tweak, i, str(right))[:13], 16)) % radix[0]
        else:
            right = (right + int(stream(key, tweak, i, str(left))[:13], 16)) % radix[1]
    return left * radix[1] + right


def fill(m, digits, kind="0123456789"):
    new = iter(digits)
    return "".join(next(new) if c in kind else c for c in m)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def date(m, key):
    p = [int(x) for x in re.split("[-/.]", m)]
    iso = "-" in m
    american = "/" in m and p[0] <= 12 < p[1]
    y, mo, d = p if iso else (p[2], p[0], p[1]) if american else (p[2], p[1], p[0])
    try:
        value = datetime.date(y, mo, d)
    except ValueError:
        return None
    if not 1900 <= y <= 2099:
        return None
    new = FIRST + datetime.timedelta(number((value - FIRST).days, pii.DAYS, key, "date"))
    width = "" if any(len(x) == 1 for x in re.split("[-/.]", m)) else "02"
    day, month, mark = format(new.day, width), format(new.month, width), re.search("[-/.]", m)[0]
    return mark.join([str(new.year), month, day] if iso else [day, month, str(new.year)])


def one(m, key):
    """(pseudonym, kind) of a match, or None."""
    full = lambda p: re.fullmatch(p, m)
    if "@" in m:
        name, host = m.split("@")
        found = re.match(r"(.*)(\.[A-Za-z]{2,})", re.split(r"\.\.|\.-|-\.", host)[0])
        if not found:
            return None
        n = len(name) + 1 + found.end()
        return string(name + "@" + found[1], key, "email") + found[2] + m[n:], "email"
    if ":" in m:
        groups = [g for g in m.split(":") if g]
        wide = m.count("::") == 1 and ":::" not in m and 2 <= len(groups) <= 7 or "::" not in m and len(groups) == 8
        if not wide or re.search("(?<!:):$", m) or max(map(len, groups)) > 4 or not re.search("[0-9]", m):
            return None
        new = string(m.lower(), key, "ipv6", True)
        return new.upper() if m.upper() == m != m.lower() else new, "ipv6"
    if full("[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"):
        d = m.replace(" ", "")
        if mod97(d[4:] + d[:4]) != 1:
            return None
        body = string(d[4:], key, "iban")
        return fill(m, f"{d[:2]}{98 - mod97(body + d[:2] + '00'):02d}{body}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "iban"
    if full(r"\d{1,3}(\.\d{1,3}){3}"):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        p = number(int.from_bytes(bytes(o), "big"), (65536, 65536), key, "ip")
        return ".".join(map(str, p.to_bytes(4, "big"))), "ip"
    if full(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"):
        return (new, "date") if (new := date(m, key)) else None
    if full(r"\d{3}-\d{2}-\d{4}"):
        a, g, n = map(int, m.split("-"))
        if a in (0, 666) or a > 899 or not g or not n:
            return None
        p = number(((a - 2 if a > 666 else a - 1) * 99 + g - 1) * 9999 + n - 1, pii.SSNS, key, "ssn")
        a, rest = divmod(p, 99 * 9999)
        return f"{a + 2 if a >= 665 else a + 1:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}", "ssn"
    d = re.sub("[^0-9]", "", m)
    if full(r"\d([ -]?\d){12,18}") and luhn(d) == 0:
        body = d[0] + string(d[1:-1], key, "card")
        return fill(m, body + str(-luhn(body + "0") % 10)), "card"
    if full(r"\d{10}") or 10 <= len(d) <= 15 and re.search("[+ .()-]", m):
        code = re.match(pii.COUNTRY, d)[0] if m[0] == "+" else ""
        return fill(m, code + string(d[len(code) :], key, "phone")), "phone"
    return None


def pseudonymize(text, key):
    """The text and the numbers of values by kind."""
    counts = dict.fromkeys(pii.KINDS, 0)
    if text is None:
        return None, counts
    out, at = [], 0
    for m in re.finditer(pii.ANY, text, re.A):
        new, kind = one(m[0], key) or (m[0], None)
        if kind:
            counts[kind] += 1
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join(out) + text[at:], counts
