"""Whole-line verbalisation of Egyptian Arabic. Each step rewrites what the steps before left, so a line goes through one function.

On a table this runs on Arrow batches; a line that can't be read (a number of 10^15 and more) keeps that number unread and then
loses it with all else that isn't Arabic, so no line fails a job.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from . import chars, latin
from .numbers import ORDINALS, say, say_date, say_decimal, say_digits, say_phone, say_time

# Abbreviations, currencies, symbols, fractions, pauses.
ABBREVIATIONS = {
    "د.": "دكتور", "د/": "دكتور", "أ.د": "استاذ دكتور", "ا.د": "استاذ دكتور", "م.": "مهندس", "م/": "مهندس", "أ.": "استاذ", "ا.": "استاذ",
    "ص.ب": "صندوق بريد", "ش.": "شارع", "ق.م": "قبل الميلاد", "ب.م": "بعد الميلاد", "الخ": "الى اخره", "إلخ": "الى اخره", "ج.م": "جنيه مصري",
    "كج": "كيلو جرام", "كم": "كيلو متر", "سم": "سنتي متر", "مم": "ملي متر", "هـ": "هجري",
}
CURRENCY = {
    "ج.م": "جنيه", "جنيه": "جنيه", "$": "دولار", "USD": "دولار", "€": "يورو", "EUR": "يورو", "£": "جنيه استرليني", "GBP": "جنيه استرليني",
    "ر.س": "ريال", "SAR": "ريال", "د.إ": "درهم", "AED": "درهم",
}
SYMBOLS = {"%": "في المية", "٪": "في المية", "&": "و", "@": "ات", "+": "زائد", "=": "يساوي", "°": "درجة", "×": "في", "÷": "على", "©": "حقوق النشر", "™": "علامة تجارية"}
FRACTIONS = {  # denominator: one, two, three to ten
    2: ("نص", "نصين", "انصاف"), 3: ("تلت", "تلتين", "تلات"), 4: ("ربع", "ربعين", "ارباع"), 5: ("خمس", "خمسين", "اخماس"), 6: ("سدس", "سدسين", "اسداس"),
    7: ("سبع", "سبعين", "اسباع"), 8: ("تمن", "تمنين", "اتمان"), 9: ("تسع", "تسعين", "اتساع"), 10: ("عشر", "عشرين", "اعشار"),
}
PAUSES = {"،": "،", ",": "،", ";": "،", "؛": "،", ":": "،", ".": ".", "؟": "؟", "?": "؟", "!": "!", "…": "."}
PERCENT, FROM, TO, OVER, PLUS, MORNING, EVENING = "في المية", "من", "لـ", "على", "زائد", "صباحا", "مساء"
# What the steps look for.
NUMBER = r"((?<!\d)\d+(?:[.,٫]\d+)?)"
MAIL_HOST = r"@[\w-]+\.[\w.-]+\b"
URL_START = r"\b(?:https?://|www\.)[^\s،,؛;]+"
URL_END = r"\.(?:com|net|org|edu|gov|eg|io|ai|co)\b(?:/[^\s،,؛;]*)?"
TIME = r"\b([01]?\d|2[0-3])[:٫:]([0-5]\d)(?:\s*(am|pm|ص|م))?\b"
DAY = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
MONTH = r"\b(\d{1,2})[/\-](\d{4})\b"
PHONE = r"(?<![\d])(?:\+?\d[\d\s-]{7,16}\d)(?![\d])"
UNIT = r"(ج\.م|جنيه|ر\.س|د\.إ|USD|EUR|GBP|SAR|AED|\$|€|£)"
THOUSANDS = r"\b\d{1,3}(?:[,٬]\d{3})+\b"
FRACTION = r"\b(\d+)\s*/\s*(\d+)\b"
RANGE = r"\b(\d+)\s*[-–]\s*(\d+)\b"
ORDINAL = r"\bال(\d+)\b"
DECIMAL = r"\b\d+[.,٫]\d+\b"
INTEGER = r"\d+"
LATIN = r"\b[A-Za-z][A-Za-z.]*\b"
PERCENT_SIGN, MONEY_BEFORE, MONEY_AFTER = NUMBER + r"\s*[%٪]", r"([$€£])\s*" + NUMBER, NUMBER + r"\s*" + UNIT


def _spaced(text: str | None, raw: str) -> str:
    return raw if text is None else f" {text} "


def _amount(raw: str) -> str | None:
    return say_decimal(raw.replace(",", ".").replace("٫", "."))


def _with(amount: str | None, unit: str) -> str | None:
    return None if amount is None else f"{amount} {unit}"


def _joined(*words: str | None) -> str | None:
    return None if None in words else " ".join(words)


def _time(m) -> str:
    half = {"am": MORNING, "ص": MORNING, "pm": EVENING, "م": EVENING}.get((m[3] or "").lower())
    return " ".join(filter(None, [say_time(int(m[1]), int(m[2])), half]))


def _day(m) -> str | None:
    d, mo, y = int(m[1]), int(m[2]), int(m[3])
    y += (2000 if y < 50 else 1900) if y < 100 else 0
    return say_date(d, mo, y) or _joined(say(d), say(mo), say(y))


def _month(m) -> str | None:
    mo, y = int(m[1]), int(m[2])
    return say_date(1, mo, y).partition(" ")[2] if 1 <= mo <= 12 else _joined(say(mo), say(y))


def _phone(style: str):
    def one(m) -> str | None:
        digits = "".join(c for c in m[0] if c.isdigit())
        return f"{f'{PLUS} ' if m[0].startswith('+') else ''}{say_phone(digits, style)}" if 9 <= len(digits) <= 15 else None

    return one


def _fraction(m) -> str | None:
    n, d = int(m[1]), int(m[2])
    if d in FRACTIONS and 1 <= n <= 10:
        one, two, few = FRACTIONS[d]
        return {1: one, 2: two}.get(n) or f"{say(n)} {few}"
    return _joined(say(n), OVER, say(d))


def _abbreviation(short: str) -> str:
    guard = "" if short[-1] in "./" else "(?![ء-ي])"
    return f"(?<![ء-ي]){re.escape(short)}{guard}"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _run_start(text: str, at: int, low: int, marks: str) -> int | None:
    """Of the run of word characters and marks that ends before at, not below low, the first place at a word boundary."""
    i = at
    while i > low and (_word(text[i - 1]) or text[i - 1] in marks):
        i -= 1
    while i < at and (i > 0 and _word(text[i - 1])) == _word(text[i]):
        i += 1
    return i if i < at else None


def _mails(text: str) -> str:
    """E-mail addresses as words. Each @ looks to its left once, so the work is linear in the text."""
    out, done = [], 0
    for m in _MAIL_HOST.finditer(text):
        start = _run_start(text, m.start(), done, ".+-") if m.start() >= done else None
        if start is not None:
            address = text[start : m.end()]
            out += [text[done:start], _spaced(latin.say_email(address), address)]
            done = m.end()
    return "".join([*out, text[done:]])


def _urls(text: str) -> str:
    """Addresses of pages as words: those that begin like one, and names that end in a known domain; of two the one further left."""
    out, done, first, end, start = [], 0, _URL_START.search(text), _URL_END.search(text), None
    while True:
        if first and first.start() < done:
            first = _URL_START.search(text, done)
        while end and (end.start() < done or (start := _run_start(text, end.start(), done, "-")) is None):
            end = _URL_END.search(text, max(done, end.start() + 1))
        if not first and not end:
            return "".join([*out, text[done:]])
        a, b = first.span() if first and not (end and start < first.start()) else (start, end.end())
        out += [text[done:a], _spaced(latin.say_url(text[a:b]), text[a:b])]
        done = b


_MAIL_HOST, _URL_START, _URL_END = re.compile(MAIL_HOST), re.compile(URL_START, re.I), re.compile(URL_END, re.I)

#: (flag that must be set or None, what a text must hold, pattern, words of a match or None to leave it). They run in this order. What a
#: text must hold are sets of characters, or whole strings, of each of which one must be there; "0" stands for any digit, "a" for a Latin letter.
STEPS = [
    (None, ["@"], None, _mails),
    (None, [(".", "://")], None, _urls),
    (None, ["0", ":٫"], TIME, _time),
    (None, ["0", "/-."], DAY, _day),
    (None, ["0", "/-"], MONTH, _month),
    *[(None, [(a,)], _abbreviation(a), lambda m, full=ABBREVIATIONS[a]: full) for a in sorted(ABBREVIATIONS, key=len, reverse=True)],
    ("numbers", ["0", "%٪"], PERCENT_SIGN, lambda m: _with(_amount(m[1]), PERCENT)),
    ("numbers", ["0", "$€£"], MONEY_BEFORE, lambda m: _with(_amount(m[2]), CURRENCY[m[1]])),
    ("numbers", ["0"], MONEY_AFTER, lambda m: _with(_amount(m[1]), CURRENCY[m[2] if m[2] in CURRENCY else m[2].upper()])),
    ("numbers", ["0"], PHONE, "phone"),
    ("numbers", ["0", "/"], FRACTION, _fraction),
    ("numbers", ["0", "-–"], RANGE, lambda m: _joined(FROM, say(int(m[1])), TO, say(int(m[2])))),
    ("numbers", ["0", ("ال",)], ORDINAL, lambda m: ORDINALS[int(m[1])] if 1 <= int(m[1]) <= 10 else say(int(m[1]))),
    ("numbers", ["0", ".,٫"], DECIMAL, lambda m: _amount(m[0])),
    *[(None, [(s,)], re.escape(s), lambda m, word=w: word) for s, w in SYMBOLS.items()],
    ("numbers", ["0"], INTEGER, lambda m: say(int(m[0]))),
    ("latin", ["a"], LATIN, lambda m: latin.say_token(m[0])),
]
_ANY = {"0": re.compile(r"\d"), "a": re.compile("[A-Za-z]")}


def _test(need):
    """Whether a text holds one of the strings, or of the characters, of a need."""
    if need in _ANY:
        return _ANY[need].search
    if len(need) == 1:
        return lambda text, x=need[0]: x in text
    return lambda text: any(c in text for c in need)


_COMPILED = [(flag, [_test(n) for n in needs], re.compile(p, re.I if p == TIME or p.endswith(UNIT) else 0) if p else None, f) for flag, needs, p, f in STEPS]
_WESTERN = str.maketrans(chars.ARABIC_INDIC + chars.EXTENDED_INDIC, "01234567890123456789")
_INVISIBLE = str.maketrans("", "", chars.INVISIBLE + chars.SOFT_HYPHEN)
_MARKS = str.maketrans("", "", chars.MARKS_NORMALIZER + chars.TATWEEL)
_SPACES = str.maketrans(chars.PUNCT_TO_SPACE, " " * len(chars.PUNCT_TO_SPACE))
_FINDERS = {id(t): re.compile(f"[{re.escape(''.join(map(chr, t)))}]") for t in (_INVISIBLE, _MARKS, _WESTERN, _SPACES)}
_ENDS = "".join(dict.fromkeys(PAUSES.values()))


def _mapped(text: str, table: dict) -> str:
    """text.translate(table), which costs more than to look whether there is anything to translate."""
    return text.translate(table) if _FINDERS[id(table)].search(text) else text


def verbalize(text: str | None, numbers: bool = True, latin_words: bool = True, punctuation: bool = True, strip_marks: bool = True, phone_style: str = "digits", guard_digits: bool = False) -> str | None:
    """A line as words. None stays None. guard_digits keeps runs of four and more equal digits, which otherwise shrink to two like letters."""
    if phone_style not in ("digits", "numbers"):
        raise ValueError(f"unknown phone style {phone_style!r}")
    if text is None or not text.strip():
        return None if text is None else ""
    text = _mapped(unicodedata.normalize("NFC", text), _INVISIBLE)
    text = _mapped(_mapped(text, _MARKS) if strip_marks else text, _WESTERN)
    text = re.sub(r"(\D)\1{3,}" if guard_digits else r"(.)\1{3,}", r"\1\1", text)
    text = re.sub(THOUSANDS, lambda m: m[0].replace(",", "").replace("٬", ""), text)
    for flag, tests, pattern, words in _COMPILED:
        if (flag is None or (numbers if flag == "numbers" else latin_words)) and all(test(text) for test in tests):
            if pattern is None:
                text = words(text)
                continue
            words = _phone(phone_style) if words == "phone" else words
            text = pattern.sub(lambda m, words=words: _spaced(words(m), m[0]), text)
    text = _mapped(text, _SPACES)
    for mark, pause in PAUSES.items():
        if mark in text:
            text = text.replace(mark, f" {pause} " if punctuation else "")
    text = " ".join(_OTHERS.sub("", text).split())
    text = " ".join(_PAUSE.sub(r"\1 ", text).split())
    return text.strip(f" {_ENDS}") if re.search("[ء-ي]", text) else ""


_OTHERS, _PAUSE = re.compile(rf"[^\s؀-ۿ{_ENDS}]+"), re.compile(rf"(?<!\s)\s*([{_ENDS}])[\s{_ENDS}]*")
#: Rows that a task holds as words at once.
ROWS = 64


def verbalized(df: DataFrame, column: str = "text", **flags) -> DataFrame:
    """df with the column verbalised."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(column)
            for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                yield b.set_column(i, b.schema.field(i), pa.array([verbalize(t, **flags) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


__all__ = ["verbalize", "verbalized", "say_digits"]
