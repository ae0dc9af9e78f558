"""Numbers, dates and times as spoken Egyptian Arabic: column expressions, and the same rules for one Python value."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = ["", "واحد", "اتنين", "تلاتة", "اربعة", "خمسة", "ستة", "سبعة", "تمانية", "تسعة"]
ONES_FEMININE = ["", "واحدة", "اتنين", "تلاتة", "اربعة", "خمسة", "ستة", "سبعة", "تمانية", "تسعة"]
TEENS = ["عشرة", "حداشر", "اتناشر", "تلاتاشر", "اربعتاشر", "خمستاشر", "ستاشر", "سبعتاشر", "تمنتاشر", "تسعتاشر"]
TENS = ["", "", "عشرين", "تلاتين", "اربعين", "خمسين", "ستين", "سبعين", "تمانين", "تسعين"]
HUNDREDS = ["", "مية", "متين", "تلتمية", "اربعمية", "خمسمية", "ستمية", "سبعمية", "تمنمية", "تسعمية"]
SCALES = [(4, "تريليون", "تريليونين", "تريليون"), (3, "مليار", "مليارين", "مليار"), (2, "مليون", "مليونين", "ملايين"), (1, "الف", "الفين", "الاف")]
ZERO, MINUS, AND, POINT, ZERO_SPOKEN = "صفر", "سالب", "و", "فاصلة", "زيرو"
ORDINALS = ["", "الاول", "التاني", "التالت", "الرابع", "الخامس", "السادس", "السابع", "التامن", "التاسع", "العاشر"]
ORDINALS_FEMININE = ["", "الاولى", "التانية", "التالتة", "الرابعة", "الخامسة", "السادسة", "السابعة", "التامنة", "التاسعة", "العاشرة"]
MONTHS = ["يناير", "فبراير", "مارس", "ابريل", "مايو", "يونيو", "يوليو", "اغسطس", "سبتمبر", "اكتوبر", "نوفمبر", "ديسمبر"]
HOURS = ["واحدة", "اتنين", "تلاتة", "اربعة", "خمسة", "ستة", "سبعة", "تمانية", "تسعة", "عشرة", "حداشر", "اتناشر"]
QUARTER, THIRD, HALF, EXCEPT, MINUTE = "ربع", "تلت", "نص", "الا", "دقيقة"
LIMIT = 10**15


def _below_thousand(feminine: bool) -> list[str]:
    """Words of 0..999. The only connector stands between a unit and its ten."""
    ones = ONES_FEMININE if feminine else ONES
    small = [*ones, *TEENS] + [f"{ones[n % 10]} {AND} {TENS[n // 10]}" if n % 10 else TENS[n // 10] for n in range(20, 100)]
    return [" ".join(filter(None, (HUNDREDS[n // 100], small[n % 100]))) for n in range(1000)]


GROUP = {f: _below_thousand(f) for f in (False, True)}


def say(n: int, feminine: bool = False) -> str | None:
    """Words of an integer; None beyond the named scales."""
    if abs(n) >= LIMIT:
        return None
    if n <= 0:
        return ZERO if n == 0 else f"{MINUS} {say(-n, feminine)}"
    out = []
    for power, one, two, few in SCALES:
        if count := n // 1000**power % 1000:
            out.append({1: one, 2: two}.get(count) or f"{GROUP[False][count]} {few if count <= 10 else one}")
    return " ".join([*out, GROUP[feminine][n % 1000]]).strip()


def _pick(words: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))


def number_words(n: Column, feminine: bool = False) -> Column:
    """say() of an integer column; null stays null, and so do numbers of 10^15 and more."""
    n = n.cast("long")
    size = F.abs(n)
    parts = []
    for power, one, two, few in SCALES:
        count = F.floor(size / F.lit(1000**power)).cast("long") % 1000 if power < 4 else F.floor(size / F.lit(1000**power)).cast("long")
        many = F.concat(_pick(GROUP[False], count), F.lit(" "), F.when(count <= 10, few).otherwise(one))
        parts.append(F.when(count == 1, one).when(count == 2, two).when(count > 2, many))
    parts.append(F.nullif(_pick(GROUP[feminine], size % 1000), F.lit("")))
    spoken = F.concat_ws(" ", F.when(n < 0, MINUS), *parts)
    return F.when(size < LIMIT, F.when(n == 0, ZERO).otherwise(spoken))


def digit_words(digits: Column, zero: str = ZERO) -> Column:
    """Digits of a string one by one; other characters are left out."""
    each = F.filter(F.split(digits, ""), lambda c: c.rlike("^[0-9]$"))
    return F.array_join(F.transform(each, lambda c: _pick([zero, *ONES[1:]], c)), " ")


def decimal_words(text: Column) -> Column:
    """12.30: whole part, the word for point, then the fraction digit by digit."""
    parts = F.split(text, "[.٫]", 2)
    whole, fraction = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    spoken = F.when(whole == "", ZERO).otherwise(number_words(F.nullif(whole, F.lit("")).cast("long")))
    return F.when(fraction.isNull(), spoken).otherwise(F.concat_ws(" ", spoken, F.lit(POINT), F.nullif(digit_words(fraction), F.lit(""))))


def ordinal_words(n: Column, feminine: bool = False) -> Column:
    return F.when(n.between(1, 10), _pick(ORDINALS_FEMININE if feminine else ORDINALS, n)).otherwise(number_words(n, feminine))


def group_sizes(n: int) -> list[int]:
    """How a subscriber number of n digits is grouped when spoken: threes, but no single digit at the end."""
    fixed = {8: [3, 2, 3], 7: [3, 2, 2]}
    if n in fixed:
        return fixed[n]
    out = []
    while n:
        out.append(2 if n == 4 else min(3, n))
        n -= out[-1]
    return out


def _groups(digits: Column) -> Column:
    """Array of the groups of a string of digits, as group_sizes() has them."""
    fixed = lambda sizes: F.regexp_extract_all(digits, F.lit("|".join(rf"(?<=^[0-9]{{{sum(sizes[:i])}}})[0-9]{{{n}}}" for i, n in enumerate(sizes))), F.lit(0))
    others = F.regexp_extract_all(digits, F.lit(r"[0-9]{2}(?=[0-9]{2}$)|[0-9]{3}|[0-9]{1,2}"), F.lit(0))
    return F.when(F.length(digits) == 8, fixed(group_sizes(8))).when(F.length(digits) == 7, fixed(group_sizes(7))).otherwise(others)


def phone_words(number: Column, style: str = "digits") -> Column:
    """A phone number by groups; an 11-digit mobile number starts with its prefix read as a number, which takes in a zero after it."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    mobile = (F.length(digits) == 11) & digits.startswith("01")
    head = F.when(F.substring(digits, 4, 1) == "0", 4).otherwise(3)
    prefix = F.concat(F.lit(f"{ZERO_SPOKEN} "), number_words(F.substring(digits, F.lit(2), head - 1).cast("long")))
    spoken = lambda d, read: F.transform(_groups(d), read)
    one = lambda g: digit_words(g, ZERO_SPOKEN)
    rest = F.substring(digits, head + 1, F.length(digits))
    parts = F.when(mobile, F.concat(F.array(prefix), spoken(rest, (lambda g: number_words(g.cast("long"))) if style == "numbers" else one))).otherwise(spoken(digits, one))
    return F.array_join(parts, " ، ")


def say_digits(digits: str, zero: str = ZERO) -> str:
    return " ".join(zero if d == "0" else ONES[int(d)] for d in digits if d.isdigit())


def say_decimal(text: str) -> str | None:
    whole, point, fraction = text.partition(".")
    spoken = say(int(whole)) if whole else ZERO
    return " ".join(filter(None, [spoken, POINT, say_digits(fraction)])) if point and spoken else spoken


def say_phone(digits: str, style: str = "digits") -> str:
    def cut(d: str) -> list[str]:
        at, out = 0, []
        for size in group_sizes(len(d)):
            out.append(d[at : at + size])
            at += size
        return out

    if len(digits) != 11 or not digits.startswith("01"):
        return " ، ".join(say_digits(g, ZERO_SPOKEN) for g in cut(digits))
    head = 4 if digits[3] == "0" else 3
    read = (lambda g: say(int(g))) if style == "numbers" else (lambda g: say_digits(g, ZERO_SPOKEN))
    return " ، ".join([f"{ZERO_SPOKEN} {say(int(digits[1:head]))}", *map(read, cut(digits[head:]))])


def date_words(day: Column, month: Column, year: Column | None = None) -> Column:
    """Day, month name and year; null for months outside 1..12. The day isn't checked."""
    parts = [number_words(day), _pick(MONTHS, month - 1), *([] if year is None else [number_words(year)])]
    return F.when(month.between(1, 12), F.concat_ws(" ", *parts))


def say_date(day: int, month: int, year: int | None = None) -> str | None:
    return " ".join(filter(None, [say(day), MONTHS[month - 1], None if year is None else say(year)])) if 1 <= month <= 12 else None


#: Minutes with a phrase of their own: the phrase, and whether it counts back from the next hour.
PHRASES = {15: (QUARTER, False), 20: (THIRD, False), 30: (HALF, False), 40: (THIRD, True), 45: (QUARTER, True), 50: ("عشرة", True), 55: ("خمسة", True)}


def time_words(hour: Column, minute: Column) -> Column:
    """A clock time on twelve hours, counting back from the next hour beyond half past."""
    base = _pick(HOURS, (hour + 11) % 12)
    nxt = _pick(HOURS, hour % 12)
    join = lambda h, link, *rest: F.concat_ws(" ", h, F.lit(link), *rest)
    out = F.when(minute == 0, base)
    for m, (phrase, back) in PHRASES.items():
        out = out.when(minute == m, join(nxt, EXCEPT, F.lit(phrase)) if back else join(base, AND, F.lit(phrase)))
    return out.when(minute > 30, join(nxt, EXCEPT, number_words(60 - minute), F.lit(MINUTE))).otherwise(join(base, AND, number_words(minute), F.lit(MINUTE)))


def say_time(hour: int, minute: int) -> str:
    base, nxt = HOURS[(hour + 11) % 12], HOURS[hour % 12]
    if minute == 0:
        return base
    if minute in PHRASES:
        phrase, back = PHRASES[minute]
    else:
        back = minute > 30
        phrase = f"{say(60 - minute if back else minute)} {MINUTE}"
    return f"{nxt} {EXCEPT} {phrase}" if back else f"{base} {AND} {phrase}"


def format_duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor(whole % 3600 / 60).cast("string"), F.lit("m")))
    )
