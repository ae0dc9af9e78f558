"""Latin-script tokens as spoken in Arabic: sites, abbreviations, letters, names, URLs and e-mail addresses."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for Latin tokens.
SITES = {
    "google": "جوجل", "youtube": "يوتيوب", "facebook": "فيسبوك", "twitter": "تويتر", "instagram": "انستجرام", "whatsapp": "واتساب",
    "gmail": "جيميل", "yahoo": "ياهو", "hotmail": "هوتميل", "outlook": "اوتلوك", "linkedin": "لينكد ان", "github": "جيت هاب",
    "tiktok": "تيك توك", "telegram": "تليجرام", "netflix": "نتفليكس", "amazon": "امازون", "wikipedia": "ويكيبيديا", "huggingface": "هجينج فيس",
}
ABBREVIATIONS = {
    "dr": "دكتور", "prof": "بروفيسور", "mr": "مستر", "mrs": "مدام", "eng": "مهندس", "st": "شارع", "am": "صباحا", "pm": "مساء",
    "km": "كيلو متر", "kg": "كيلو جرام", "cm": "سنتي متر", "mm": "ملي متر", "gb": "جيجا بايت", "mb": "ميجا بايت", "kb": "كيلو بايت",
    "tv": "تي في", "pc": "بي سي", "ok": "او كيه", "ceo": "سي اي او", "usa": "امريكا", "uk": "بريطانيا", "uae": "الامارات",
}
DOMAINS = {"com": "كوم", "net": "نت", "org": "اورج", "edu": "ادو", "gov": "جوف", "eg": "اي جي", "io": "اي او", "ai": "ايه اي", "co": "كو"}
LETTERS = {
    "a": "ايه", "b": "بي", "c": "سي", "d": "دي", "e": "اي", "f": "اف", "g": "جي", "h": "اتش", "i": "اي", "j": "جي", "k": "كيه", "l": "ال", "m": "ام",
    "n": "ان", "o": "او", "p": "بي", "q": "كيو", "r": "ار", "s": "اس", "t": "تي", "u": "يو", "v": "في", "w": "دبليو", "x": "اكس", "y": "واي", "z": "زد",
}
SOUNDS = {
    "sch": "ش", "tch": "تش", "sh": "ش", "ch": "تش", "kh": "خ", "gh": "غ", "th": "ث", "ph": "ف", "ck": "ك", "ou": "و", "oo": "و", "ee": "ي",
    "aa": "ا", "ei": "ي", "ai": "ي", "ay": "اي", "ya": "يا", "a": "ا", "b": "ب", "c": "ك", "d": "د", "e": "ي", "f": "ف", "g": "ج", "h": "ه",
    "i": "ي", "j": "ج", "k": "ك", "l": "ل", "m": "م", "n": "ن", "o": "و", "p": "ب", "q": "ق", "r": "ر", "s": "س", "t": "ت", "u": "و", "v": "ف",
    "w": "و", "x": "كس", "y": "ي", "z": "ز",
}
NAMES = {
    "ahmed": "احمد", "ahmad": "احمد", "mohamed": "محمد", "mohammed": "محمد", "muhammad": "محمد", "mahmoud": "محمود", "mostafa": "مصطفى", "mustafa": "مصطفى",
    "omar": "عمر", "ali": "علي", "hassan": "حسن", "hussein": "حسين", "khaled": "خالد", "kareem": "كريم", "karim": "كريم", "youssef": "يوسف", "yousef": "يوسف",
    "ibrahim": "ابراهيم", "mona": "منى", "sara": "سارة", "nour": "نور", "aya": "اية", "fatma": "فاطمة", "heba": "هبة", "amira": "اميرة", "salma": "سلمى",
    "tarek": "طارق", "sherif": "شريف", "amr": "عمرو", "ayman": "ايمن", "hany": "هاني", "sameh": "سامح", "wael": "وائل", "yasser": "ياسر", "info": "انفو",
    "admin": "ادمن", "support": "سبورت", "contact": "كونتاكت", "sales": "سيلز", "hello": "هالو", "mail": "ميل", "test": "تست",
}
DOT, SLASH, AT, WWW = "دوت", "سلاش", "ات", "دبليو دبليو دبليو"

WORDS = DOMAINS | ABBREVIATIONS | SITES
_SOUND = re.compile("|".join(SOUNDS))


def transliterate(word: str) -> str:
    """A name in Arabic letters: known spellings, else sound by sound, the longest first."""
    low = word.lower()
    if low in NAMES:
        return NAMES[low]
    out = "".join(SOUNDS[m] for m in _SOUND.findall(low))
    return ("ا" + out[1:] if len(out) > 1 and out[0] == "ي" else out) or word


def say_token(token: str, names: bool = False) -> str:
    """A known word, or with names a transliteration of three letters and more, or else letter by letter; short capitals are always spelt."""
    return _say_short(token, names) if len(token) <= 32 else _say(token, names)


def _say(token: str, names: bool) -> str:
    low = token.lower().strip(".")
    if low in WORDS:
        return WORDS[low]
    acronym = token.isupper() and len(token) <= 5
    if names and not acronym and len(low) >= 3 and low.isalpha():
        return transliterate(low)
    return " ".join(LETTERS.get(c, c) for c in low if c.isalpha())


_say_short = lru_cache(maxsize=20_000)(_say)  # of tokens of 32 characters at most


def say_host(host: str) -> str:
    return f" {DOT} ".join(say_token(p) if re.match("[A-Za-z]", p) else p for p in host.split(".") if p)


def say_url(url: str) -> str:
    body = re.sub(r"^www\.", f"{WWW} {DOT} ", re.sub("^https?://", "", url, flags=re.I), flags=re.I)
    host, _, path = body.partition("/")
    said = [say_token(p) for p in re.split(r"[/\-_]", path) if p]
    return say_host(host) + (f" {SLASH} " + " ".join(said) if path.strip("/") else "")


def say_email(address: str) -> str:
    user, _, domain = address.partition("@")
    return f"{' '.join(say_token(p, names=True) for p in re.split('[._+-]', user) if p)} {AT} {f' {DOT} '.join(say_token(p) for p in domain.split('.') if p)}"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def spelt(token: Column) -> Column:
    """Letter by letter; characters other than ASCII letters are left out."""
    each = F.filter(F.split(F.lower(token), ""), lambda c: c.rlike("^[a-z]$"))
    return F.array_join(F.transform(each, lambda c: _lookup(LETTERS, c)), " ")


def token_words(token: Column) -> Column:
    """say_token() of an ASCII token, as a native expression."""
    return F.coalesce(_lookup(WORDS, F.lower(F.regexp_replace(token, r"^\.+|\.+$", ""))), spelt(token))


def url_words(url: Column) -> Column:
    """say_url() of an ASCII URL, as a native expression."""
    body = F.regexp_replace(url, "(?i)^https?://", "")
    www = body.rlike(r"(?i)^www\.")
    body = F.regexp_replace(body, r"(?i)^www\.", "")
    host, path = F.substring_index(body, "/", 1), F.regexp_extract(body, "^[^/]*/(.*)$", 1)
    hosts = F.filter(F.split(host, r"\."), lambda p: p != "")
    said = F.array_join(F.transform(hosts, lambda p: F.when(p.rlike("^[A-Za-z]"), token_words(p)).otherwise(p)), f" {DOT} ")
    first = F.when(www, F.concat(F.lit(f"{WWW} {DOT} "), F.get(hosts, F.lit(0)), F.when(F.size(hosts) > 1, F.concat(F.lit(f" {DOT} "), F.array_join(F.transform(F.slice(hosts, 2, F.greatest(F.size(hosts), F.lit(1))), lambda p: F.when(p.rlike("^[A-Za-z]"), token_words(p)).otherwise(p)), f" {DOT} "))).otherwise("")))
    segments = F.array_join(F.transform(F.filter(F.split(path, r"[/\-_]"), lambda p: p != ""), token_words), " ")
    return F.concat(F.coalesce(first, said), F.when(F.regexp_replace(path, "/", "") != "", F.concat(F.lit(f" {SLASH} "), segments)).otherwise(""))
