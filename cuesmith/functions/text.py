"""Column functions over transcript and subtitle text, and their few Python twins.

White space is Python's set, written out, because Java's ``\\s`` and ``trim``
know less of it. Lengths are code points throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character sets of the subtitle rules.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
CJK = r"[一-鿿぀-ヿ가-힯]"
HAN = r"[一-鿿]"
SENTENCE_END = r"[。！？!?；;…]"
SOFT_END = r"[，,、：:]"
KEPT_PUNCTUATION = r"[。．.，,、！？!?；;：:…]"
CLOSES_UP = r"[,.!?;:%，。！？；：]"
OPENS_UP = r"[¿¡]"
CLEAN_CLOSES_UP = r"[，。！？；：、,.!?;:]"
UNIT_PUNCTUATION = r"[，。！？；：、,.!?;:…]"
#: What a transcript must have more than; the older profile also discards curly quotes.
NO_CONTENT = "。．.，,、！？!?；;：:「」『』（）()[]【】《》〈〉…-—_~〜\"'"
CURLY = "“”‘’"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_transcript(c: Column) -> Column:
    """Stripped, white space collapsed to one space; null is empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def is_effective(c: Column, legacy: bool = False) -> Column:
    """Whether anything but white space and punctuation is left."""
    chars = re.sub(r"([\[\]\-\\^])", r"\\\1", NO_CONTENT + CURLY * legacy)
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}|[{chars}]", "") != ""


def extract_text(result: Column) -> Column:
    """Transcript of an engine result as JSON: a string itself, an object's ``text``."""
    named = F.get_json_object(result, "$.text")
    plain = F.from_json(F.concat(F.lit('{"v":'), result, F.lit("}")), "v string")["v"]
    return normalize_transcript(F.when(result.rlike(rf"^{SPACE}*\{{"), named).when(result.rlike(f'^{SPACE}*"'), plain).otherwise(F.lit("")))


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def ends_sentence(c: Column) -> Column:
    return c.rlike(f"{SENTENCE_END}{SPACE}*$")


def has_soft_punctuation(c: Column) -> Column:
    return c.rlike(f"{SOFT_END}{SPACE}*$")


def collect_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, KEPT_PUNCTUATION.replace("[", "[^", 1), "")


def join_words(words: Column) -> Column:
    """Text of an ordered array of token texts: CJK anywhere joins all without
    white space; otherwise spaces, none before closing and after opening marks."""
    solid = F.regexp_replace(F.array_join(words, ""), f"{SPACE}+", "")
    spaced = F.regexp_replace(F.array_join(words, " "), f"{SPACE}+({CLOSES_UP})", "$1")
    return F.when(is_cjk(F.array_join(words, "")), solid).otherwise(strip(F.regexp_replace(spaced, f"({OPENS_UP}){SPACE}+", "$1")))


def combine(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).when(is_cjk(F.concat(a, b)), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def clean_subtitle(c: Column) -> Column:
    one = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    close = F.regexp_replace(one, f"(?<={HAN}){SPACE}+(?={HAN})", "")
    return F.regexp_replace(close, f"{SPACE}+({CLEAN_CLOSES_UP})", "$1")


def visual_length(c: Column) -> Column:
    return F.length(clean_subtitle(c))


def normalize_romanized(c: Column) -> Column:
    """Letters a-z and apostrophes of a romanized unit."""
    return F.regexp_replace(F.translate(F.lower(c), "’`", "''"), "[^a-z']", "")


def millis(seconds: Column) -> Column:
    """Whole milliseconds, half to even, never negative."""
    return F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")


def srt_time(seconds: Column) -> Column:
    ms = millis(seconds)
    part = lambda by, of: F.floor(ms / by) % of if of else F.floor(ms / by)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def vtt_time(seconds: Column) -> Column:
    return F.translate(srt_time(seconds), ",", ".")


def parse_srt_time(c: Column) -> Column:
    """Seconds of ``HH:MM:SS,mmm``; null where it has no such form."""
    at = lambda k: F.regexp_extract(c, r"^([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})", k).cast("double")
    return F.when(c.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}"), at(1) * 3600 + at(2) * 60 + at(3) + at(4) / 1000.0)


def through_srt(seconds: Column) -> Column:
    """The time as it comes back from an SRT file."""
    ms = millis(seconds)
    return F.floor(ms / 1000).cast("double") + (ms % 1000) / 1000.0


def fixed(c: Column, digits: int) -> Column:
    """A double with so many decimals, rounded by its exact value, half to even.

    ``c * 10 ** digits`` can land on a half that the exact product misses; the
    product's own error tells to which side.
    """
    by = float(10**digits)
    a = F.abs(c)
    big = a * 134217729.0
    high = big - (big - a)
    product = a * by
    error = (high * by - product) + (a - high) * by
    low = F.floor(product)
    tie = product - low == 0.5
    whole = F.when(tie & (error > 0), low + 1).when(tie & (error < 0), low).otherwise(F.rint(product).cast("long"))
    sign = F.when((c < 0), F.lit("-")).otherwise(F.lit(""))
    return F.format_string(f"%s%d.%0{digits}d", sign, F.floor(whole / int(by)), whole % int(by))


# Python twins, for the sequential rules.
_CJK, _HAN_GAP = re.compile(CJK), re.compile(rf"(?<={HAN})\s+(?={HAN})")
_CLOSE, _OPEN = re.compile(rf"\s+({CLOSES_UP})"), re.compile(rf"({OPENS_UP})\s+")
_CLEAN_CLOSE, _SPACES = re.compile(rf"\s+({CLEAN_CLOSES_UP})"), re.compile(r"\s+")
py_ends_sentence = re.compile(rf"{SENTENCE_END}\s*$").search
py_soft = re.compile(rf"{SOFT_END}\s*$").search
_DROPPED = re.compile(KEPT_PUNCTUATION.replace("[", "[^", 1))
_UNIT_PUNCTUATION = re.compile(UNIT_PUNCTUATION)


def py_is_cjk(s: str) -> bool:
    return _CJK.search(s) is not None


def py_punctuation(s: str) -> str:
    return _DROPPED.sub("", s)


def py_join(words: list[str]) -> str:
    if py_is_cjk("".join(words)):
        return _SPACES.sub("", "".join(words))
    return _OPEN.sub(r"\1", _CLOSE.sub(r"\1", " ".join(words))).strip()


def py_combine(a: str, b: str) -> str:
    return a + b if not a or not b or py_is_cjk(a + b) else f"{a} {b}"


def py_clean(s: str) -> str:
    return _CLEAN_CLOSE.sub(r"\1", _HAN_GAP.sub("", _SPACES.sub(" ", s).strip()))


def py_join_units(pieces: list[str]) -> str:
    """Neighbours decide: no space around CJK or before punctuation."""
    out: list[str] = []
    last = ""
    for p in filter(None, pieces):
        if last and not (py_is_cjk(last) or py_is_cjk(p[0]) or _UNIT_PUNCTUATION.match(p[0])):
            out.append(" ")
        out.append(p)
        last = p[-1]
    return py_clean("".join(out))
