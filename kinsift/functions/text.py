"""Folding of names, titles and artists into comparison keys, as column expressions.

Everything runs in the JVM except NFKC and full case folding, which Spark has no function for: an
Arrow function does both, and only non-ASCII values are handed to it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---- fixed values -------------------------------------------------------------------------------

#: Arabic letters and the Persian ones they are folded to, in pairs.
LETTERS_FROM = "يﻱﻲكﻙﻚةۀأإآٱؤئٲٳ"
LETTERS_TO = "یییکککههااااویاا"

DIGITS_FROM = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
DIGITS_TO = "01234567890123456789"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"

#: Joiners, bidirectional marks and diacritics.
INVISIBLE = r"[​‌‍‎‏‪-‮⁦-⁩﻿ً-ٰۖ-ۭ]"

#: Words in names and titles that say nothing.
NOISE = [
    r"\bofficial\s*(music\s*)?(video|audio|lyrics?|visualizer)\b",
    r"\blyrics?\b",
    r"\b(hq|hd|4k|full\s*hd)\b",
    r"\b(320|256|192|160|128|96|64)\s*k(bps)?\b",
    r"\[\s*(320|256|192|160|128|96|64)\s*\]",
    r"\bfull\s*album\b",
    r"\bremaster(ed)?(\s*\d{4})?\b",
    r"\bexplicit\b",
    r"\bwww\.[\w\-]+\.[a-z]{2,4}\b",
    r"\b[\w\-]{3,}\.(com|ir|net|org|info|me|co|tv)\b",
    r"\b(downloaded|download)\s*(from|by)\b",
    r"\bمیکس\s*شده\b",
    r"\bدانلود\s*(آهنگ|موزیک|از)?\b",
    r"\bکیفیت\s*\d{2,3}\b",
]

#: Marks of a copy in a file name.
COPY_MARKS = [
    r"\(\s*\d{1,3}\s*\)\s*$",
    r"\[\s*\d{1,3}\s*\]\s*$",
    r"[-–_\s]+copy(\s*\(\s*\d+\s*\))?\s*$",
    r"\bcopy\s*of\b",
    r"[-–_\s]+کپی(\s*\(?\s*\d*\s*\)?)?\s*$",
    r"[-–_\s]+نسخه\s*\d*\s*$",
    r"[-–_\s]+duplicate\s*$",
]
COPY_WORDS = ["copy", "کپی"]

#: Words that introduce a guest credit.
CREDIT = r"feat|ft|featuring|with|w/|با\s*حضور|به\s*همراه"
CREDIT_BRACKET = rf"[\(\[\{{]\s*(?:{CREDIT})\b\.?[^\)\]\}}]*[\)\]\}}]"
CREDIT_TRAIL = rf"\s*[-–,]?\s*\b(?:{CREDIT})\b\.?\s+.*$"
ARTIST_SPLIT = rf"\s*(?:&|,|;|/|\+|\bvs\.?\b|\b(?:{CREDIT})\b\.?)\s*"

#: What is trimmed from the ends of names and titles.
EDGE = " -–_."

#: What a text in folded form must hold for a noise word, a name for a mark of a copy, and a title for a credit: quick
#: tests, without boundaries, that spare most texts the patterns.
NOISE_HINT = r"official|lyric|hq|hd|4k|[02468](?U:\s*)[k\]]|album|remaster|explicit|www\.|\.(?:com|ir|net|org|info|me|co|tv)|download|میکس|دانلود|کیفیت"
COPY_HINT = r"(?i)[)\]]|copy|duplicate|کپی|نسخه"
CREDIT_HINT = r"(?iU)feat|ft|with|w/|با|به"

# -------------------------------------------------------------------------------------------------

_LETTER = r"\p{L}\p{N}_"
_BOUNDARY = rf"(?:(?<=[{_LETTER}])(?![{_LETTER}])|(?<![{_LETTER}])(?=[{_LETTER}]))"


def java(pattern: str) -> str:
    r"""pattern for Spark's regular expressions, with ``\b`` and ``\w`` about letters, digits and _ alone.

    Java's own take combining marks for letters too.
    """
    pattern = pattern.replace(r"\b", _BOUNDARY).replace(r"[\w\-]", rf"[{_LETTER}\-]")
    return "(?iU)" + pattern


def either(patterns: list[str]) -> str:
    return java("|".join(patterns))


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(ArrayType(StringType()))
def _fold_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [unicodedata.normalize("NFKC", s).casefold() for s in a])


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7f]")


def fold(text: Column, unicode: bool = True) -> Column:
    """NFKC and case folding. With ``unicode=False`` the caller vouches that text is ASCII; no Python runs then."""
    if not unicode:
        return F.lower(text)
    return F.coalesce(_fold(F.when(~is_ascii(text), text)), F.lower(text))


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _from_folded(text: Column) -> Column:
    text = F.translate(text, LETTERS_FROM, LETTERS_TO)
    text = F.translate(text, DIGITS_FROM, DIGITS_TO)  # before the diacritics, whose range holds Arabic-Indic digits
    text = F.regexp_replace(text, INVISIBLE, "")
    text = F.when(text.rlike(NOISE_HINT), F.regexp_replace(text, either(NOISE), " ")).otherwise(text)
    text = F.regexp_replace(text, rf"(?U)[^{_LETTER}\s؀-ۿ]+", " ")
    return squeeze(text)


def normalize(text: Column, unicode: bool = True) -> Column:
    """The comparison form of a text: letter forms, digits, case, noise words, punctuation and space folded."""
    return _from_folded(fold(text, unicode))


def key(text: Column, least: int = 1) -> Column:
    """text where it has ``least`` characters, else null: no key."""
    return F.when(F.length(text) >= least, text)


def strip_copy_marks(stem: Column) -> Column:
    """stem without marks of a copy: removed and trimmed again until nothing changes.

    Every step that changes something shortens the text, so its length bounds the steps; once a step
    changes nothing, the rest cost a comparison each.
    """
    once = lambda s: F.btrim(F.regexp_replace(s, either(COPY_MARKS), ""), F.lit(EDGE))
    start = F.struct(stem.alias("s"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(F.struct(once(state["s"]).alias("s"), (once(state["s"]) == state["s"]).alias("done")))

    marked = F.aggregate(F.sequence(F.lit(0), F.length(stem)), start, step)["s"]
    return F.when(stem.rlike(COPY_HINT), marked).otherwise(F.btrim(stem, F.lit(EDGE)))


def looks_like_copy(stem: Column) -> Column:
    found = stem.rlike(either(COPY_MARKS))
    for word in COPY_WORDS:
        found = found | F.contains(F.lower(stem), F.lit(word))
    return F.coalesce(found, F.lit(False))


def name_key(name: Column, unicode: bool = True) -> Column:
    """Comparison form of a file name without extension and marks of a copy."""
    return normalize(strip_copy_marks(stem_of(name)), unicode)


def strip_credit(title: Column) -> Column:
    """A title without its guest credit, in brackets or trailing."""
    text = F.regexp_replace(title, java(CREDIT_BRACKET), " ")
    text = F.when(title.rlike(CREDIT_HINT), F.regexp_replace(text, java(CREDIT_TRAIL), "")).otherwise(title)
    return F.btrim(text, F.lit(EDGE))


def core_title(title: Column, unicode: bool = True) -> Column:
    return normalize(strip_credit(title), unicode)


def artists(text: Column, unicode: bool = True) -> Column:
    """The people that are credited, as a sorted array of distinct comparison forms; empty if there are none."""
    parts = F.split(F.coalesce(text, F.lit("")), java(ARTIST_SPLIT), -1)
    lower = F.transform(parts, F.lower)
    if unicode:
        lower = F.coalesce(_fold_each(F.when(~is_ascii(text), parts)), lower)
    return F.array_sort(F.array_distinct(F.filter(F.transform(lower, _from_folded), lambda x: F.length(x) >= 2)))


def tag_key(artist: Column, title: Column, unicode: bool = True) -> Column:
    """artist|title in comparison form; null unless both have one."""
    a, t = key(normalize(artist, unicode)), key(normalize(title, unicode))
    return F.concat(a, F.lit("|"), t)


def title_key(title: Column, unicode: bool = True) -> Column:
    return key(normalize(title, unicode), 3)


def core_title_key(title: Column, unicode: bool = True) -> Column:
    return key(core_title(title, unicode), 3)


def display(artist: Column, title: Column) -> Column:
    """"artist — title", or the one that there is."""
    a, t = F.nullif(artist, F.lit("")), F.nullif(title, F.lit(""))
    return F.coalesce(F.concat(a, F.lit(" — "), t), t, a, F.lit(""))


def persian_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_TO[:10], PERSIAN_DIGITS)


def in_language(text: Column, lang: str) -> Column:
    """Digits as the language writes them."""
    return persian_digits(text) if lang == "fa" else text


# ---- paths --------------------------------------------------------------------------------------


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1)


def extension_of(path: Column) -> Column:
    """The last dot of the name and what follows, in lower case; none for a name that only begins with dots."""
    return F.lower(F.regexp_extract(name_of(path), r"(?s)[^.].*(\.[^.]*)$", 1))


def stem_of(name: Column) -> Column:
    stem = F.regexp_extract(name, r"(?s)^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def short_folder(folder: Column, segments: int = 2) -> Column:
    """The last segments of a folder behind an ellipsis; short folders as they are."""
    parts = F.filter(F.split(F.translate(folder, "/", "\\"), r"\\", -1), lambda p: p != "")
    tail = F.concat(F.lit("…\\"), F.array_join(F.slice(parts, -segments, segments), "\\"))
    return F.when(F.size(parts) <= segments, folder).otherwise(tail)

