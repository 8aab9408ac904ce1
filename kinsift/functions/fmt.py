"""Sizes, durations, bit rates and labels for people, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsift.functions.text import in_language

# ---- fixed values: units and labels by language -------------------------------------------------

UNITS = {
    "fa": ["بایت", "کیلوبایت", "مگابایت", "گیگابایت", "ترابایت"],
    "en": ["B", "KB", "MB", "GB", "TB"],
}
NOTHING, PERSIAN_POINT = "—", "٫"

LABELS = {
    "fa": {
        "method.exact": "محتوای کاملاً یکسان",
        "method.audio": "صوت یکسان، تگ متفاوت",
        "method.tag": "تگ موزیک: آرتیست و عنوان",
        "method.feat": "همان آهنگ با ثبت متفاوت همکاران",
        "method.title": "عنوان یکسان",
        "method.name": "نام فایل یکسان",
        "method.duration": "مدت و حجم نزدیک",
        "method.size": "حجم مشابه (مشکوک)",
        "method.combined": "ترکیبی",
        "why.bitrate": "بیت‌ریت بالاتر ({n} kbps)",
        "why.size": "حجم بیشتر",
        "why.tags": "تگ کامل‌تر",
        "why.cover": "کاور دارد",
        "why.notcopy": "نامش نشانهٔ کپی ندارد",
        "why.older": "قدیمی‌تر است",
        "why.default": "انتخاب پیش‌فرض",
        "why.only": "تنها فایل گروه",
        "csv.state.keep": "نگه‌داشتن",
        "csv.state.drop": "برای حذف",
        "csv.state.suggest": "پیشنهاد حذف",
    },
    "en": {
        "method.exact": "Identical content",
        "method.audio": "Same audio, different tags",
        "method.tag": "Music tags: artist and title",
        "method.feat": "Same song, guest credits written differently",
        "method.title": "Same title",
        "method.name": "Same file name",
        "method.duration": "Close duration and size",
        "method.size": "Similar size (suspect)",
        "method.combined": "combined",
        "why.bitrate": "higher bitrate ({n} kbps)",
        "why.size": "larger",
        "why.tags": "more complete tags",
        "why.cover": "has cover art",
        "why.notcopy": "name shows no copy marker",
        "why.older": "older",
        "why.default": "default pick",
        "why.only": "only file in the group",
        "csv.state.keep": "keep",
        "csv.state.drop": "marked for deletion",
        "csv.state.suggest": "suggested for deletion",
    },
}

#: Header of the report, in the order of its columns.
REPORT = {
    "fa": ["گروه", "روش تشخیص", "اطمینان", "وضعیت", "نام فایل", "پوشه", "حجم (بایت)", "حجم", "مدت", "بیت‌ریت", "آرتیست", "عنوان", "آلبوم", "تاریخ تغییر", "دلیل نگه‌داشتن"],
    "en": ["Group", "Method", "Confidence", "State", "File name", "Folder", "Size (bytes)", "Size", "Length", "Bitrate", "Artist", "Title", "Album", "Modified", "Reason to keep"],
}

# -------------------------------------------------------------------------------------------------


def size_text(size: Column, lang: str = "fa") -> Column:
    """Bytes in the largest unit below 1024 of it: one decimal below 100, none for bytes; half to even."""
    units = UNITS.get(lang, UNITS["en"])
    value = size.cast("double")
    text = F.format_string(f"%.0f {units[0]}", F.bround(value, 0))
    for k in range(1, len(units)):
        v = value / float(1024**k)
        text = F.when(v >= 1, F.when(v >= 100, F.format_string(f"%.0f {units[k]}", F.bround(v, 0))).otherwise(F.format_string(f"%.1f {units[k]}", F.bround(v, 1)))).otherwise(text)
    if lang == "fa":
        text = in_language(F.replace(text, F.lit("."), F.lit(PERSIAN_POINT)), lang)
    return F.when(size.isNull(), NOTHING).otherwise(text)


def duration_text(seconds: Column, lang: str = "fa") -> Column:
    """m:ss or h:mm:ss, rounded half to even; a dash for none."""
    total = F.bround(seconds.cast("double"), 0).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when(F.coalesce(seconds <= 0, F.lit(True)), NOTHING).otherwise(in_language(text, lang))


def bitrate_text(bits: Column, lang: str = "fa") -> Column:
    text = F.concat(in_language(F.floor(bits / 1000).cast("string"), lang), F.lit(" kbps"))
    return F.when(F.coalesce(bits == 0, F.lit(True)), NOTHING).otherwise(text)


def label(name: Column, lang: str, n: Column | None = None) -> Column:
    """The label of a name in a language, else in ``fa``, else the name; ``{n}`` is replaced by n."""
    tables = [F.create_map(*(F.lit(x) for pair in LABELS[x_lang].items() for x in pair)) for x_lang in dict.fromkeys((lang, "fa")) if x_lang in LABELS]
    text = F.coalesce(*(F.try_element_at(t, name) for t in tables), name)
    return text if n is None else F.replace(text, F.lit("{n}"), n.cast("string"))
