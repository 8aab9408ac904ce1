"""Solar Hijri dates, stored times and relative dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsift.functions.text import in_language, persian_digits

# Month names, and the words of relative dates.
MONTHS = ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند"]
TODAY, YESTERDAY, DAYS_AGO, WEEKS_AGO, NEVER = "امروز", "دیروز", "{n} روز پیش", "{n} هفته پیش", "—"

#: Days of a cycle of 33 years, of four years, and of the first six months.
CYCLE, FOUR, HALF = 12053, 1461, 186


def jalali(day: Column) -> Column:
    """A Gregorian date as struct(year, month, day) of the Solar Hijri calendar, by integer arithmetic.

    Days count from the first day of the Hijri year 979, which began 79 days into 1600.
    """
    n = F.datediff(day, F.lit("1600-01-01").cast("date")) - 79
    in_cycle = F.pmod(n, F.lit(CYCLE))
    in_four = in_cycle % FOUR
    # the first year of four has 366 days
    later = F.when(in_four >= 366, F.floor((in_four - 1) / 365)).otherwise(F.lit(0))
    k = F.when(in_four >= 366, (in_four - 1) % 365).otherwise(in_four)
    year = 979 + 33 * F.floor(n / CYCLE) + 4 * F.floor(in_cycle / FOUR) + later
    month = F.when(k < HALF, F.floor(k / 31)).otherwise(6 + F.floor((k - HALF) / 30)) + 1
    rest = F.when(k < HALF, k % 31).otherwise((k - HALF) % 30) + 1
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), rest.cast("int").alias("day"))


def jalali_long(day: Column) -> Column:
    """Day, month name, year, with Persian digits."""
    j = jalali(day)
    return F.when(day.isNull(), NEVER).otherwise(persian_digits(F.concat_ws(" ", j["day"].cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), j["month"]), j["year"].cast("string"))))


def _digits(day: Column) -> Column:
    j = jalali(day)
    return F.format_string("%d/%02d/%02d", j["year"], j["month"], j["day"])


def jalali_short(day: Column) -> Column:
    return persian_digits(_digits(day))


def date_text(time: Column, lang: str) -> Column:
    """A timestamp's date: Solar Hijri with Persian digits in ``fa``, ISO in ``en``; a dash for null."""
    day = F.to_date(time)
    text = _digits(day) if lang == "fa" else F.date_format(time, "yyyy-MM-dd")
    return F.coalesce(F.when(time.isNotNull(), in_language(text, lang)), F.lit(NEVER))


def time_text(time: Column, lang: str) -> Column:
    clock = F.date_format(time, "HH:mm")
    text = F.concat_ws(" ", _digits(F.to_date(time)), clock) if lang == "fa" else F.date_format(time, "yyyy-MM-dd HH:mm")
    return F.coalesce(F.when(time.isNotNull(), in_language(text, lang)), F.lit(NEVER))


def parse_stored(text: Column) -> Column:
    """A time as databases write it: to seconds, minutes or the day, the longest that fits; else null."""
    text = F.replace(F.trim(text), F.lit("T"), F.lit(" "))
    forms = (("yyyy-MM-dd HH:mm:ss", 19), ("yyyy-MM-dd HH:mm", 16), ("yyyy-MM-dd", 10))
    return F.coalesce(*(F.try_to_timestamp(F.when(F.length(text) >= n, F.substring(text, 1, n)), F.lit(form)) for form, n in forms))


def relative(day: Column, now: Column) -> Column:
    """Today, yesterday, days below a week, weeks below 30 days, else the date, as for the future."""
    days = F.datediff(now, day)
    count = lambda form, n: F.replace(F.lit(form), F.lit("{n}"), persian_digits(n.cast("int").cast("string")))
    return (
        F.when(day.isNull(), NEVER)
        .when(days < 0, jalali_long(day))
        .when(days == 0, TODAY)
        .when(days == 1, YESTERDAY)
        .when(days < 7, count(DAYS_AGO, days))
        .when(days < 30, count(WEEKS_AGO, F.floor(days / 7)))
        .otherwise(jalali_long(day))
    )
