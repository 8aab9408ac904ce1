"""Text, date and format expressions against worked examples and a plain Python version."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinsift.functions import dates as D
from kinsift.functions import fmt as M
from kinsift.functions import text as T


def values(spark, rows, make):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r[0] for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def plain_normalize(s: str) -> str:
    """The folding in plain Python, step by step."""
    s = unicodedata.normalize("NFKC", s).translate(str.maketrans(T.LETTERS_FROM, T.LETTERS_TO)).translate(str.maketrans(T.DIGITS_FROM, T.DIGITS_TO))
    s = re.sub(T.INVISIBLE, "", s).casefold()
    s = re.sub("|".join(T.NOISE), " ", s, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s؀-ۿ]+", " ", s)).strip()


def test_folding_equals_plain_python(spark):
    rng = random.Random(5)
    alphabet = "abC 12_-.()[]éÉßŁ ｆ１ آكيةؤ۴٤ًﷺ हिन्दी 漢字🎉‌"
    words = ["official video", "HD", "320kbps", "www.site-1.com", "دانلود آهنگ", "remastered 2011", "lyrics", "Straße", "[320]"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) + " " + rng.choice(words) for _ in range(400)]
    assert values(spark, rows, T.normalize) == [plain_normalize(r) for r in rows]


def test_persian_letters_digits_and_joiners_fold(spark):
    assert len(set(values(spark, ["كتابي ۱۲", "کتابی ١٢", "کتاب‌ی 12"], T.normalize))) == 1


@pytest.mark.parametrize(
    ("name", "key"),
    [("song - copy (1) (2).mp3", "song"), ("Song (3).mp3", "song"), ("copy of song.mp3", "song"), ("آهنگ - کپی.mp3", "اهنگ"), ("a [12] .mp3", "a"), ("copyright.txt", "copyright"), ("song 320.mp3", "song 320")],
)
def test_name_key(spark, name, key):
    assert values(spark, [name], T.name_key) == [key]


def test_copies_are_recognised(spark):
    assert values(spark, ["song - copy", "Copyright", "آهنگ کپی", "song (2)", "song 2", "a duplicate"], T.looks_like_copy) == [True, True, True, True, False, True]


def test_credits(spark):
    assert values(spark, ["Ta Yeja (feat. Daniyal & Mahyar)", "Ta Yeja (Ft. Daniyal & Mahyar)", "Stay With Me", "Song ft. X", "Track [with Y]"], T.strip_credit) == ["Ta Yeja", "Ta Yeja", "Stay", "Song", "Track"]
    assert values(spark, ["Shayea & Daniyal & Mahyar", "Florence and the Machine", "AA vs. BB x CC", "", "K/L"], T.artists) == [["daniyal", "mahyar", "shayea"], ["florence and the machine"], ["aa", "bb x cc"], [], []]


def test_paths(spark):
    paths = ["/a/b/c.MP3", "c:\\x\\y.tar.gz", ".hidden", "plain"]
    assert values(spark, paths, T.name_of) == ["c.MP3", "y.tar.gz", ".hidden", "plain"]
    assert values(spark, paths, T.extension_of) == [".mp3", ".gz", "", ""]
    assert values(spark, paths, T.folder_of) == ["/a/b", "c:\\x", "", ""]
    assert values(spark, ["/a/b/c", "/a/b"], T.short_folder) == ["…\\b\\c", "/a/b"]


# Gregorian dates and the Solar Hijri dates they are.
ANCHORS = [("2026-03-21", (1405, 1, 1)), ("2025-03-21", (1404, 1, 1)), ("2024-03-20", (1403, 1, 1)), ("2021-03-21", (1400, 1, 1)), ("1979-02-11", (1357, 11, 22)), ("2026-08-07", (1405, 5, 16)), ("2025-03-20", (1403, 12, 30)), ("2000-01-01", (1378, 10, 11))]


def test_jalali_anchors(spark):
    got = values(spark, [a for a, _ in ANCHORS], lambda x: D.jalali(x.cast("date")))
    assert [tuple(g) for g in got] == [b for _, b in ANCHORS]


def test_jalali_days_follow_each_other(spark):
    days = [str(dt.date(2023, 3, 1) + dt.timedelta(k)) for k in range(800)]
    got = [tuple(g) for g in values(spark, days, lambda x: D.jalali(x.cast("date")))]
    assert len(set(got)) == len(got) and got == sorted(got)
    for (_, m, d), (_, m2, d2) in zip(got, got[1:], strict=False):
        assert (d2, m2) == (d + 1, m) or (d2 == 1 and d >= 29)


def test_relative_and_stored(spark):
    now = F.lit("2026-08-20").cast("date")
    got = values(spark, ["2026-08-20", "2026-08-19", "2026-08-17", "2026-08-05", "2026-08-21", None], lambda x: D.relative(x.cast("date"), now))
    assert got == ["امروز", "دیروز", "۳ روز پیش", "۲ هفته پیش", "۳۰ مرداد ۱۴۰۵", "—"]
    got = values(spark, ["2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02", "bad", "", None], D.parse_stored)
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 1, 2), None, None, None]


def test_units(spark):
    size = lambda lang: values(spark, ["0", "1023", "1024", "1536", "104857600", "1099511627776", None], lambda x: M.size_text(x.cast("bigint"), lang))
    assert size("en") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "100 MB", "1.0 TB", "—"]
    assert size("fa")[3] == "۱٫۵ کیلوبایت"
    assert values(spark, ["0", "59.5", "125.5", "3725", None], lambda x: M.duration_text(x.cast("double"), "en")) == ["—", "1:00", "2:06", "1:02:05", "—"]
    assert values(spark, ["320999", "0", None], lambda x: M.bitrate_text(x.cast("bigint"), "en")) == ["320 kbps", "—", "—"]
    assert values(spark, ["why.size", "nothing"], lambda x: M.label(x, "de")) == ["حجم بیشتر", "nothing"]


def test_hints_hold_wherever_the_patterns_do(spark):
    """A quick test never spares a text that its pattern would change."""
    import random

    rng = random.Random(4)
    words = ["official", "video", "lyrics", "HD", "4k", "full", "hd", "320", "64 K", "[128]", "album", "Remastered 2011", "www.a.com", "song.net", "downloaded by", "میکس شده", "دانلود آهنگ", "کیفیت 320", "(1)", "[22]", "- copy", "copy of", "کپی", "نسخه 2", "_duplicate", "feat.", "ft", "(with x)", "w/", "با حضور", "به همراه", "name", "-", ".", "ſong", "K", "é"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 5))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").withColumn("f", F.lower(T.fold(F.col("t"))))
    missed = df.filter((F.col("f").rlike(T.either(T.NOISE)) & ~F.col("f").rlike(T.NOISE_HINT)) | (F.col("t").rlike(T.either(T.COPY_MARKS)) & ~F.col("t").rlike(T.COPY_HINT)) | ((F.col("t").rlike(T.java(T.CREDIT_BRACKET)) | F.col("t").rlike(T.java(T.CREDIT_TRAIL))) & ~F.col("t").rlike(T.CREDIT_HINT)))
    assert missed.collect() == []
