import random

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, keep_id string, shard int, fp long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns named like results."""
    rng = random.Random(3)
    words = ["the", "of", "Ärger", "naïve", "gnu", "GENERAL", "public", "license", "x1", "it's", "¿qué?", "漢字", "🎉", "á", "<|endoftext|>"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(30_000)
    same = say(40)
    texts = [None, "", "   \t\n", "one", "two words", same, same, same + " end", long, long + " more", say(13), say(12), "a b c", "x" * 5000, "GNU general PUBLIC license", None, "", same]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, None if t is None else len(t), -k, "old", None, k, 7) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], rows[0], (None, same, None, None, None, None, None, None, None, None), (None, "lonely", None, None, None, None, None, None, None, None), (5, "another text of an id", "en", "src1", 1, 1, "x", "y", 1, 1)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
