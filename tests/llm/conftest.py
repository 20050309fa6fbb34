import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 80)
    edited = base.split(" ")
    edited[40] = "changed"
    long = words(rng, 30_000)
    out = [
        (1, base, "en", "a", 1),
        (2, base.replace(" ", "\t\n ", 3), "en", "a", 1),
        (3, " ".join(edited), "en", "b", 1),
        (4, base.upper(), "en", "b", 1),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (7, " \t\n\r\x0b\x0c", "fr", None, 6),
        (8, long, "fr", "b", 9),
        (9, "x" * 50_000, "fr", "b", 9),
        (10, "one two three", "en", "c", 13),
        (11, "one\ttwo three", "en", "c", 13),
        (12, "ünï çé 漢字 \U0001f600 ñandú", "es", "c", 9),
        (13, "ünï çé 漢字 \U0001f600 ñandú <|endoftext|> tail", "es", "c", 9),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (14, "same line\nsame line\nsame line\n other\nsame line", "en", "a", 1),
        (15, "a b c d e a b c d e a b c d e f g h i j k", "en", "d", 1),
        (8, long, "fr", "b", 9),
    ]
    return out + [(100 + i, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr"]), rng.choice("abcd"), i) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns that bear names used inside the operators."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit(7) for name in ("_id", "_text", "_h", "_row", "_size", "_hash", "_hits", "kept", "size", "score", "_source", "n_email", "_key", "k", "rep", "component", "label")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
