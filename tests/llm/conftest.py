"""Small document tables with the cases that every operator must take: nulls, empty and long texts, ties, repeats, other columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the old river bends where seven grey stones stand under a quiet sky and no one asks why the water turns back on itself again".split()


def prose(n: int, seed: int) -> str:
    return " ".join(WORDS[(i * i * 7 + i * seed + seed * seed) % len(WORDS)] + ("" if i % 5 else str((i * seed) % 97)) for i in range(n))


def texts() -> list:
    base = prose(120, 3)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace("river", "brook", 1), "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, "   \n\t ", None, "a", 0),
        (7, "One", "en", None, 3),
        (8, prose(9000, 11), "en", "hot", None),
        (9, "Łódź naïve “quotes” 日本語 text 😀 and tails", "pl", "a", 1),
        (1, base, "en", "a", 1),
        (None, base + " more", "en", "a", 1),
        (None, None, None, None, None),
        (10, base.upper() + "!", "en", "a", 1),
        (11, prose(120, 5), "en", "a", 1),
        (12, "?!… 123 456", None, "a", 1),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Other columns named like results and internals, and one with a dot."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("simhash", "component_id", "n_words", "score", "ids", "shard", "__id", "__t", "__text", "a.b", "node", "size", "law", "n_tokens", "lang_pred"):
        out = out.withColumn(name, F.lit("x"))
    return out
