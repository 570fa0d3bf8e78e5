import random

import pytest

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, v bigint, key string, stratum string, part int, shard int, run string"
)


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = "\n".join(sentence(rng, 40) for _ in range(500))
    same = sentence(rng, 80)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, same, "en", "a", 9),
        (5, same, "en", None, 9),
        (6, same, "de", "b", 9),
        (7, long, "en", "b", 9),
        (8, "one two three", "fr", "c", 9),
        (8, "one two three", "fr", "c", 9),
        (None, "no id at all but words", "en", "c", 1),
        (None, None, None, None, None),
        (9, "!!! ... 12 34", "en", "a", 9),
        (10, "Ünïcödé straße 日本語", "de", "a", 9),
        (11, same.upper() + "!", "en", "a", 9),
        (12, "x" * 30_000, "en", "z", 9),
    ]
    return [(*r, 0.5, 7, "k", "s", 1, 2, "r") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
