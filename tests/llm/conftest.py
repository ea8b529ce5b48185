import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row long, unit long, rejected boolean, id long, label int"


def words(n, seed, stem="w"):
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, copies, near copies, and columns whose names clash."""
    base = words(120, 1)
    near = base.replace("w1", "x1", 1)
    texts = [
        (1, base), (2, base), (2, base), (3, near), (4, ""), (5, "   \n \t"), (6, None), (None, words(80, 2)), (None, None), (7, "one"), (8, words(30000, 3)),
        (9, "a line of seven plain words here\n" * 3 + "another line of seven quite other words"), (10, "a line of seven plain words here\nlast words of a text"),
        (11, "### $$$ %%% &&&"), (12, "É ü ß 漢字 \U0001f600 end"), (13, "1234 5678"), (50, words(60, 4)), (100, words(60, 5)),
    ]
    rows = [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 4 == 0 else f"s{k % 3}", len(t or "") or None, k, 0.5, 1, 2, None, 3, None) for k, (i, t) in enumerate(texts)]
    return [*rows, rows[0], rows[0]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (999, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
