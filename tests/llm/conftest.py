import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, token string, kept int, _row int"


def prose(rng, n):
    syllables = ["ta", "ren", "mo", "li", "shu", "ka", "dor", "vel", "is", "un"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    shared = prose(rng, 120)
    out += [out[0], out[0], out[1].replace("ta", "ti", 1), shared + " " + prose(rng, 40), prose(rng, 40) + " " + shared, "Ünï çödé " * 90, "Ünï çödé " * 91]
    return [*out, None, None, "", " \n\t ", "one", "two words", "x" * 70_000, prose(rng, 20_000), "A,B;c!\n" * 50]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash with internal ones."""
    rows = [(i, t, None if i % 7 == 0 else "en", [None, "a", "b", "b", "c"][i % 5], None if t is None else len(t), i, f"k{i}", None, i, i) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None, None, None, None, None), rows[5], rows[5], (None,) * 10]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SHAPE)
