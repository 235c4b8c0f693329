import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, f string, kept string, h int, bucket string"


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "in", "er", "an", "re", "é", "o", "St"]) for _ in range(rng.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(40)
    base = prose(300)
    texts = [prose(120), None, "", " \t\n", "one", "Ab cd", shared, base, base, base.replace(" ", "  ", 3), base + " " + word()]
    texts += [prose(60) + "\n" + shared + " " + prose(30) for _ in range(4)] + [prose(9000), "ab " * 2000, shared[:49], "a" * 200, "b" * 60 + "a" * 70]
    texts += ['x api_key: "abcdefgh12" token=short1 secret = "ab" AKIA' + "A1B2C3D4E5F6G7H8" + " " + "0123456789abcdef" * 3]
    out = [(i * 3 + 1, t, ["en", None][i % 2], ["s1", "s0", None, ""][i % 4], len(t or ""), i, "x", "y", 1, "z") for i, t in enumerate(texts)]
    return [*out, out[7], out[12]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
