import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside; they have to be ignored or carried.
CLASHING = "score double, digest string, rep bigint, h bigint, lo bigint, kind int, ids binary, words binary, component_id bigint, ranges string, _nth int, _kept_id bigint, _ranges string, _cut_id bigint, _words binary, salt int, band bigint, cell string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Null and empty texts, ties, repeated rows, a very long text, several scripts, a null id."""
    base = words(60, 1)
    long = words(60_000, 2) + " " + "x" * 5000
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, base + " and some words more"), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, "日本語 текст ñandú 😀"),
        (10, long), (11, long[: len(long) // 2] + " tail"), (12, words(80, 3)), (12, words(80, 3)), (None, base), (None, None), (14, "a b c d"), (15, "12 34 !!"),
    ]
    return [(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
