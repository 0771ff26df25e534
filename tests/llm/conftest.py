import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def wordy(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Documents with copies, near copies, repeated passages, nulls, blanks, ties, repeated rows and a very long text."""
    rng = random.Random(11)
    base = wordy(rng, 120)
    passage = "\n".join(wordy(rng, 14) for _ in range(5))
    texts = [None, "", " \t\n", "one", "one two three four", "One TWO three four", "é ß 😀 x y z", base, base, base.upper()]
    for k in range(12):
        words = base.split()
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = wordy(rng, 1)
        texts.append(" ".join(words))
    texts += [f"{wordy(rng, 30)}\n{passage}\n{wordy(rng, 25)}" for _ in range(6)]
    texts += [wordy(rng, rng.randint(1, 200)) for _ in range(30)]
    texts.append(" ".join([wordy(rng, 4000)] * 6) + "x" * 5000)
    sources = ["a", "a", "a", "b", None, "é"]
    rows = [(10 * i + 3, t, "en", sources[i % 6], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[20], (None, base, "en", "a", len(base)), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows over several partitions, with columns whose names are those of results and helpers."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows, SCHEMA).repartition(5)
    for c in ("score", "size", "set", "bucket", "_id", "_key", "n_lines", "taken", "weight"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
