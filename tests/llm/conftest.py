import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: copies, near copies, shared passages, nulls, empty, short and very long texts, repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = prose(rng, 90)
    rows += [(100 + i, base) for i in range(12)]
    for i in range(20):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)) for i in range(15)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "One"), (405, "a b c d"), (406, "A b  c D"), (407, "x" * 3000), (408, prose(rng, 6000)), (409, "é" * 250), (410, "ab" * 400)]
    rows += [(103, base), (None, base), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark):
    def make(rows, schema="doc_id long, text string", extra=True):
        df = spark.createDataFrame(rows, schema)
        # columns that clash with names used inside the operators
        return df.selectExpr("*", "1 as class_id", "'x' as key", "2 as bucket", "3.0d as score", "'y' as chunk") if extra else df

    return make
