import random

import pytest

WORDS = ["the", "of", "and", "stone", "river", "Cloud", "façade", "night", "paper", "green", "über", "seven", "mountain", "signal", "table", "x"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, clashing columns."""
    base = prose(1, 120)
    rows = [
        (1, base, "a", 1),
        (2, base, "b", 2),
        (3, base.replace("stone", "STONE", 1), None, None),
        (4, None, "c", 3),
        (5, "", "c", 3),
        (6, " \t\n", "c", 3),
        (7, "two words", "c", 3),
        (8, prose(2, 30000), "c", 3),
        (9, prose(3, 70) + " " + " ".join(base.split()[20:90]) + " " + prose(4, 40), "d", 4),
        (10, "a " * 200, "d", 4),
        (11, prose(5, 90), "d", 4),
        (11, prose(5, 90), "d", 4),
        (None, base, "e", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, i int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
