import random

import pytest

DOCS = "doc_id long, text string, lang string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(1000)) for _ in range(n))


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (id, text); the extra columns have names that operators also use."""

    def make(*rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", 0.5) for i, t in rows], DOCS)

    return make
