import random

import pytest

WORDS = "alpha beta gamma delta omega sigma river stone cloud forest window paper bridge silver copper winter summer market garden engine".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, blanks, repeats, a very long text, and columns named as operators name theirs."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    texts = {1: base, 2: base, 3: base + " tail", 4: None, 5: "", 6: "  \n\t ", 7: "one two", 8: "ONE two", 9: sentence(rng, 20_000), 10: "ünïcode 😀 façade " + sentence(rng, 30), 11: sentence(rng, 5)}
    rows = [(k, t, ("en", "fr")[k % 2], f"s{k % 3}" if k % 4 else None, 0.5, "x", 7) for k, t in texts.items()]
    rows += [rows[0], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, cls string, n long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score double, cls string, n long")
