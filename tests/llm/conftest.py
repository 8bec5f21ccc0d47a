import random

import pytest

WORDS = "alpha beta gamma delta river stone light of the and to a in that is for on was with as by at from or an Ünder grün été".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, long, empty and null texts, repeated rows."""
    rng = random.Random(5)
    rows = [(k, text(rng, rng.randint(1, 150))) for k in range(40)]
    passage = text(rng, 60)
    for k in range(40, 55):
        rows.append((k, f"{text(rng, 20)} {passage} {text(rng, 20)}"))
    base = text(rng, 200).split()
    for k in range(55, 75):
        own = list(base)
        own[rng.randrange(200)] = "changed"
        rows.append((k, " ".join(own)))
    rows += [(75, " ".join(base)), (76, rows[3][1]), (77, rows[3][1]), (78, ""), (79, None), (80, "..., !"), (81, "one"), (82, "two words"), (83, "two words"), (84, text(rng, 20000)), (85, "=" * 3000), (86, "=" * 200)]
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in corpus], "doc_id long, text string, toxic string, n_words int, h int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
