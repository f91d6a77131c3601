"""Small tables with every awkward case: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

import pytest

SYLLABLES = "ab be co du ef gi ha ir jo ku la me no op qu ra si to ur ve".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(2, 4))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    plain = prose(1, 120)
    shared = prose(2, 70)
    rows = [
        (1, plain), (2, plain), (2, plain), (3, None), (4, ""), (5, " \n\t "), (None, "a b"), (None, None),
        (6, "one two three"), (7, "one two three"), (8, prose(3, 30_000)), (9, "été \U0001F600 <|endoftext|> İ x.\n\nx."),
        (10, prose(4, 40) + " " + shared + " " + prose(5, 40)), (11, shared + "\n" + prose(6, 60)),
        (12, plain + " more"), (13, "word"), (14, "Word"), (15, "x" * 100_000), (2, "another text"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward documents, with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    for name in ("_document", "_later", "_row", "document", "node", "part", "score", "n_words", "held_out", "label", "keys"):
        rows = rows.withColumn(name, F.lit("extra"))
    return rows.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
