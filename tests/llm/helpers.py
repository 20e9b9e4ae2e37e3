"""Documents for the tests of the corpus operators."""

import random

from loomgraph.llm import _text  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, p int, a string, ids string, words string, cid bigint"


def rows(*pairs):
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", "z", 5) for i, t in pairs]


def frame(spark, *pairs):
    """Documents with extra columns whose names clash with those used inside the operators."""
    return spark.createDataFrame(rows(*pairs), SCHEMA)


def prose(seed, words, vocabulary=400):
    g = random.Random(seed)
    return " ".join("".join(g.choice(["ba", "ke", "ti", "mo", "lu", "ra"]) for _ in range(g.randint(1, 3))) + str(g.randint(0, vocabulary) % 7 or "") for _ in range(words))


ODD = [(None, "a text without an id"), (900, None), (901, ""), (902, "   \n \n"), (903, "."), (904, "x" * 50_000)]
