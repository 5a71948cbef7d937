import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to", "vu", "ze") for b in ("n", "r", "st", "la", "mi", "do", "ck", "", "ngo", "th")]


def prose(seed, n, vocabulary=WORDS):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(vocabulary)
        out.append(w.capitalize() if i == 0 or out[-1].endswith(".") else w)
        if r.random() < 0.12:
            out[-1] += "."
    return " ".join(out)


#: Nulls, empty and blank texts, one very long text, repeated rows, ties, odd characters.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one two three"), (905, "ÀÉ ß 漢字   ' don't I'll\r\n\x0b x"), (906, "a" * 5000), (None, "a row without an id"), (907, "twice"), (907, "twice"), (908, "Ab ab AB ab")]


@pytest.fixture(scope="session")
def odd():
    return ODD


def frame(spark, rows, extra=True):
    """doc_id, text, and columns whose names clash with those that operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    data = [(i, t, 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, n int, lang string, `key` int")
