"""Small documents for the tests, with the odd rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, row int, n int"

_words = [a + b for a in "ba ko li nu te ra mo si".split() for b in "ga pe no fi zu la re".split()]


def prose(seed, n=120):
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        k = rnd.randint(6, 14)
        out += rnd.choices(_words, k=k)
        out[-1] += "."
    return " ".join(out)


def odd_rows():
    """Null, empty, blank, repeated, very long, tied; columns with clashing names."""
    long_ = prose(99, 30_000)
    texts = [None, "", " \t\n", "one", prose(1), prose(1), prose(2), long_, "a" * 5000, "é日 ß\x00x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(3)), (4, prose(1))]
    return [(i, t, None, "s", len(t or ""), 1, 2, 3, 4) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in rows], SCHEMA
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
