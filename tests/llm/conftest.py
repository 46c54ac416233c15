import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) + str(r.randint(0, 9999)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, copies, near copies, shared passages and one very long text."""
    base = words(120, 1)
    near = list(base)
    near[60] = "changed"
    passage = words(60, 2)
    rows = [
        (1, " ".join(base) + ".", "en", "a", 5), (2, " ".join(base) + ".", "en", "a", 5), (3, " ".join(near) + ".", "en", "a", None),
        (4, None, "en", "b", 0), (5, "", None, None, None), (6, " \t\n\x0b\x0c\r ", "de", "b", 3), (None, " ".join(base) + ".", "en", "a", 7),
        (7, " ".join(words(30, 3) + passage + words(30, 4)) + ".", "fr", "c", 1), (8, " ".join(words(20, 5) + passage + words(25, 6)) + ".", "es", "c", 1),
        (8, " ".join(words(20, 5) + passage + words(25, 6)) + ".", "es", "c", 1), (9, "One two.\nOne two.\n\none two", "en", "a", 9),
        (10, "x" * 5000 + " " + "é日本🙂 " * 40, "xx", "a", 1), (11, " ".join(words(40_000, 7)), "en", "a", 1), (12, "WORD!! " * 40, "en", "a", 1),
        (13, "a | b | c | d | e | f\n" + " ".join(words(12, 8)) + ".", "en", "b", 1), (14, "Licensed under the X License.\n" + " ".join(words(20, 9)) + ".", "en", "b", 1),
        (15, "zero\x00byte  nbsp em\x1cfs " * 5, "en", "b", 1), (-3, " ".join(words(13, 10)), "en", "b", 1), (16, " ".join(words(13, 10)), "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns whose names operators use."""
    from pyspark.sql import functions as F

    out = odd
    for c in ("copy", "shuffle_key", "n_words", "kept", "n_tokens", "token_ids", "component_id", "fp", "n_removed", "score", "_q", "hash", "key", "node"):
        out = out.withColumn(c, F.lit("clash"))
    return out
