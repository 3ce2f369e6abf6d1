import random

import pytest

# columns of the caller's whose names operators might use themselves
EXTRA = ["doc", "tie", "data", "set", "size", "start", "kept", "label", "chunk", "_doc"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, words=("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega").split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts."""
    long = " ".join(prose(9, 50) + f" {i}" for i in range(400)) + " " + "x" * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "null id text"), (4, prose(1, 60), "en", "a"), (4, prose(1, 60), "en", "a"), (5, prose(1, 60), None, "b"), (6, long, "en", None), (7, "one"), (7, "two words"), (8, "Äöü ß 漢字 💩 ▁ <unk>", "de", "b")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
