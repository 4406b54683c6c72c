import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text, low=False):
    return WORD.findall(lower(text or "") if low else text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfgl')}{rng.randrange(vocabulary)}é" if rng.random() < .1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, long, shared and repeated texts, and words parted by unusual spaces."""
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "Ein Stück\x0bText\x1fmit Strich"), (5, base), (6, base), (7, base.upper())]
    shared = prose(rng, 30)
    for i in range(8, 40):
        text = prose(rng, rng.randrange(1, 200))
        if i % 3 == 0:
            text += " " + shared
        if i % 4 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = f"x{i}"
            text = " ".join(w)
        if i % 5 == 0:
            text += "\n" + "\n".join(["same line here", "other"] * 3)
        rows.append((i, text))
    rows.append((40, prose(rng, 30_000)))
    rows.append((41, "la " * 60))
    rows.append((41, "la " * 60))
    return [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
