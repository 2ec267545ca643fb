import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A DataFrame of documents from (doc_id, text) pairs."""

    def make(rows, extra=None):
        schema = SCHEMA + (f", {extra} string" if extra else "")
        more = ("x",) if extra else ()
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *more) for i, t in rows], schema)

    return make


@pytest.fixture
def corpus():
    """Seeded documents: prose, exact and near copies, shared passages, empty and null texts, a long one, repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéèt ") for _ in range(rng.randint(2, 8))).strip() or "a" for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(40)
    rows = [(i, prose(rng.randint(0, 120))) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(4)] + [(110, rows[6][1] + " "), (111, rows[6][1].replace(" ", "\n"))]
    rows += [(120 + i, prose(20) + " " + shared + " " + prose(15)) for i in range(6)]
    rows += [(130 + i, rows[20][1] + f" tail{i}") for i in range(3)]
    rows += [(140, ""), (141, None), (142, " \t\n"), (143, "one"), (144, "x" * 5000 + " " + prose(4000)), (145, "ab" * 60), (146, "b" + "ab" * 60)]
    rows += [rows[7], rows[7]]
    rng.shuffle(rows)
    return rows
