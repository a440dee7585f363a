import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):x}{'aeiou'[rnd.randrange(5)]}" for _ in range(n))


def make_rows():
    """Prose, copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rnd = random.Random(5)
    base, passage = words(rnd, 160), words(rnd, 70)
    rows = [words(rnd, rnd.randrange(3, 220)) for _ in range(30)]
    rows += [base, base, base + " end", base.replace(" ", "  ", 1), base.upper(), "start " + base]
    rows += [words(rnd, 40) + " " + passage + " " + words(rnd, 40) for _ in range(4)]
    rows += [None, "", " \n\t ", "one", "two words", words(rnd, 6000), "\n".join([base, "short", "", base[:-1], base + "x"]), "é日本 ß x " * 30, "a" * 900]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return [*out, out[3], (None, base[:300], "en", "s0", 300)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", text2 string, n long").coalesce(2).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
