import random

import pytest

#: Extra columns are named as operators' own.
CLASHING = ("row", "chunk", "key", "doc", "row_hash", "bits", "found", "__doc", "__key", "cls", "band", "Hash", "route")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)


def words(rng, n, kinds=4000):
    return " ".join(f"w{rng.randrange(kinds)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies; and columns named as operators' own."""
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    edited = base[0].split()
    edited[60] = "edited"
    passage = words(rng, 50)
    long = "\n".join(words(rng, 30) for _ in range(400))
    texts = [
        *base, base[0], base[0], " ".join(edited), None, "", " \n\t ", "one", "one", "three short words",
        f"{words(rng, 40)} {passage} {words(rng, 40)}", f"{passage}\n{words(rng, 30)}", f"{words(rng, 30)}\t{passage}",
        long, "ab " * 500, "shared line of text\nown " + words(rng, 20), " Shared Line OF text \nother " + words(rng, 20),
        "ünïcode ¿qué? 漢字 " * 30, "é" * 900, "x" * 900, "12 34 !!", "shared line of text\nshared line of text",
    ]
    own, no = (*range(len(CLASHING)),), (None,) * len(CLASHING)
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), *own) for i, t in enumerate(texts)]
    rows.append(((1 << 63) - 1, "shared line of text\nthe largest id", "en", "s", 1, *own))
    rows.append((None, "no id here " + words(rng, 30), "en", None, None, *no))
    rows.append((None, "shared line of text\nno id", "en", None, None, *no))
    rows.append((None, None, None, None, None, *no))
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
