import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __rank long, `odd name` string"


def make_docs(seed=1, n=120):
    """Documents with nulls, empty and wordless texts, copies, near copies, repeated rows, shared passages and ties."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = text(45)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "one"), (4, "One two THREE"), (5, "x" * 700), (6, "ab" * 260), (None, "no id"), (None, None)]
    for i in range(7, n):
        k = r.random()
        if k < 0.2:
            rows.append((i, rows[r.randrange(9, len(rows))][1] if len(rows) > 10 else text(30)))
        elif k < 0.35:
            rows.append((i, text(r.randint(0, 60)) + " " + shared + " " + text(r.randint(0, 60))))
        elif k < 0.5 and len(rows) > 12:
            w = (rows[r.randrange(9, len(rows))][1] or "x y").split(" ")
            w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, text(r.randint(1, 150))))
    rows += [rows[20], rows[20], (rows[21][0], text(40))]
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "sé", None]), None if t is None else len(t), 5, "extra") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
