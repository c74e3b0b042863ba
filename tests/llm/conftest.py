import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, sig string, n_words string"


def make_rows():
    """Prose with copies, near copies, shared passages, hot sources, nulls, empty, tiny and long texts, and repeated rows."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghiklmnorstuä") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(70)
    texts = [say(rnd.randint(30, 120)) for _ in range(24)]
    base = texts[0].split()
    for k in range(6):  # near copies of the first
        w = list(base)
        for _ in range(k):
            w[rnd.randrange(len(w))] = "neu"
        texts.append(" ".join(w))
    texts += [texts[1]] * 4 + [f"{say(20)}\n{passage}\n{say(20)}" for _ in range(4)]
    texts += [None, None, "", "", " \n\t ", "one", "ONE", "two words", "two  words", "é", "a" * 500, say(4000), "\x00\x85 x 　 y", "The the THE " * 40, "*** ### |" * 30]
    texts += ["Licensed under the Apache License, Version 2.0.\n" + say(15), say(12) + "\nReleased under the MIT License.", "x\n" * 30]
    rows = [(k, t, ("de", "fr", None)[k % 3], ("hot", "hot", "b", None, "c")[k % 5], len(t or ""), "k", "s", "w") for k, t in enumerate(texts)]
    return [*rows, rows[3], (rows[4][0], *rows[5][1:]), (1000, None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def rows():
    return ROWS
