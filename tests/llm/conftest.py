import random

import pytest

SYLLABLES = ["th", "er", "in", "on", "re", "an", "ti", "es", "ou", "ha", "nd", "st", "en", "ly"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, nulls, ties and odd texts."""
    rng = random.Random(7)
    rows, base = [], words(rng, 120)
    passage = " ".join(words(rng, 30))
    for i in range(60):
        kind = i % 6
        if kind == 0:  # a family around one text, with few or many changes
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
                w[rng.randrange(len(w))] = "x" + rng.choice(SYLLABLES)
            t = " ".join(w)
        elif kind == 1:
            t = " ".join(words(rng, rng.randint(1, 80)))
        elif kind == 2:
            t = " ".join(words(rng, 20)) + "\n" + passage + "\n" + " ".join(words(rng, 15))
        elif kind == 3:
            t = rows[rng.randrange(len(rows))][1]
        elif kind == 4:
            t = "Été ÉTÉ naïve — “quoted” 日本 🙂 it's 12.5% " + " ".join(words(rng, 30))
        else:
            t = ("ab " * rng.randint(1, 60)).strip()
        rows.append((i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), len(t or "")))
    rows += [
        (None, None, None, None, None), (None, rows[0][1], "en", "s0", 5), (500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, " \n\t ", None, "s1", 4),
        (503, rows[2][1], "en", "s0", 1), (503, rows[2][1], "en", "s0", 1), (503, "another text under one id", "en", "s0", 1), (504, "a", "en", "s0", 1),
        (505, " ".join(words(rng, 9000)), "en", "s0", 1), (-5, rows[4][1], "en", "s0", 1), (506, "one two three four", "en", "s0", 1), (507, "One TWO three four", "en", "s0", 1),
    ]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["id", "c", "h", "g", "p", "key", "size", "label", "host", "_k", "batch", "taken", "score", "media"]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The table over several partitions, with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASH:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
