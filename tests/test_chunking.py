"""The chunker's columns and windows against plain loops."""

import random
import time

import plain_chunks
import pytest

from spindrift.operators import chunking


def _text(rng):
    out = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.random()
        if kind < 0.15:
            out.append("#" * rng.randint(1, 7) + rng.choice([" ", "  ", ""]) + rng.choice(["Title", "T # x ##", "é 🙂", "#"]) + rng.choice(["", " ##", "#"]))
        elif kind < 0.25:
            out.append(rng.choice(["```", "~~~", "  ```py", "`` `"]) + rng.choice(["", "\ncode", "\n# no heading"]))
        elif kind < 0.4:
            out.append("".join(rng.choices(["word ", "é", "🙂", "x" * 30, "\n", "\t"], k=rng.randint(1, 300))))
        else:
            out.append("\n".join(" ".join(f"w{rng.randrange(10**4)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))))
    gaps = ["\n\n", "\n \n", "\n \n\n", "\r\n\r\n", "\x0b\x0c", "  ", "\x85\x85", "\x1c\x1d", "\n\x1f\n"]
    return rng.choice(["", "\n", "  "]) + "".join(p + rng.choice(gaps) for p in out) + rng.choice(["", "end", " \n"])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [_text(rng) for _ in range(150)] + [None, "", " ", "a", "a" * 5000, "b " * 4000, "x\n" * 3000, "﻿# H\n\nx"]


@pytest.mark.parametrize("most", [201, 250, 400, 1500])
def test_chunks(spark, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), "file bigint, text string").repartition(3)
    got = sorted((r.file, r.pos, r.text, r.heading, r.line_start, r.line_end) for r in chunking.chunked(df, most).collect())
    want = [(i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(plain_chunks.chunks(t or "", most))]
    assert got == want and len(want) > 200


def test_blocks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "_row bigint, _text string").repartition(3)  # names that are used inside
    got = sorted((r["_row"], r.pos, r.text, r.line_start, r.line_end, r.heading) for r in chunking.paragraph_blocks(df, "_row", "_text").collect())
    assert got == [(i, k, *b) for i, t in enumerate(texts) for k, b in enumerate(plain_chunks.blocks(t or ""))]


def test_rows_that_share_a_key_stay_apart(spark):
    df = spark.createDataFrame([("k", "# A\n\none"), ("k", "two\n\nthree"), (None, "x")], "file string, text string").repartition(1)
    got = sorted(((r.file or "", r.pos, r.text, r.heading) for r in chunking.chunked(df, 201).collect()))
    assert got == [("", 0, "x", ""), ("k", 0, "# A\n\none", "A"), ("k", 0, "two\n\nthree", "")]


def test_one_exchange_and_no_python(spark):
    df = spark.createDataFrame([("k", "a")], "file string, text string")
    for made in (chunking.paragraph_blocks(df), chunking.chunked(df), chunking.long_slices(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString() + made._jdf.queryExecution().sparkPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan
        made.collect()
        assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 1


def test_long_paragraphs_take_time_in_proportion(spark):
    took = []
    for size in (1 << 20, 1 << 23):
        df = spark.range(1).selectExpr("id AS file", f"repeat('some words here\\n', {size // 16}) AS text")
        chunking.chunked(df).count()
        began = time.perf_counter()
        n = chunking.chunked(df).selectExpr("sum(length(text))", "max(line_end)").first()
        took.append(time.perf_counter() - began)
        assert n[1] == size // 16
    assert took[1] < 20 * took[0] + 2
