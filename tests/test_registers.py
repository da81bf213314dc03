"""Names replaced at once, closure by doubling, rules in one scan, and sizes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import integrity


def _plain(text, names):
    if not text or not names:
        return text
    return re.sub(r"\b(?:%s)\b" % "|".join(re.escape(k) for k in sorted(names)), lambda m: names[m.group(0)], text)


def test_names_are_replaced_at_once(spark):
    rng = random.Random(3)
    cases = [
        ({"D-1": "D-2", "D-2": "X", "a.b": "Q"}, ["D-1 D-2 a.b axb", "D-10 xD-1 D-1", "", None, "a.b.a.b", "D-1-2"]),
        ({"a": "b", "b": "a", "a b": "both", "b a b": "three", "é": "e"}, [" ".join(rng.choices(["a", "b", "c", "a.", "é", "éa"], k=rng.randint(0, 30))) for _ in range(60)]),
        ({"$1": "x", "a$1": "money", "\\d": "digit", "[a]": "list"}, ["a$1 $1 b$1c \\d a\\d [a] a[a]b", "cost $1"]),
        ({"one": "1"}, ["one one,one one_one", "none"]),
    ]
    for names, texts in cases:
        rows = spark.createDataFrame(list(enumerate(texts)), "text bigint, t string").repartition(2)
        table = spark.createDataFrame([*names.items(), (None, "x"), ("", "y")], "name string, public string")
        got = {r.text: r.t for r in integrity.published(rows, table, "t").collect()}
        assert got == {i: _plain(t, names) for i, t in enumerate(texts)}
    assert integrity.published(rows, table.where("false"), "t").count() == 2


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("concat('D-', id) AS name", "concat('ISSUE-', 99999 - id) AS public")
    rows = spark.range(300).selectExpr("id", "concat_ws(' ', transform(sequence(0, 50), k -> concat('D-', (id * 331 + k * 17) % 120000, '.'))) AS text")
    got = integrity.published(rows, names)
    assert "Python" not in got._jdf.queryExecution().sparkPlan().toString()
    for r in got.collect():
        want = [(r.id * 331 + k * 17) % 120_000 for k in range(51)]
        assert r.text == " ".join(f"ISSUE-{99_999 - i}." if i < 100_000 else f"D-{i}." for i in want)


@pytest.mark.parametrize("wide", [0, 1, 4, 1000])
def test_closure(spark, wide):
    rng = random.Random(wide)
    edges = [(rng.randrange(40), rng.randrange(60)) for _ in range(70)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5), (None, 3), (3, None)]
    starts = [0, 7, 100, 115, 999, 0]
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    want = set()
    for s in starts:
        seen, todo = {s}, [s]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b is not None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(s, n) for n in seen}
    got, _ = integrity.closure(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(s,) for s in starts], "start bigint"), wide=wide)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_a_long_chain_takes_few_rounds(spark):
    got, rounds = integrity.closure(spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst"), spark.createDataFrame([(0,)], "start bigint"))
    assert rounds <= 16 and got.count() == 10_001


def test_rules_in_one_scan(spark):
    rows = spark.createDataFrame([(1, "pass", "e"), (2, "odd", None), (3, None, " ")], "id bigint, result string, expected string")
    rules = ((integrity.is_outside("result", integrity.RESULTS), "result outside its domain"), (integrity.is_blank("expected"), "no expected"), (F.col("id") > 9, "large"))
    assert sorted(map(tuple, integrity.violations(rows, "id", *rules).collect())) == [(2, "no expected"), (2, "result outside its domain"), (3, "no expected"), (3, "result outside its domain")]
    got = integrity.audit(rows, "id", *rules)
    assert sorted(map(tuple, got.collect())) == [("large", 0, None, None), ("no expected", 2, 2, 3), ("result outside its domain", 2, 2, 3)]
    assert integrity.audit(rows.where("false"), "id", *rules).agg(F.sum("n")).first()[0] == 0


def test_manifest_scans_a_table_once_for_its_own_rules(spark, tmp_path):
    tests = spark.createDataFrame([("T1", "fail", ["UR-1"], "f", "e", "o", "D-1", None)], "id string, result string, discharges array<string>, falsifier string, expected string, observed string, issue string, release_decision string")
    tests.write.parquet(str(tmp_path / "t"))
    plan = integrity.violations(spark.read.parquet(str(tmp_path / "t")), "id", (F.col("result") == "fail", "a"), (F.col("issue").isNull(), "b"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_sizes_are_printed_as_elsewhere(spark):
    values = [1, 1023, 1024, 1280, 1331, 1332, 928_000, 928 * 1000, 1_048_575, 1_048_576, 5_000_000_000, 1 << 50, 3 << 51, None, 0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n bigint").select(T.human_size("n")).collect()]

    def plain(n):
        for k, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
            if n < 1024 ** (k + 1) or unit == "PB":
                return f"{n / 1024**k:.1f} {unit}"

    assert got == [plain(v) if v else "unknown" for v in values]


def test_a_frequent_piece_is_one_row_a_text(spark):
    rows = spark.createDataFrame([(0, " ".join(["word"] * 1000)), (1, "word other")], "_row bigint, t string")
    held = rows.selectExpr("_row", "struct(t) AS _all", "regexp_extract_all(t, '[a-z]+|[^a-z]+', 0) AS _pieces")
    got = sorted((r._row, r.name, len(r.places)) for r in integrity.tried(held, {1: {True}}).where("_all IS NULL").collect())
    assert got == [(0, "word", 1000), (1, "other", 1), (1, "word", 1)]


def test_names_travel_once_a_block_and_texts_once(spark, tmp_path):
    """Names that many texts hold: what is exchanged grows with the distinct names and the texts, not with their product."""
    rows = spark.range(4000).selectExpr("id", "array_join(transform(sequence(0, 99), k -> concat('name', (id + k * k) % 300)), ' ') AS text").repartition(4)
    rows.write.parquet(str(tmp_path / "rows"))
    names = spark.range(300).selectExpr("concat('name', id) AS name", "concat('public', id) AS public")
    got = integrity.published(spark.read.parquet(str(tmp_path / "rows")), names)
    for r in got.collect():
        assert r.text == " ".join(f"public{(r.id + k * k) % 300}" for k in range(100))

    def exchanged(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return exchanged(plan.executedPlan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().length())]
        return own + sum(map(exchanged, below))

    assert exchanged(got._jdf.queryExecution().executedPlan()) < 4000 * 2 + 300 * 4 * 3
