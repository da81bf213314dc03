"""Call graphs of sources, generated regions, and the command line."""

from pyspark.sql import functions as F

from spindrift.__main__ import main
from spindrift.operators import code

SOURCE = '''
class Guard:
    def check(self): raise Refused("not_permitted")
def helper(): return {"verdict": "timeout"}
def tool(g):
    g.check()
    helper()
    def inner(): return "stale_id"
    return inner()
def selftest():
    def check(): return "internal_error"
    check()
async def other(): twice()
def a():
    def twice(): pass
def b():
    def twice(): pass
'''


def test_possible_verdicts(spark):
    found = code.facts(spark.createDataFrame([("m", SOURCE), ("bad", "def ("), ("none", None)], "file string, text string")).cache()
    assert [r.file for r in found.where("kind = 'error'").collect()] == ["bad"]
    edges = {(r.src, r.dst) for r in code.call_edges(found).collect()}
    assert ("tool", "Guard.check") in edges and ("tool", "helper") in edges and ("tool", "tool.inner") in edges
    assert ("selftest", "selftest.check") in edges and not any(s == "other" for s, _ in edges)
    got = code.possible_verdicts(found, spark.createDataFrame([("m:tool",), ("m:selftest",)], "start string")).collect()
    assert {r.verdict for r in got if r.start == "m:tool"} == {"not_permitted", "timeout", "stale_id"}
    assert {r.verdict for r in got if r.start == "m:selftest"} == {"internal_error"}


def test_regions(spark):
    text = "a\n<!-- BEGIN GENERATED: cli -->\nold\n<!-- END GENERATED: cli -->\nb <!-- BEGIN GENERATED: odd -->"
    df = spark.createDataFrame([("d", text)], "k string, t string")
    got = df.select(code.with_region(F.col("t"), "cli", r"new $1 \d")).first()[0]
    assert got.startswith("a\n<!-- BEGIN GENERATED: cli -->\n\nnew $1 \\d\n\n<!-- END GENERATED: cli -->")
    assert [tuple(r) for r in code.unpaired_regions(df, "k", "t").collect()] == [("d", "odd", "no end")]


def test_command_line(spark, tmp_path, capsys):
    docs, out = tmp_path / "docs", str(tmp_path / "indexes")
    docs.mkdir()
    (docs / "fans.md").write_text("# Thermals\n\nfans slow down when it is cold\n\n# Other\n\ninventory of parts")
    run = lambda *a: main([*a, "--dir", out])
    assert run("build", str(docs), "--name", "notes") == 0 and "1 files, 1 chunks" in capsys.readouterr().out
    assert run("status", "notes", str(docs)) == 0
    (docs / "new.md").write_text("more")
    assert run("status", "notes", str(docs)) == 1 and "added: 1 new.md" in capsys.readouterr().out
    assert run("search", "notes", "fans slow down") == 0 and "fans.md:1-7  (Thermals)" in capsys.readouterr().out
    assert run("explain", "notes", "fans", "INVENTORY") == 0 and run("explain", "notes", "fans", "nowhere") == 1
    assert run("export", "notes", str(tmp_path / "notes.json")) == 0 and "1 files, 1 chunks" in capsys.readouterr().out
    assert '"file": "fans.md"' in (tmp_path / "notes.json").read_text()
    assert run("build", str(docs), "--name", "logged", "--log", str(tmp_path / "log")) == 0 and list((tmp_path / "log").rglob("*.parquet"))
    assert run("search", "missing", "x") == 2 and run("build", str(docs), "--name", "Bad Name") == 2


def test_calls_and_verdicts_are_followed_without_joins(spark):
    text = 'def f1():\n    f2()\n\ndef f2():\n    f1()\n    return "timeout"\n'
    found = code.facts(spark.createDataFrame([("a:b.py", text), ("c.py", text.replace("f2()", "f3()"))], "file string, text string"))
    edges = code.call_edges(found)
    assert {tuple(r) for r in edges.collect()} == {("a:b.py", "f1", "f2"), ("a:b.py", "f2", "f1"), ("c.py", "f3", "f1"), ("c.py", "f1", "f3")}
    got = code.possible_verdicts(found, spark.createDataFrame([("a:b.py:f1",), ("c.py:f1",), ("c.py:none",), ("none",)], "start string"))
    assert {tuple(r) for r in got.collect()} == {("a:b.py:f1", "timeout"), ("c.py:f1", "timeout")}
    for rows in (edges, got):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
