"""Calls paid for once, atomic versions, and rows read in order."""

import json
import subprocess
import sys
import textwrap
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift.operators import calls, index
from spindrift.sources import commit, models, ordered
from spindrift.sources.models import HashEmbedder, OverlapDecider
from spindrift.streaming import ingest
from spindrift.verdicts import Refused


def _counted(folder):
    """How often each input was asked for, by the files that each call leaves."""
    out = {}
    for f in Path(folder).glob("*"):
        out[f.name.split("-")[0]] = out.get(f.name.split("-")[0], 0) + 1
    return out


def _counting(folder, fail=lambda t: False):
    folder.mkdir(exist_ok=True)

    def call(texts):
        import uuid

        for t in texts:
            if fail(t):
                raise RuntimeError("the worker breaks")
        for t in texts:
            (folder / f"{t}-{uuid.uuid4().hex}").touch()
        return [f"answer {t}" for t in texts]

    return call


def test_a_run_that_fails_half_way_asks_each_input_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 40}",) for i in range(100)], "text string").repartition(3)
    asked = tmp_path / "asked"
    ask = lambda fail: calls.answered(rows, F.col("text"), _counting(asked, fail), str(tmp_path / "log"), kind="chat", model="m", batch=2, every=4)
    with pytest.raises(Exception, match="the worker breaks"):
        ask(lambda t: len(list(asked.iterdir())) >= 15)
    before = _counted(asked)
    assert 0 < len(before) < 40
    got = ask(lambda t: False).collect()
    assert len(got) == 100 and all(r.answer == f"answer {r.text}" and r.error is None for r in got)
    assert _counted(asked) == {f"t{i}": 1 for i in range(40)}
    assert {r.text for r in got if r.reused} == set(before)
    assert all(r.reused for r in ask(lambda t: True).collect())  # nothing is left to ask
    other = calls.answered(rows, F.col("text"), _counting(asked), str(tmp_path / "log"), kind="chat", model="other", batch=2)
    assert not any(r.reused for r in other.collect())


def test_a_worker_that_dies_is_not_asked_again_for_what_it_logged(tmp_path):
    """Worker processes die in the middle of their tasks; Spark's own retries ask for the rest only."""
    code = f"""
        import os, pathlib, uuid
        from pyspark.sql import functions as F
        from spindrift.operators import calls
        from spindrift.session import session

        spark = session("local[2,6]", **{{"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.driver.memory": "1g"}})
        spark.sparkContext.setLogLevel("OFF")
        asked, died = pathlib.Path({str(tmp_path / "asked")!r}), pathlib.Path({str(tmp_path / "died")!r})
        asked.mkdir(), died.mkdir()

        def call(texts):
            for t in texts:
                if int(t[1:]) % 9 == 4 and not (died / t).exists():
                    (died / t).touch()
                    os._exit(1)
                (asked / f"{{t}}-{{uuid.uuid4().hex}}").touch()
            return [t.upper() for t in texts]

        rows = spark.createDataFrame([(f"t{{i}}",) for i in range(30)], "text string")
        got = calls.answered(rows, F.col("text"), call, {str(tmp_path / "log")!r}, kind="chat", model="m", every=1).collect()
        assert sorted(r.answer for r in got) == sorted(f"T{{i}}" for i in range(30)), got
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert _counted(tmp_path / "asked") == {f"t{i}": 1 for i in range(30)} and len(list((tmp_path / "died").iterdir())) > 1


def test_refusals_are_rows_and_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "text string")

    def broken(texts):
        if "b" in texts:
            raise Refused("timeout", "no answer", "")
        return texts

    ask = lambda call: {r.text: (r.answer, r.error, r.reused) for r in calls.answered(rows, F.col("text"), call, str(tmp_path / "log"), kind="chat", model="m").collect()}
    assert ask(broken) == {"a": ("a", None, False), "b": (None, "timeout: no answer", False), None: ("", None, False)}
    assert ask(lambda texts: ["new"] * len(texts)) == {"a": ("a", None, True), "b": ("new", None, False), None: ("", None, True)}


def test_builds_chats_and_decisions_from_the_log(spark, tmp_path):
    corpus = spark.createDataFrame([(f"{i}.md", f"# T{i}\n\nbody {i}") for i in range(12)], "file string, text string")
    plain, log, marks = HashEmbedder(8, "m"), str(tmp_path / "log"), tmp_path / "marks"
    marks.mkdir()

    def fails(texts):
        if len(list(marks.iterdir())) >= 5:
            raise RuntimeError("lost")
        (marks / str(abs(hash(texts[0])))).touch()
        return plain(texts)

    build = lambda embed: index.build(spark, corpus, "n", embed, model="m", limit=2048, path=str(tmp_path), log=log, batch=1)
    with pytest.raises(Exception, match="lost"):
        build(fails)
    had = calls.answers(spark, log).count()
    assert had > 0
    asked = spark.sparkContext.accumulator(0)

    def counts(texts):
        asked.add(len(texts))
        return plain(texts)

    made = build(counts)
    assert asked.value == 12 - had and all(index.invariants(made).first())
    same = index.build(spark, corpus, "n", plain, model="m", limit=2048)
    vectors = lambda t: sorted((r.file, r.pos, tuple(r.vector), r.norm) for r in t["chunk"].collect())
    assert vectors(made) == vectors(same)

    states = spark.createDataFrame([("1", "a license text"), ("2", ""), ("3", "a license text")], "item string, state string")
    questions = {"q": {"type": "choice", "instructions": "x", "labels": ["license", "other"]}, "p": {"type": "noul", "instructions": "license"}}
    want = sorted(map(str, (r.asDict() for r in models.decided(states, OverlapDecider(), questions).collect())))
    for again in (False, True):
        got = calls.decided(states, OverlapDecider(), questions, log, model="d")
        assert sorted(map(str, (r.asDict() for r in got.drop("reused").collect()))) == want
        assert {(r.item, r.reused) for r in got.select("item", "reused").collect()} == {("1", again), ("2", False), ("3", again)}

    chat = lambda messages: {"text": "|".join(m["content"] for m in messages), "done_reason": "stop", "eval_count": 3}
    history = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "c")])], "id bigint, prompt array<struct<role: string, content: string>>")
    assert sorted((r.id, r.text, r.done_reason, r.eval_count) for r in calls.completed(history, chat, log, model="c").collect()) == [(1, "a|b", "stop", 3), (2, "c", "stop", 3)]
    assert all(r.reused for r in calls.completed(history, chat, log, model="c").collect())


def test_readers_never_fail_while_builds_are_published(spark, tmp_path):
    corpus = lambda k: spark.createDataFrame([("a.md", f"text {k}"), ("b.md", "same")], "file string, text string")
    build = lambda k: index.build(spark, corpus(k), "n", HashEmbedder(4), model="offline-hash", limit=2048, path=str(tmp_path))
    build(0)
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                tables = index.read(spark, str(tmp_path), "n")
                seen.append(sorted(r.text for r in tables["chunk"].select("text").collect()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 21):
        build(k)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 5 and all(len(s) == 2 and s[0] == "same" for s in seen)
    assert commit.versions(spark, f"{tmp_path}/n") == list(range(1, 22))
    assert index.retain(spark, str(tmp_path), "n", 2) == 19
    assert len([p for p in (tmp_path / "n").iterdir() if not p.name.startswith("_")]) == 2
    assert index.read(spark, str(tmp_path), "n")["chunk"].count() == 2


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commit.latest(spark, path) == (0, None)
    results = []

    def write(k):
        try:
            commit.publish(spark, path, 1, {"writer": k})
            results.append(("ok", k))
        except Refused as e:
            results.append((e.verdict, k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for v, k in results if v == "ok"]
    assert len(won) == 1 and sorted(v for v, _ in results)[0] == "index_error" and len(results) == 8
    assert commit.latest(spark, path) == (1, {"writer": won[0]})
    corpus = spark.createDataFrame([("a.md", "text")], "file string, text string")

    def embed(texts):  # another build ends while this one embeds
        return [[1.0]] * len(texts)

    index.build(spark, corpus, "n", embed, model="m", limit=2048, path=str(tmp_path))
    tables = index.read(spark, str(tmp_path), "n")
    index.build(spark, corpus, "n", embed, model="m", limit=2048, path=str(tmp_path), force=True)
    with pytest.raises(Refused) as e:
        index.publish(tables["header"], tables["file"], tables["chunk"], str(tmp_path), "n", "late", 1)
    assert e.value.verdict == "index_error"


def test_stream_parts_are_compacted_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 3)
    source, table, seen = tmp_path / "in", str(tmp_path / "table"), []
    schema = "file string, text string, seen bigint"

    def run(cp):
        q = ingest.ingest(spark.readStream.schema(schema).parquet(str(source)), table, str(tmp_path / cp), lambda changed, n: seen.append((n, sorted(r.file for r in changed.collect()))))
        q.awaitTermination()

    for k in range(6):
        spark.createDataFrame([(f"f{k}", "x", k), ("f0", f"v{k}", k)], schema).coalesce(1).write.mode("append").parquet(str(source))
        run("cp")
    got = {r.file: (r.digest, r.seen) for r in ingest.current(spark, table).collect()}
    assert set(got) == {f"f{k}" for k in range(6)} and got["f0"][1] == 5
    _, held = commit.latest(spark, table)
    assert held["batch"] == 5 and len(held["parts"]) <= 3 and held["parts"][0].startswith("all-")
    before = commit.versions(spark, table)
    run("fresh")  # numbers its batches from 0 again: they were published
    assert commit.versions(spark, table) == before and len(seen) == 6


def test_rows_are_read_in_order(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 AS id", "cast(id % 7 AS string) AS g").repartition(9)
    files = ordered.parts(rows, F.col("id"))
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id")], ["id"])

    got = ordered.stream(spark, [(files,)], run, "id long")
    assert [r.id for r in got.collect()] == list(range(5000)) and "Sort" not in got._jdf.queryExecution().executedPlan().toString()


def test_generation_of_groups_over_parts(spark):
    rows = [(g, f"d{i // 7}/f{i}.md", f"{i * 31 % 97:x}") for i in range(300) for g in (["a"] if i % 3 else ["b", None, f"s{i}"])]
    df = spark.createDataFrame(rows, "g string, file string, digest string").repartition(5)
    got = {r.g: (r.generation, r.file_count) for r in index.generation(df, model="m", by=("g",)).collect()}
    assert got == {g: (index.generation(df.where(F.col("g").eqNullSafe(g)), model="m").first()[0], sum(r[0] == g for r in rows)) for g in ("a", "b", None, "s3")} | {g: v for g, v in got.items() if g not in ("a", "b", None, "s3")}
    assert len(got) == len({r[0] for r in rows}) and json.dumps(sorted(map(str, got)))
