"""Chunks, builds, drift, hydration and exchange formats."""

import json
import random

import plain_chunks
import pytest

from spindrift.functions import text as T
from spindrift.operators import chunking, index, search
from spindrift.sources import index_json, markdown
from spindrift.sources.models import HashEmbedder
from spindrift.verdicts import Refused


def test_blocks():
    text = "# Alpha\n\none\ntwo  \n\n\n## Beta ##\nbody\n\n```\n# comment\n```\n\ntail\n"
    got = [tuple(b) for b in plain_chunks.blocks(text)]
    assert got == [("# Alpha", 1, 1, "Alpha"), ("one\ntwo", 3, 4, "Alpha"), ("## Beta ##\nbody", 7, 8, "Beta"), ("```\n# comment\n```", 10, 12, "Beta"), ("tail", 14, 14, "Beta")]


def test_fence_parity_side_effects():
    # A comment between blank lines inside a fence that closes in its paragraph counts as a heading, and a heading
    # whose paragraph opens a fence does not.
    assert [b.heading for b in plain_chunks.blocks("```\ncode\n\n# note\n```")] == ["", "note"]
    assert [b.heading for b in plain_chunks.blocks("# H\n```\n\nx\n```\n\ny")] == ["", "", ""]


def test_unicode_lines_and_space():
    got = [tuple(b)[:3] for b in plain_chunks.blocks("a\u2028b\x85c\n\n\u00a0\nd")]
    assert got == [("a\nb\nc", 1, 3), ("d", 6, 6)]
    assert plain_chunks.blocks("﻿# H\n\nx")[0].heading == ""


@pytest.mark.parametrize("size", [1497, 1498, 1499, 1500, 1501])
def test_lengths_at_the_limit(size):
    got = list(plain_chunks.chunks("a" * 10 + "\n\n" + "b" * size, 1500))
    assert "".join(c.text for c in got).count("b") >= size
    assert len(list(plain_chunks.chunks("b" * size, 1500))) == (1 if size <= 1500 else 2)


def test_small_sizes_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "file string, text string")
    for size in (0, 199, 200):
        with pytest.raises(Refused) as e:
            chunking.chunked(docs, size)
        assert e.value.verdict == "invalid_request"
    assert chunking.chunked(docs, 201).count() == 1


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("most", [300, 400, 1500])
def test_chunks_hold_their_text_and_lines(seed, most):
    rng = random.Random(seed)
    paragraphs = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, rng.choice([2, 30])))) for _ in range(rng.randint(1, 12))]
    text = "".join(p + "\n" * rng.randint(2, 4) for p in paragraphs)
    lines = text.splitlines()
    got = list(plain_chunks.chunks(text, most))
    seen = set()
    for c in got:
        cited = "\n".join(lines[c.start - 1 : c.end])
        words = c.text.split()
        assert words[0] in cited and words[-1].split("\n")[-1][-3:] in cited and c.start <= c.end
        assert len(c.text) <= most + chunking.OVERLAP + 2
        seen.update(words)
    assert set(text.split()) <= seen


def test_long_slices_match_the_chunker(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(999)}" + ("\n" if rng.random() < 0.1 else "") for _ in range(700)).replace("\n ", "\n") for _ in range(5)] + ["x" * 4000, "short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "file bigint, text string")
    a = {(r.file, r.pos): (r.text, r.line_start, r.line_end) for r in chunking.long_slices(df).collect()}
    b = {(r.file, r.pos): (r.text, r.line_start, r.line_end) for r in chunking.chunked(df).collect() if len(texts[r.file]) > 1500}
    assert a == b and len(a) > 10


def test_generation(spark):
    make = lambda rows, **k: index.generation(spark.createDataFrame(rows, "file string, digest string"), **({"model": "m"} | k)).first()[0]
    base = [("a.md", "1111"), ("b.md", "2222")]
    first = make(base)
    assert first == make(base[::-1]) and len(first) == 12
    others = [make([("a.md", "1112"), base[1]]), make(base, model="n"), make(base, chunk_chars=400), make(base, doc_prefix="ab", query_prefix="c"), make(base, doc_prefix="a", query_prefix="bc")]
    assert len({first, *others}) == 6


def test_path_order(spark):
    files = [("a/b.md", 0), ("a-b.md", 0), ("a.md", 0), ("a.md", 1)]
    got = index.ordinals(spark.createDataFrame(files, "file string, pos bigint")).orderBy("ordinal").collect()
    assert [r.file for r in got] == ["a/b.md", "a-b.md", "a.md", "a.md"] and [r.ordinal for r in got] == [0, 1, 2, 3]


def test_build_reuse_drift(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    plain = HashEmbedder(16)

    def embed(texts):
        calls.add(len(texts))
        return plain(texts)

    corpus = lambda rows: spark.createDataFrame(rows, "file string, text string")
    rows = [("sub dir/note.md", "# A\n\nfans slow down"), ("b.md", "inventory\n\nof things"), ("blank.md", "  \n")]
    made = lambda rows, **k: index.build(spark, corpus(rows), "notes", embed, model="m", limit=2048, path=str(tmp_path), **k)
    first = made(rows)
    assert calls.value == 2 and all(index.invariants(first).first())
    generation = first["header"].first().generation
    second = made(rows)
    assert calls.value == 2 and second["header"].first().generation == generation
    rows[1] = ("b.md", "other things")
    third = made(rows + [("c.md", "more")])
    assert calls.value == 4 and third["header"].first().generation != generation
    assert made(rows, force=True)["chunk"].count() == 2 and calls.value == 6
    stored = index.read(spark, str(tmp_path), "notes")
    now = index.digests(corpus([rows[0], ("b.md", "edited"), ("new.md", "x"), rows[2]]))
    drift = {r.file: r.status for r in index.drift(stored["file"], now).collect()}
    assert drift == {"sub dir/note.md": "same", "b.md": "changed", "new.md": "added", "blank.md": "same"}
    summary = index.drift_summary(index.drift(stored["file"], now))
    assert index.drift_exit(True, summary) == 1 and index.drift_exit(False, summary) == 2
    assert index.drift_exit(True, index.drift_summary(index.drift(stored["file"], stored["file"]))) == 0
    for name, verdict in (("none", "index_not_found"), ("Bad Name", "invalid_request"), ("notes\n", "invalid_request")):
        with pytest.raises(Refused) as e:
            index.read(spark, str(tmp_path), name)
        assert e.value.verdict == verdict


def test_build_refusals(spark):
    corpus = spark.createDataFrame([], "file string, text string")
    for df, limit, verdict in ((corpus, 10_000, "invalid_request"), (corpus, None, "context_unknown"), (corpus, 50, "invalid_request")):
        with pytest.raises(Refused) as e:
            index.build(spark, df, "x", HashEmbedder(), model="offline-hash", limit=limit)
        assert e.value.verdict == verdict


def test_vectors_that_do_not_match_are_an_error(spark):
    with pytest.raises(Exception, match="vectors for"):
        index.embedded(spark.createDataFrame([("a", "t")], "file string, text string"), lambda texts: []).collect()


VECTORS = [(0, [1.0, 0.0], "fans spin down"), (1, [0.9, 0.1], "x" * 70_000), (2, [0.0, 1.0], "inventory"), (3, [0.0, 0.0], "zero"), (4, [1.0, 0.0], "tie")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(VECTORS, "ordinal bigint, vector array<double>, text string")


def test_search(chunks):
    got = search.search(chunks, [1.0, 0.0], 4).orderBy("rank").collect()
    assert [r.ordinal for r in got] == [0, 4, 1, 2] and "text" not in got[0].asDict() and not got[0].weak_ranking
    assert search.search(chunks, [1.0, 0.0], 1).first().weak_ranking
    assert {r.ordinal: r.cosine for r in search.scored(chunks, [1.0, 0.0]).collect()}[3] == 0.0
    assert all(r.cosine is None for r in search.scored(chunks, [1.0, 0.0, 0.0]).collect())
    for k in (0, 26):
        with pytest.raises(Refused):
            search.search(chunks, [1.0, 0.0], k)


def test_explain(chunks):
    got = search.explain(chunks, [1.0, 0.0], "INVENTORY").first()
    assert (got.rank, got.of, got.ordinal, got.diagnosis) == (4, 5, 2, "no_failure")
    assert search.explain(chunks, [1.0, 0.0], "nowhere").first().diagnosis == "recall_failure_or_not_indexed"
    many = chunks.sparkSession.range(30).selectExpr("id AS ordinal", "array(1.0D, id * 0.1D) AS vector", "concat('t', id, '.') AS text")
    for needle, diagnosis in (("t3.", "no_failure"), ("t12.", "ranking_failure"), ("t25.", "recall_failure")):
        assert search.explain(many, [1.0, 0.0], needle).first().diagnosis == diagnosis


def test_hydrate(chunks):
    got = {r.ordinal: (r.id, r.state) for r in search.hydrate(chunks, "abc123", ["abc123:0001", "abc123:0", "abc123:0000", "abc123:0099"]).collect()}
    assert got == {0: ("abc123:0000", "ok"), 1: ("abc123:0001", "omitted_for_size"), 99: ("abc123:0099", "not_in_index")}
    for ids, verdict in ((["999999:0000", "nonsense"], "stale_id"), (["nonsense"], "invalid_request"), ([], "invalid_request")):
        with pytest.raises(Refused) as e:
            search.hydrate(chunks, "abc123", ids)
        assert e.value.verdict == verdict


def _reply(rows):
    return len(json.dumps({"chunks": [{"id": i, "path": f, "heading": h or "", "lines": [a, b], "text": t} for i, f, h, a, b, t in rows]}, ensure_ascii=False).encode())


@pytest.mark.parametrize("cap", [60, 500, 2000, 9000])
def test_byte_cap_counts_the_reply(spark, cap):
    rng = random.Random(cap)
    rows = [(g, k, f"i{k}", f"p/é{k}.md", rng.choice(["", None, 'He said "x"']), k, k + 2, "".join(rng.choices(["a", "\n", "\t", "é", "🙂", '"', "\\", "\x01", "/", "\x7f"], k=rng.randint(0, 400))) if k % 7 else None) for g in ("x", "y", None) for k in range(30)]
    want = {}
    for g in ("x", "y", None):
        held = []
        for _, k, *row in (r for r in rows if r[0] == g):
            if row[-1] is None:
                want[g, k] = "not_in_index"
            elif _reply([*held, row]) <= cap:
                held.append(row)
                want[g, k] = "ok"
            else:
                want[g, k] = "omitted_for_size"
    df = spark.createDataFrame(rows, "g string, ordinal bigint, id string, file string, heading string, line_start bigint, line_end bigint, text string").repartition(4)
    assert {(r.g, r.ordinal): r.state for r in search.fitted(df, cap, ("g",)).collect()} == want


def test_search_refuses_what_it_cannot_rank(spark, chunks):
    for call in (lambda: search.search(chunks, [1.0]), lambda: search.pool_spread(chunks, [1.0] * 5), lambda: search.explain(chunks, [1.0] * 3, "x")):
        with pytest.raises(Refused) as e:
            call()
        assert e.value.verdict == "invalid_request"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5]), (3, [0.0, 1.0]), (4, [None, 1.0])], "ordinal bigint, vector array<double>")
    assert [r.ordinal for r in search.search(df, [1.0, 0.0]).collect()] == [0, 3]
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [1.0]), (13, [0.0, 0.0])], "qid bigint, vector array<double>")
    got = {(r.qid, r.rank): (r.ordinal, r.cosine) for r in search.many(df, asked, 5).collect()}
    assert got == {(10, 1): (0, 1.0), (10, 2): (3, 0.0), (12, 1): (2, 1.0), (13, 1): (0, 0.0), (13, 2): (3, 0.0)}


def test_queries_keep_to_the_model(spark, tmp_path):
    corpus = spark.createDataFrame([("a.md", "words")], "file string, text string")
    with pytest.raises(Refused) as e:
        index.build(spark, corpus, "n", HashEmbedder(), model="nomic-embed-text", limit=2048)
    assert e.value.verdict == "model_not_found"
    details = spark.createDataFrame([("offline-hash", {"x.context_length": "100"}, None)], "name string, model_info map<string,string>, parameters string")
    made = index.build(spark, corpus, "n", HashEmbedder(), model="offline-hash", details=details, path=str(tmp_path))
    assert made["header"].first().chunk_chars == 320
    header = made["header"].first()
    assert search.embed_query(header, "words", HashEmbedder()) == HashEmbedder()(["words"])[0]
    with pytest.raises(Refused):
        search.embed_query(header, "words", HashEmbedder(name="m"))
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "current").mkdir()
    listed = [(r.name, r.verdict, r.chunk_count) for r in index.listing(spark, str(tmp_path)).collect()]
    assert listed == [("n", "ok", 1), ("torn", "index_unreadable", 0)]


def test_ordinals_over_parts(spark):
    rng = random.Random(4)
    files = sorted({("/".join(rng.choices(["a", "a-b", "b", "B", "é"], k=rng.randint(1, 4))) + f"{rng.randrange(50)}.md") for _ in range(400)}, key=lambda f: f.split("/"))
    rows = [(f, k) for f in files for k in range(rng.randint(1, 4))]
    got = index.ordinals(spark.createDataFrame(rows, "file string, pos bigint").repartition(5)).collect()
    assert {(r.file, r.pos): r.ordinal for r in got} == {r: i for i, r in enumerate(rows)}


def test_general_numbers(spark):
    values = [0.0, 1.0, 2.5, -3.25, 1e-7, 1234567.0, 123456.0, 1e20, 0.0001, 0.00009999, 999999.5, 0.1 + 0.2, -1e-5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {r.x: r.g for r in df.select("x", T.general("x").alias("g")).collect()}
    assert got == {v: "%g" % v for v in values} | {None: None}


def test_many_queries(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ordinal bigint, vector array<double>").repartition(5)
    asked = df.where("ordinal < 7").withColumnRenamed("ordinal", "qid")
    got = search.many(df, asked, 5, block=3).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(7):
        want = np.argsort(-(unit @ unit[q]))[:5].tolist()
        assert [r.ordinal for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want


def test_ties_are_bounded_where_they_are_found(spark):
    """Of a vector that thousands of chunks have, each pack hands on k."""
    import numpy as np
    from pyspark.sql import functions as F

    same = spark.range(9000).selectExpr("id AS ordinal", "IF(id % 3 = 0, array(1.0D, 2.0D, 3.0D), array(3.0D, 1.0D, cast(id AS double))) AS vector").orderBy(F.rand(1)).repartition(3)
    asked = spark.createDataFrame([(k, [1.0 + k, 2.0, 3.0]) for k in range(5)], "qid bigint, vector array<double>")
    got = search.many(same, asked, 4)
    v = np.array([[1.0, 2.0, 3.0] if i % 3 == 0 else [3.0, 1.0, i] for i in range(9000)])
    for q in range(5):
        a = np.array([1.0 + q, 2.0, 3.0])
        c = np.round(v @ a / np.linalg.norm(v, axis=1) / np.linalg.norm(a), 12)
        want = sorted(range(9000), key=lambda i: (-c[i], i))[:4]
        assert [r.ordinal for r in got.where(F.col("qid") == q).orderBy("rank").collect()] == want
    assert got.count() == 20


def test_index_documents(spark, tmp_path):
    chunk = lambda t, a, b: {"text": t, "heading": "H", "lines": [a, b], "vector": [1.0, 0.0]}
    good = {"format": 2, "name": "n", "generation": "abc", "file_count": 1, "chunk_count": 2, "files": [{"file": "a.md", "digest": "d", "chunks": [chunk("x", 1, 2), chunk("y", 4, 9)]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "legacy.json").write_text(json.dumps({"name": "old", "files": []}))
    (tmp_path / "broken.json").write_text('{"format": 2, "files": [')
    rows = index_json.read(spark, str(tmp_path))
    assert {r.document: r.verdict for r in rows.select("document", "verdict").collect()} == {"good.json": "ok", "legacy.json": "unsupported_index", "broken.json": "index_unreadable"}
    kept = index_json.cached(spark, str(tmp_path))
    assert kept.count() == 3 and index_json.cached(spark, str(tmp_path)) is kept
    (tmp_path / "legacy.json").write_text(json.dumps({"name": "older", "files": []}))
    assert index_json.cached(spark, str(tmp_path)) is not kept
    got = index_json.chunks(rows).orderBy("pos").collect()
    assert [(r.file, r.pos, r.text, r.line_start, r.line_end) for r in got] == [("a.md", 0, "x", 1, 2), ("a.md", 1, "y", 4, 9)]


def test_citations(spark):
    rows = spark.createDataFrame([(7, "a.md", 1, 4, "H"), (12345, "b.md", 2, 2, "")], "ordinal bigint, file string, line_start bigint, line_end bigint, heading string")
    header = spark.createDataFrame([("abc", "m", None)], "generation string, model string, built_at string")
    got = {r.id: (r.citation, r.built_at) for r in search.cited(rows, header).collect()}
    assert got == {"abc:0007": ("a.md:1-4  (H)", "unknown"), "abc:12345": ("b.md:2-2", "unknown")}


def test_export(spark, tmp_path):
    rows = [("b.md", "two"), ("a/c.md", "one\n\nmore"), ("é 🙂.md", "# H\n\n\"quoted\" \\ \u2028 text"), ("blank.md", " ")]
    tables = index.build(spark, spark.createDataFrame(rows, "file string, text string"), "n", HashEmbedder(4), model="offline-hash", limit=2048)
    made = index_json.export(tables, str(tmp_path / "n.json")).first()
    doc = json.loads((tmp_path / "n.json").read_text())
    assert [f["file"] for f in doc["files"]] == ["a/c.md", "b.md", "blank.md", "é 🙂.md"] and doc["files"][0]["chunks"][0]["lines"] == [1, 3] and doc["file_count"] == 4
    assert (made.files, made.chunks, made.bytes) == (4, 3, (tmp_path / "n.json").stat().st_size) and len(list(tmp_path.iterdir())) == 1
    back = index_json.chunks(index_json.read(spark, str(tmp_path)))
    columns = ("file", "pos", "text", "heading", "line_start", "line_end", "vector")
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, tables["chunk"].select(*columns).collect()))
    empty = {k: t.where("false") if k != "header" else t for k, t in tables.items()}
    index_json.export(empty, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["files"] == []


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_documents_in_blocks(block):
    import io

    doc = {"a": -12.5e-3, "format": 2, "name": "é🙂\u2028\"", "files": [{"chunks": [{"text": "x" * 50, "vector": [1, -2.5, 1e-9]}], "file": "f", "digest": "d"}, {"file": "g", "digest": None, "chunks": []}, {}], "odd": {"files": [[1], {}]}, "n": None, "last": 123456}
    for text in (json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False), "\n" + json.dumps(doc) + " \n"):
        got = list(index_json.events(io.BytesIO(text.encode()), block))
        assert [e[1:] for e in got if e[0] == "field"] == [(k, v) for k, v in doc.items() if k != "files"]
        assert [e[1:] for e in got if e[0] == "chunk"] == [("f", "d", 0, doc["files"][0]["chunks"][0])]
    whole = json.dumps(doc, ensure_ascii=False).encode()
    for bad in [whole[:k] for k in range(0, len(whole), 9)] + [whole + b"x", b"[]", b"", b'{"a" 1}', b'{"a": 1,}', b'{"files": [{"chunks": [1 2]}]}', b"\xff"]:
        with pytest.raises(ValueError):
            list(index_json.events(io.BytesIO(bad), block))


def test_a_document_larger_than_the_memory_for_it(tmp_path):
    """300 MB of document, read in a process that may not grow by a quarter of it."""
    import subprocess
    import sys

    code = """if True:
        import resource
        from spindrift.sources import index_json

        class Source:
            chunk = b'{"text": "' + b"word " * 400 + b'", "heading": "", "lines": [1, 2], "vector": [' + b"0.123456789, " * 99 + b"1]}"
            def __init__(self):
                self.parts = self.made()
                self.held = b""
            def made(self):
                yield b'{"format": 2, "files": [{"file": "f", "digest": "d", "chunks": ['
                for k in range(90_000):
                    yield (b", " if k else b"") + self.chunk
                yield b"]}]}"
            def read(self, n):
                while len(self.held) < n and (p := next(self.parts, None)) is not None:
                    self.held += p
                out, self.held = self.held[:n], self.held[n:]
                return out

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        n = sum(1 for e in index_json.events(Source()) if e[0] == "chunk")
        grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
        assert n == 90_000 and grown < 75, (n, grown)
    """
    import pathlib

    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir/note.md").write_bytes(b"a\r\nb\rc")
    (tmp_path / "bom.md").write_bytes(b"\xef\xbb\xbf# H\n\nx")
    (tmp_path / "bad.md").write_bytes(b"a\xffb")
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no")
    got = {r.file: r.text for r in markdown.scan(spark, str(tmp_path)).collect()}
    assert got["sub dir/note.md"] == "a\nb\nc" and got["bad.md"] == "a�b" and got["bom.md"].startswith("﻿") and "other.txt" not in got
    assert markdown.empty_files(spark, str(tmp_path)) == ["empty.md"]
    with pytest.raises(Refused):
        markdown.scan(spark, str(tmp_path / "none"))


def test_words_that_cancel_out_have_a_unit_vector():
    one = HashEmbedder(1)
    words = [f"w{i}" for i in range(20)]
    up = next(w for w in words if one([w])[0] == [1.0])
    down = next(w for w in words if one([w])[0] == [-1.0])
    assert one([f"{up} {down}"])[0] == [1.0]
    assert one(["", " - "]) == [[0.0], [0.0]]


def test_packs_of_vectors_are_bounded_in_bytes(spark):
    rows = spark.range(5).selectExpr("id AS ordinal", "array_repeat(1.0D, 100000) AS vector").coalesce(1)
    packs = search._packed(rows, "ordinal", 4096).selectExpr("octet_length(keys) DIV 8 AS n", "octet_length(vectors) AS bytes").collect()
    assert sum(p.n for p in packs) == 5 and max(p.bytes for p in packs) <= 1 << 21


def test_a_build_cuts_its_texts_once(spark, monkeypatch):
    cut, real = spark.sparkContext.accumulator(0), chunking.chunked

    def counting(docs, *args, **kw):
        def run(batches):
            for b in batches:
                cut.add(b.num_rows)
                yield b

        return real(docs.select("file", "text").mapInArrow(run, "file string, text string"), *args, **kw)

    monkeypatch.setattr(chunking, "chunked", counting)
    rows = [(f"{i}.md", f"word {i}") for i in range(7)]
    tables = index.build(spark, spark.createDataFrame(rows, "file string, text string"), "n", HashEmbedder(4), model="offline-hash", limit=2048)
    assert sorted(r.ordinal for r in tables["chunk"].collect()) == list(range(7)) and cut.value == 7


def test_a_document_is_read_and_written_in_parts(spark, tmp_path):
    """One document is many tasks' work, also where what looks like a file's begin is none; damage in a part is the document's."""
    chunk = lambda f, k: {"text": f'{f} {{"file": [{k}] é🙂', "heading": "", "lines": [k, k], "vector": [k / 7]}
    files = [{"file": f"{f:03d}.md", "digest": f"d{f}", "chunks": [chunk(f, k) | ({"file": "x"} if f % 3 == 0 else {}) for k in range(f % 5)], "more": {"file": "no", "digest": 1}} for f in range(200)]
    doc = {"format": 2, "name": "n", "files": files, "odd": [{"file": 1, "chunks": [2]}], "chunk_chars": 7}
    for folder, indent in (("a", None), ("b", 1)):
        (tmp_path / folder).mkdir()
        whole = json.dumps(doc, indent=indent, ensure_ascii=False).encode()
        (tmp_path / folder / "whole.json").write_bytes(whole)
        (tmp_path / folder / "cut.json").write_bytes(whole[: len(whole) // 2])
        (tmp_path / folder / "torn.json").write_bytes(whole.replace(b'"digest": "d150"', b'"digest" "d150"'))
        rows = index_json.read(spark, str(tmp_path / folder), span=500)
        got = {r.document: r for r in rows.collect()}
        assert {d: r.verdict for d, r in got.items()} == {"whole.json": "ok", "cut.json": "index_unreadable", "torn.json": "index_unreadable"}
        r = got["whole.json"]
        assert len(r.parts) > 5 and (r.name, r.chunk_chars, r.chunks) == ("n", 7, 400) and got["torn.json"].chunk_chars is None and got["torn.json"].chunks == sum(f % 5 for f in range(150))
        back = sorted((c.file, c.digest, c.pos, c.text, c.line_start, c.vector) for c in index_json.chunks(rows).collect())
        assert back == [(f["file"], f["digest"], k, c["text"], k, [k / 7]) for f in files for k, c in enumerate(f["chunks"])]
