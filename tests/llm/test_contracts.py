"""Every query against its contract on a table of odd rows, and every stage of the pipeline."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from brute import WORD, counts, near, passages
from pyspark.sql import functions as F

from spindrift.llm import queries

COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_jaccard": ["doc_id", "n_shingles", "component_id"], "op4_language": ["doc_id", "held_out", "lang_pred", "score"], "op5_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    labels.write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a.com/x", "<p>one</p>"), (2, "http://b.com/x", "<p>one</p>"), (2, "http://b.com/x", "<p>one</p>"), (3, None, None), (None, "x", ""), (4, "y", "\u00e9 \U0001f642")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, folder, rows, name):
    got = queries.queries()[name](spark, folder)
    assert set(COLUMNS[name]) <= set(got.columns)
    found = [r.asDict() for r in got.collect()]
    fold = lambda d, n: d is not None and zlib.crc32(str(d).encode()) % n
    if name == "op1_warc":
        digest = lambda t: __import__("base64").b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        assert Counter((r["page_id"], r["payload_digest"]) for r in found) == Counter([(1, digest("<p>one</p>")), (2, digest("<p>one</p>")), (2, digest("<p>one</p>")), (3, digest("")), (None, digest("")), (4, digest("\u00e9 \U0001f642"))])
        assert [(r["record_type"], r["refers_to"]) for r in found if r["page_id"] == 1] == [("revisit", 2)]
        return
    if name == "op2_packing":
        assert sum(r["length"] for r in found) == sum(r["doc_tokens"] for r in found if r["start"] == 0) and len([r for r in found if r["start"] == 0]) == len(rows)
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in found)
        return
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    if name == "op3_jaccard":
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == sorted(near([r[:2] for r in rows]), key=str)
    if name == "op4_language":
        assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in found)
    if name == "op5_suffix":
        assert sorted((tuple(r[c] for c in COLUMNS[name]) for r in found), key=str) == sorted(passages([r[:2] for r in rows]), key=str)
    if name == "op6_quality":
        assert sorted((tuple(r[c] for c in COLUMNS[name][:6]) for r in found), key=str) == sorted(((d, *counts(t)) for d, t, *_ in rows), key=str)
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in found)
    if name == "op7_toxicity":
        assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    if name == "op8_media":
        padded = lambda t: (b := (t or "").encode()) + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want = sorted(((d, len((t or "").encode()), len(p := padded(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for d, t, *_ in rows), key=str)
        assert sorted((tuple(r[c] for c in COLUMNS[name][:5]) for r in found), key=str) == want
    if name == "op9_mixing":
        sizes = Counter()
        for _, t, _, s, _ in rows:
            sizes[s] += len(WORD.findall(t or ""))
        assert sorted(((r["doc_id"], r["size"]) for r in found), key=str) == sorted(((d, len(WORD.findall(t or ""))) for d, t, *_ in rows), key=str)
        assert {r["source_size"] for r in found} == set(sizes.values()) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_rows_and_nothing(spark, docs, empty, folder, name):
    function = dict(corpus_pipeline.STAGES)[name]
    for table in (docs, empty):
        got = function(spark, table, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == corpus_pipeline.COLUMNS
        n = got.count()
        assert n == 0 if table is empty else n > 0


def test_stages_keep_what_they_say(spark, docs, rows, folder):
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    once = stage["n-gram Jaccard join"](spark, docs, folder)
    component = {(d, t): c for (d, t, *_), (_, _, c) in zip(rows, near([r[:2] for r in rows]), strict=True)}
    kept = texts(once)
    linked = [k for k in kept if component[k] is not None and WORD.search(k[1] or "")]
    assert len({component[k] for k in linked}) == len(linked) and {component[k] for k in component if component[k] is not None and WORD.search(k[1] or "")} == {component[k] for k in linked}
    cut = stage["suffix-array dedup"](spark, docs, folder)
    assert sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in cut.collect()) == sorted((str(d), h) for d, _, _, _, h in passages([r[:2] for r in rows]))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = Counter(texts(stage["mixing sources to target weights"](spark, docs, folder)))
    have = Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * have[k] for k, n in mixed.items()) and all(WORD.search(k[1] or "") for k in mixed)
