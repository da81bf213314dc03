"""Near duplicates and repeated passages against brute force."""

import random

import numpy as np
import pytest
from brute import near, passages
from brute import shingles as brute_shingles
from pyspark.sql import functions as F

from spindrift.llm import jaccard, suffix


def test_components(docs, rows):
    got = jaccard.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(near([r[:2] for r in rows]), key=str)


def _family(n, seed=3):
    """Near copies at all distances from each other, with a hot passage and small vocabularies."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [f"v{rng.randrange(1000)}" for _ in range(60)] + base[:40]
        if i % 5 == 0:
            w = [w for k in rng.sample(range(20), 14) for w in base[5 * k : 5 * k + 5]]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("fit", "pivots", "grid", "deepest", "others"), [(8, 4, 8, 3, 0), (6, 3, 4, 0, 0), (20, 6, 512, 4, 3), (8, 4, 8, 3, 30)])
def test_families_are_split(spark, monkeypatch, fit, pivots, grid, deepest, others):
    rows = _family(120)
    for name, value in (("OTHERS", others), ("MEMBERS", 8), ("FIT", fit), ("PIVOTS", pivots), ("GRID", grid), ("DEEPEST", deepest)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(near(rows))


def test_voronoi_cells_split_separate_clusters(spark, monkeypatch):
    """A ring of several clusters that share a passage: cells are smaller than the ring and no link is lost."""
    rng = random.Random(1)
    rows = []
    for i in range(160):
        own = [f"k{i % 8}x{j}" for j in range(60)]
        for _ in range(rng.choice([0, 1, 2])):
            own[rng.randrange(60)] = f"q{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    sets = [brute_shingles(t) for _, t in rows]
    table = spark.createDataFrame([(i, len(s), bytearray(np.sort(np.array([hash(x) & (2**63 - 1) for x in s], np.uint64)).tobytes())) for i, s in enumerate(sets)], "c bigint, n bigint, shared binary")
    member = spark.createDataFrame([(7, i, i, len(s), True) for i, s in enumerate(sets)], "key bigint, c bigint, label bigint, n bigint, short boolean")
    for name, value in (("MEMBERS", 8), ("FIT", 30), ("PIVOTS", 20)):
        monkeypatch.setattr(jaccard, name, value)
    fitting = jaccard._regions(member, links := [], table, 4, 80)
    held = {}
    for r in fitting.collect():
        held.setdefault(r.key, set()).add(r.c)
    assert 1 < len(held) and max(map(len, held.values())) < 160
    together = {(a, b) for s in held.values() for a in s for b in s}
    linked = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked and all(p in together for p in linked)


def test_near_but_not_linked_families_cost_nothing(spark):
    """Texts that share three quarters with each other: the cells without a smaller set are never compared."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    sizes = []
    for n in (100, 300):
        rows = [(i, " ".join(w if k % 29 != i % 29 else f"z{rng.randrange(10**9)}" for k, w in enumerate(base[:-5] + [f"e{i}" for _ in range(5)]))) for i in range(n)]
        texts = spark.createDataFrame(rows, "c bigint, text string")
        sets = jaccard._shared_sets(texts, 4, 80, 5)
        entries = jaccard._entries(sets)
        sizes.append(entries.groupBy("h").agg(F.max("short").alias("s")).where("s").count())
        got = jaccard.join(texts.withColumnRenamed("c", "doc_id")).collect()
        want = {d: c for d, _, c in near(rows)}
        assert all(r.component_id == want[r.doc_id] for r in got)


def test_fingerprints_that_agree_by_halves(spark, monkeypatch):
    rows = _family(40, 5)
    plain = jaccard.fingerprints
    monkeypatch.setattr(jaccard, "fingerprints", lambda h, n, salt=None: plain(h, n) % 5 + 1 if salt is None else plain(h, n, salt))
    monkeypatch.setattr(jaccard, "ship", lambda spark: None, raising=False)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(near(rows))


def test_null_ids_and_equal_rows(spark):
    rows = [(None, f"one two three four five six {i % 3}") for i in range(300)] + [(5, "one two three four five six 1")] * 200
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(near(rows), key=str)


def test_clashing_names_go_through(spark):
    names = ["_id", "text_key", "_k", "_one", "c", "label", "_jac_row", "_jac_id"]
    df = spark.createDataFrame([(i, f"some words of document {i // 2} and more {i // 2}") for i in range(20)], "doc_id bigint, text string")
    for n in names:
        df = df.selectExpr("*", f"concat('{n}', doc_id) AS `{n}`")
    got = jaccard.representatives(df)
    assert got.columns == df.columns and got.count() == 10 and all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
    cut = suffix.dedup(df.withColumn("id", F.lit("x")).withColumn("g", F.lit("y")), columns=("id", "g", "_k", "n_bytes"))
    assert all((r.id, r.g, r._k) == ("x", "y", f"_k{r.doc_id}") for r in cut.collect())


def test_representatives(docs, rows):
    got = [r[:2] for r in jaccard.representatives(docs).select("doc_id", "text", "source").collect()]
    by_component = {}
    for (d, t, *_), (_, n, c) in zip(rows, near([r[:2] for r in rows]), strict=True):
        if n:
            by_component.setdefault(c, []).append((d, t))
    empties = [r[:2] for r in rows if not (r[1] or "").split()]
    assert len(got) == len(by_component) + len(empties)
    for c, members in by_component.items():
        assert sum(1 for r in got if tuple(r) in members) >= 1, c


def test_passages(docs, rows):
    got = suffix.dedup(docs, columns=("lang",)).collect()
    want = passages([r[:2] for r in rows])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    assert {"kept", "text", "lang"} <= set(got[0].asDict())


def test_passages_over_flushes_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = ["ab", "ba", "aab", "é"]
    rows = [(rng.randrange(25), "".join(rng.choices(alphabet, k=rng.randint(20, 400)))) for _ in range(40)]
    rows += [(100 + i, rows[i % 5][1][: 60 + 7 * i]) for i in range(20)]
    monkeypatch.setattr(suffix, "FLUSH", 50)
    monkeypatch.setattr(suffix, "BLOCK", 97)
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), with_kept=False).collect()
    assert sorted(map(tuple, got)) == sorted(passages(rows))


def _alone(data):
    return suffix.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


@pytest.mark.parametrize("block", [1, 7, 34, 35, 97, 128, 1000, None])
def test_contexts_do_not_depend_on_the_buffer(block):
    """Against the anchor of each window taken alone; a context's hash is that of its bytes taken alone."""
    rng = random.Random(11)
    texts = [bytes(rng.choices(range(97, 123), k=n)) for n in (0, 49, 50, 51, 85, 300, 0, 20, 131, 240)]
    want = []
    for i, t in enumerate(texts):
        own = [int(_alone(t[w : w + suffix.LENGTH])["h"][0]) for w in range(len(t) - suffix.LENGTH + 1)]
        starts = [w for w in range(len(own)) if w == 0 or own[w] != own[w - 1]]
        for a, b in zip(starts, [*starts[1:], len(own)], strict=False):
            want.append((i, a, b - a, own[a], int(_alone(t[a : b - 1 + suffix.LENGTH])["ctx"][0])))
    for lead in (0, 1, 13, 60, 96):
        every = [bytes(rng.choices(range(97, 123), k=lead)), *texts]
        offsets = np.cumsum([0, *map(len, every)])
        got = suffix.anchors(np.frombuffer(b"".join(every), np.uint8), offsets, block)
        rows = zip((got["doc"] - 1).tolist(), (got["start"] - offsets[got["doc"]]).tolist(), got["count"].tolist(), got["h"].tolist(), got["ctx"].tolist(), strict=True)
        assert [r for r in rows if r[0] >= 0] == want


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_sorting(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 5, 30])
    texts = [bytes(rng.randrange(1, 1 + size) for _ in range(49 + rng.randrange(1, 36))) for _ in range(rng.randrange(1, 9))]
    texts += [rng.choice(texts) for _ in range(3)]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    buf = np.zeros(int((lengths + 1).sum()) + 50, np.uint8)
    for t, s in zip(texts, starts, strict=True):
        buf[s : s + len(t)] = np.frombuffer(t, np.uint8)
    wanted = suffix.ragged(starts, lengths - 49)
    order = suffix.two_stage(buf, wanted)
    data = buf.tobytes()
    keys = [data[i : i + 50] for i in order]
    assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
    shared = suffix.common_prefixes(buf, order)
    assert all((n >= 50) == (i > 0 and keys[i] == keys[i - 1]) for i, n in enumerate(shared))


def test_empty_tables(empty):
    assert jaccard.join(empty).count() == 0
    assert jaccard.representatives(empty).count() == 0
    assert suffix.dedup(empty).count() == 0


def test_nothing_links(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(5)] + [(9, None)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id").collect()
    assert all(a == b for a, b in got) and len(got) == 6


def test_links_of_near_copies_are_thinned(spark):
    links = spark.range(300).selectExpr("1000 + id AS x", "explode(sequence(1, 20)) AS p").selectExpr("x", "CAST(p AS long) AS p")
    assert jaccard.thinned(links).count() <= 300 + 19
    assert {tuple(r) for r in jaccard.components(links).collect()} == {(c, 1) for c in [*range(1, 21), *range(1000, 1300)]}


def test_the_driver_has_a_task_a_group_and_gives_memory_back_each_round(spark, monkeypatch):
    groups = 3 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = spark.createDataFrame([(c, 2, np.arange(2, dtype=np.uint64).tobytes()) for c in (1, 2)], "c long, n long, shared binary")
    members, pivots = spark.createDataFrame([(7, 1)], "key long, c long"), spark.createDataFrame([(7, 2)], "key long, p long")
    met, exact = jaccard._distances(members, pivots, sets, groups, 80), jaccard._exact(members.union(pivots), sets, groups, 80)
    assert met.rdd.getNumPartitions() == exact.rdd.getNumPartitions() == groups
    assert [r.link for r in met.collect()] == [True] and [{r.x, r.p} for r in exact.collect()] == [{1, 2}]
    calls = []
    monkeypatch.setattr(jaccard, "trim", calls.append)
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "x long, p long")
    assert {tuple(r) for r in jaccard.components(path).collect()} == {(i, 0) for i in range(13)}
    assert len(calls) > 2
