"""Periodic runs, fill-in-middle and language-model scores against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import LOW, WORD
from pyspark.sql import functions as F

from spindrift.llm import attention, flat, infill, packing, periodic

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# --- periodic runs --------------------------------------------------------------------------------------------------


def brute_runs(w, times=4, least=6):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            unit = rng.choices("abc", k=rng.randint(1, 7))
            w += (unit * rng.randint(1, 9))[: rng.randint(0, 40)] + rng.choices("abcdé", k=rng.randint(0, 4))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    return rows


def test_runs_and_what_is_left(spark, docs, rows):
    more = repetitive(1) + [(900, "x " * 5), (901, "x " * 6), (902, "a b " * 4), (903, "a b " * 3 + "a"), (904, "a b " * 2000), (905, " ".join("ab"[bin(i).count("1") % 2] for i in range(3000))), (None, "a b c " * 9)]
    for table, held in ((docs, [r[:2] for r in rows]), (spark.createDataFrame(more, "doc_id bigint, text string").repartition(3), more)):
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(table).collect()]
        want = []
        for d, t in held:
            w = WORD.findall(t or "")
            runs = brute_runs(w)
            want.append((d, len(w), runs, collapsed(w, runs)))
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("times", "least"), [(2, 2), (3, 5), (4, 6)])
def test_grids_of_every_spacing_find_all_runs(times, least):
    for _, text in repetitive(times, 80):
        w = WORD.findall(text)
        ids = np.unique(np.array(w or ["x"]), return_inverse=True)[1][: len(w)].astype(np.int64)
        for find in (periodic.find_runs, periodic._scanned):
            d, s, n, q = find(ids, np.array([0, len(w)]), times, least)
            assert sorted(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == brute_runs(w, times, least)


def test_hashes_that_cannot_be_trusted(monkeypatch):
    """With prefix hashes that hold all stretches for equal the result is verified, and found word by word."""
    ids = np.array([1, 2, 3, 4, 1, 2, 1, 2, 1, 2, 1, 2, 5, 5, 5, 5, 5, 5, 6])
    want = [x.tolist() for x in periodic.find_runs(ids, np.array([0, len(ids)]))]
    monkeypatch.setattr(periodic, "_power", lambda base, n: np.zeros(n, np.uint64))
    assert [x.tolist() for x in periodic.find_runs(ids, np.array([0, len(ids)]))] == want
    assert sorted(zip(*want[1:], strict=True)) == [(4, 8, 2), (12, 6, 1)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    buf = np.frombuffer(b"ab cd ab xyz", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12])
    monkeypatch.setattr(periodic, "span_hashes", lambda b, s, e: np.ones(len(s), np.uint64))
    assert periodic.word_ids(buf, starts, ends).tolist() == [0, 1, 0, 2]


def rewritten(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def run_query(function, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return function(table.sparkSession, str(tmp_path))


def test_op11_contract(docs, rows, tmp_path):
    got = run_query(periodic.op11_periodic, docs, tmp_path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for d, t, *_ in rows:
        w = rewritten(d, t)
        runs = brute_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((d, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] and r[4] > 1 for r in want)


def test_runs_of_an_empty_table(empty):
    assert periodic.periodic_runs(empty).count() == 0


# --- fill-in-middle -------------------------------------------------------------------------------------------------


def brute_infill(doc_id, text, seed=42, chosen=50, spm=80):
    t = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    hexed = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= chosen:
        return doc_id, len(u), "plain", t, None, None
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < spm:
        return doc_id, len(u), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return doc_id, len(u), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ODD = [(i, t) for i, t in enumerate(["", " ", "\n\n", "a", " a ", "<P>", "x <S> y", "<", "< P>S>", "a <", "🙂 é ü\x0bx", "<P", "S><", "a\x00b c", "<<S <M P>"] * 8, 2000)] + [(None, "no id"), (7, None), (7, None)]


def test_infill(spark, docs, rows):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(2)
    for seed, chosen, spm in ((42, 50, 80), (1, 100, 50), (1, 0, 50)):
        for table, held in ((docs, [r[:2] for r in rows]), (odd, ODD)):
            got = infill.transform(table, seed=seed, chosen=chosen, spm=spm)
            want = sorted((brute_infill(d, t, seed, chosen, spm) for d, t in held), key=str)
            assert sorted(map(tuple, got.collect()), key=str) == want
            back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
            assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t in held), key=str)


def test_op13_contract(docs, rows, tmp_path):
    got = run_query(infill.op13_infill, docs, tmp_path)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(d, n, form, p, m, sha(out), sha(t or "")) for (d, n, form, out, p, m), (_, t, *_) in ((brute_infill(*r[:2]), r) for r in rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(empty):
    assert infill.transform(empty).count() == 0


# --- language-model scores ------------------------------------------------------------------------------------------


@pytest.fixture
def small_model(monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 6)
    monkeypatch.setattr(attention, "RATES", (1e-2, 3e-3))


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), None]


def brute_base(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    count = Counter(t for (_, text, *_), h in zip(rows, held, strict=True) if not h for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    return [(d, h, len(w := tokens(t)), sum(x in count for x in w), total, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)) for (d, t, *_), h in zip(rows, held, strict=True)]


def test_op12_contract(small_model, docs, rows, tmp_path):
    got = run_query(attention.op12_attention, docs, tmp_path)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    key = lambda r: (str(r[0]), *r[1:4], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(brute_base(rows), key=key)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r.base_score for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    by_text = {}
    texts = dict(zip([(str(r[0]), len(tokens(r[1]))) for r in rows], [r[1] for r in rows], strict=True))
    for r in got:
        by_text.setdefault((texts[(str(r.doc_id), r.n_tokens)] or "", r.n_tokens), set()).add(round(r.score, 3))
    assert all(len(v) == 1 for k, v in by_text.items() if k[0] == "")  # equal texts, equal scores


def test_blocks_and_ranges_of_words_change_nothing(small_model, monkeypatch, docs):
    """Blocks of a text each, many ranges of hashes, and sums by levels give the base of one block."""
    whole = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in attention.scored(docs, F.col("doc_id") % 2 == 0, TOKENIZER).collect()}
    monkeypatch.setattr(attention, "BLOCK_TEXT", 1)
    monkeypatch.setattr(attention, "FAN", 2)
    monkeypatch.setattr(attention, "groups_of", lambda df, each: 300)
    assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in attention.scored(docs, F.col("doc_id") % 2 == 0, TOKENIZER).collect()} == whole


def test_nothing_to_learn_from_and_an_empty_table(small_model, docs, empty):
    got = attention.scored(docs, F.lit(None).cast("boolean"), TOKENIZER).collect()
    assert len(got) == docs.count()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0} and all(r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert attention.scored(empty, F.lit(True), TOKENIZER).count() == 0


def _toy(vocabulary=600, seed=5):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 90, 40)
    ids = rng.zipf(1.3, int(counts.sum())) % vocabulary
    classes = attention.Classes(np.bincount(ids, minlength=vocabulary).astype(float), np.arange(vocabulary) % 2 > 0, vocabulary - 1)
    x, _, _ = attention.sequences(classes, ids, counts)
    keys, n = np.unique(x.astype(np.int64) * vocabulary + np.insert(ids, np.cumsum(counts), vocabulary - 1), return_counts=True)
    return rng, ids, counts, classes, attention.After(classes, keys, n)


def test_probabilities_sum_to_one():
    """Over all ids that may come next: the classes' odds and the shares within them."""
    rng, _, _, classes, after = _toy()
    pairs = attention.class_pairs(after.pairs)
    model = attention.Model(attention.initial() + rng.normal(0, 0.2, len(attention.initial())), pairs)
    x = rng.integers(0, attention.CLASSES, (1, attention.WINDOW))
    state = model.states(x)[-1:]
    every = np.arange(len(classes.of))
    before = np.full(len(every), x[0, -1])
    p = np.exp(model.log_probs(np.repeat(state, len(every), 0), before, classes.of[every].astype(np.int64)) + after.log_shares(before, classes.of, every))
    empty_classes = np.setdiff1d(np.arange(1, attention.CLASSES), classes.of)
    rest = np.exp(model.log_probs(np.repeat(state, len(empty_classes), 0), np.full(len(empty_classes), x[0, -1]), empty_classes)).sum() if len(empty_classes) else 0
    assert abs(p.sum() + rest - 1) < 1e-3


def test_windows_score_each_position_once():
    """Against a loop that gives each position the window that scores it."""
    rng, ids, counts, classes, after = _toy()
    pairs = attention.class_pairs(after.pairs)
    model = attention.Model(attention.initial() + rng.normal(0, 0.2, len(attention.initial())), pairs)
    got = attention.text_scores(model, after, ids, counts, at_once=3)
    at, want = 0, []
    for n in counts:
        x, y, _ = attention.sequences(classes, ids[at : at + n], np.array([n]))
        share = after.log_shares(x, y, np.append(ids[at : at + n], len(classes.of) - 1))
        at, total = at + n, float(share.sum())
        for i in range(n + 1):
            start = 0 if i < attention.WINDOW else ((i - attention.WINDOW) // attention.STRIDE + 1) * attention.STRIDE
            state = model.states(x[None, start : start + attention.WINDOW].repeat(1, 0) if start + attention.WINDOW <= n + 1 else np.pad(x[start:], (0, start + attention.WINDOW - n - 1))[None])
            total += float(model.log_probs(state[i - start : i - start + 1], x[i : i + 1], y[i : i + 1])[0])
        want.append(total / math.log(10))
    np.testing.assert_allclose(got, want, rtol=1e-4)


def test_the_future_is_not_seen():
    rng, *_ = _toy()
    model = attention.Model(attention.initial(), np.full((attention.CLASSES,) * 2, 1 / attention.CLASSES, np.float32))
    x = rng.integers(0, attention.CLASSES, (1, attention.WINDOW))
    other = x.copy()
    other[0, 20:] = 1
    np.testing.assert_allclose(model.states(x)[:20], model.states(other)[:20], rtol=1e-5)


def test_gradient_and_training():
    """The gradient follows the loss, and training finds a copy from further back than pairs see."""
    rng = np.random.default_rng(3)
    unit = rng.integers(1, 40, (64, attention.WINDOW // 2 + 1))
    x = np.concatenate([unit[:, :-1], unit[:, :-1]], 1)
    y = np.concatenate([x[:, 1:], unit[:, :1]], 1)
    pairs = np.full((attention.CLASSES,) * 2, 1 / attention.CLASSES, np.float32)
    real = rng.random(x.shape) < 0.9
    trainer = attention.Trainer(attention.initial() + rng.normal(0, 0.05, len(attention.initial())), pairs)
    _, g = trainer.gradient(x, y, real)
    start = trainer.vector.astype(np.float64)
    step = 0.02 * g / np.linalg.norm(g)
    up, down = (attention.Trainer(start + s * step, pairs).gradient(x, y, real)[0] for s in (1, -1))
    assert abs((up - down) / (2 * 0.02) / np.linalg.norm(g) - 1) < 0.02
    trainer = attention.Trainer(attention.initial(), pairs)
    losses = [trainer.step(x, y, real) for _ in range(60)]
    assert losses[-1] < losses[0] - 1.5


def test_model_beats_pairs_on_texts_left_out(spark, small_model, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 40)
    rng = random.Random(2)
    vocab = ["".join(rng.choices(["th", "er", "in", "on", "re", "an"], k=2)) for _ in range(40)]
    rows = []
    for i in range(300):
        a, b = rng.sample(vocab, 2)
        rows.append((i, " ".join([a, b] * 20)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = attention.scored(docs, F.col("doc_id") % 5 != 0, TOKENIZER).where("NOT learns").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_every_window_of_a_block_is_trained_on():
    """The rounds' steps go through all windows of a large block once each, and through those of a small one at least once."""
    for windows in (1, 700, 40_001):
        seen = np.bincount(np.concatenate([w for turn in range(len(attention.RATES)) for w in attention.turns(windows, turn)]), minlength=windows)
        assert len(seen) == windows and seen.min() >= 1
        assert windows < 40_000 or seen.max() == 1
    counts = np.array([0, 1, 22, 23, 24, 100])
    x, _, edge = attention.sequences(_toy()[3], np.zeros(counts.sum(), np.int64), counts)
    start, n = attention.cut(edge)
    assert sorted(i for a, k in zip(start, n, strict=True) for i in range(a, a + k)) == list(range(len(x)))


def test_a_round_trains_on_every_position(spark, tmp_path):
    """Also where a block has more windows than its least steps take."""
    docs = spark.createDataFrame([(i, " ".join(f"{(i * k) % 977} the" for k in range(1, 4001))) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    stored = attention.materialise(attention.blocks(docs, F.col("doc_id") > 4, TOKENIZER))
    want = sum(int(n.sum()) + len(n) for _, n in attention.learnt(stored.select("learns", "n_ids", "ids").toArrow().to_batches()))
    classes = attention.Classes(np.ones(50_000), np.zeros(50_000, bool), 1)
    pairs = np.full((attention.CLASSES,) * 2, 1 / attention.CLASSES, np.float32)
    seen, summed = [], attention.summed

    def kept(rows, size):
        seen.append(summed(rows, size)[-2])
        return np.zeros(size)

    class Shared:
        def __init__(self, value):
            self.value = value

    attention.summed = kept
    try:
        for turn in range(len(attention.RATES)):
            attention.trained(stored, Shared(classes), Shared(pairs), attention.initial(), turn)
    finally:
        attention.summed = summed
    assert want > attention.STEPS * attention.BATCH[0] * len(attention.RATES) * attention.WINDOW and sum(seen) >= want


def test_class_sums():
    rng = np.random.default_rng(0)
    of = np.sort(rng.zipf(1.3, 3000) % attention.CLASSES)
    rows = rng.normal(size=(3000, 5)).astype(np.float32)
    want = np.zeros((attention.CLASSES, 5))
    np.add.at(want, of, rows)
    np.testing.assert_allclose(attention._class_sums(rows, of), want, atol=1e-3)


def test_a_worker_keeps_its_encoder():
    from spindrift.llm import packing

    assert packing.encoder(TOKENIZER) is packing.encoder(TOKENIZER)


@pytest.mark.parametrize("kinds", [1, 40, 100_000])
def test_distinct_hashes_are_those_of_a_sort(kinds):
    rng = np.random.default_rng(kinds)
    pool = rng.integers(0, 2**64, kinds, np.uint64) >> np.uint64(0 if kinds > 40 else 50)  # of few kinds all are in one slot
    for n in (0, 1, 5000):
        hashes = rng.choice(pool, n)
        got, expected = flat.distinct(hashes), np.unique(hashes, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(got, expected, strict=True))


def test_counts_after_classes(spark, tmp_path):
    size, end = 600, 599
    rng = np.random.default_rng(3)
    classes = attention.Classes(rng.zipf(1.2, size).astype(float), np.zeros(size, bool), end)
    texts, expected = [rng.integers(0, size, n) for n in (0, 1, 700, 40, 9000)], Counter()
    for ids in texts:
        own = [*ids.tolist(), end]
        expected.update(zip([0, *classes.of[own[:-1]].tolist()], own, strict=True))
    row = tuple(attention._packed(x) for x in (np.ones(len(texts), np.uint8), np.array([len(t) for t in texts], np.uint32), np.concatenate(texts).astype(np.uint16)))
    stored = spark.createDataFrame([row] * 3, "learns binary, n_ids binary, ids binary")
    keys, n = attention.counted_after(stored, spark.sparkContext.broadcast(classes))
    assert dict(zip(zip((keys // size).tolist(), (keys % size).tolist(), strict=True), n.tolist(), strict=True)) == {k: 3 * v for k, v in expected.items()}


def test_a_step_makes_few_arrays():
    """Their bytes a position stand for its cost: each pass over all positions makes or reads one."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, attention.CLASSES, (2, 256, attention.WINDOW))
    trainer = attention.Trainer(attention.initial(), np.full((attention.CLASSES,) * 2, 1 / attention.CLASSES, np.float32))
    trainer.step(x, y, np.ones(x.shape, bool))
    tracemalloc.start()
    trainer.step(x, y, np.ones(x.shape, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1900 * x.size


def test_scores_do_not_hold_all_windows():
    rng, _, _, classes, after = _toy()
    model = attention.Model(attention.initial(), attention.class_pairs(after.pairs))
    ids, counts = rng.integers(0, len(classes.of), 40_000), np.full(40, 1000)
    attention.text_scores(model, after, ids, counts)
    tracemalloc.start()
    attention.text_scores(model, after, ids, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(ids)


def test_large_weights_give_finite_scores():
    """Exponents that could overflow are held; others are not looked at."""
    rng, ids, counts, _, after = _toy()
    vector = np.concatenate([x.ravel() if k == "near" else x.ravel() + rng.normal(0, 200, x.size) for k, x in attention.parameters(attention.initial()).items()])
    model = attention.Model(vector, attention.class_pairs(after.pairs))
    assert model.bound > attention.MOST_IN and np.isfinite(attention.text_scores(model, after, ids, counts)).all()
    far = np.array([-500, 3, 500], np.float32)
    assert attention.odds(far.copy(), 500, 30).tolist() == [2.0**-30, 8, 2.0**30]
    assert attention.odds(far[1:2].copy(), 3, 30).tolist() == [8]


def test_words_are_cut_once(monkeypatch):
    """The encoder takes words that are known; what is odd in some words leaves the others as they were."""
    texts = ["It's 20% a<b Éa\x07b", "", " don't ", "x" * 40, "日本 Straße 12 'n", "\x00"]
    buf, offsets = flat.flat(attention.pa.array(texts))
    encode = packing.Encoder(TOKENIZER)
    bounds = flat.word_bounds(buf, offsets)
    monkeypatch.setattr(packing, "word_bounds", None)
    ids, n = encode(buf, offsets, bounds)
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
