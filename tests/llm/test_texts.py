"""Packing, quality, language and toxicity."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import counts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import language, packing, quality, toxicity
from spindrift.llm.flat import flat

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aéÀß×÷'<|>.,12 \n\x1c\x85\u0301sTl")), max_size=40), min_size=1, max_size=6))
def test_ids_are_those_of_whole_texts(texts):
    encode = packing.Encoder(PATH) if not hasattr(test_ids_are_those_of_whole_texts, "e") else test_ids_are_those_of_whole_texts.e
    test_ids_are_those_of_whole_texts.e = encode
    ids, n = encode(*flat(pa.array(texts)))
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [len(w) for w in want] == n.tolist() and [i for w in want for i in w] == ids.tolist()


def test_special_tokens_in_texts(encoder):
    texts = ["<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "it's DON'T we'll", ""]
    ids, _ = encoder(*flat(pa.array(texts)))
    assert ids.tolist() == [i for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_pieces_that_share_a_slot_keep_their_ids(encoder, monkeypatch):
    data = [" ".join(f"w{i * k % 97}x{i}" for i in range(60)) for k in range(1, 9)]
    expected = [encoder(*flat(pa.array([t]))) for t in data]
    monkeypatch.setattr(packing, "SLOT_BITS", 3)
    crowded = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        for t, (ids, n) in zip(data, expected, strict=True):
            got = crowded(*flat(pa.array([t])))
            assert np.array_equal(got[0], ids) and np.array_equal(got[1], n)


def test_packing(docs, rows, encoder):
    got = packing.pack(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and len(r.ids) == r.length == 1 << r.bucket for r in got)
    want = sorted((r[0] is None, r[0] or 0, encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    groups = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        groups.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
    for key in groups:
        assert sorted(i for r in groups[key] for i in r.ids) == sorted(i for w in want if w[:2] == key for i in w[2])
    whole = [r for r in got if r.doc_id == 505]
    whole.sort(key=lambda r: r.start)
    assert [i for r in whole for i in r.ids] == next(w[2] for w in want if w[1] == 505)
    assert sum(r.length for r in whole) == whole[0].doc_tokens


def test_pieces():
    assert packing.pieces(5000) == [2048, 2048, 512, 256, 128, 8] and packing.pieces(2048) == [2048] and packing.pieces(1) == [1]


def test_batches_keep_every_sequence(docs):
    packed = packing.pack(docs, PATH, with_ids=False)
    got = packing.batches(packed, 4096)
    assert got.count() == packed.count() and got.groupBy("batch", "bucket").count().count() >= packed.select("bucket").distinct().count()


def test_counts(docs, rows):
    got = quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    want = []
    for r in rows:
        c = counts(r[1])
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_bad_host_loses_its_documents(spark):
    good = "".join(f"word{i} " for i in range(60))
    rows = [(i, good + str(i), "bad" if i < 20 else "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[i] for i in range(20)) and all(got[i] for i in range(20, 40))


def _labelled():
    import random

    rng = random.Random(1)
    parts = {"aa": ["lo", "ri", "en", "ta"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "mu", "ã", "dos"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40)), lang))
    return rows


def test_language_is_found_on_held_out_texts(spark):
    rows = _labelled() + [(1000, None, "aa"), (1001, "123 -- 456", "bb"), (1002, "", None), (None, "lori enta", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = df.where("doc_id % 4 = 0 OR doc_id >= 1000 OR doc_id IS NULL")
    got = {r.doc_id: r for r in language.identify(held, df.where("doc_id % 4 != 0 AND doc_id < 1000"), columns=("lang",)).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 and got[i].accepted for i in range(0, 300, 4))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and not got[1001].accepted and got[None].lang_pred == "aa"


def test_a_rare_language_keeps_its_ngrams(spark):
    """Beside a language of 2.1 million n-grams, each seen once or twice, one whose n-grams are all seen once."""
    points = np.random.default_rng(4).integers(0x4E00, 0x9000, (100, 21_000)).astype(np.uint32)
    rows = [("big", p.tobytes().decode("utf-32-le")) for p in points] + [("rare", "lorienta mudos")]
    names, models = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert names == ["big", "rare"]
    assert len(models[0].grams[-1][0]) > 2_050_000 and len(models[1].grams[-1][0]) == 15
    symbols, _ = language._grams(["lorienta", "mudos"])
    alone = language.KneserNey(symbols, np.ones(len(symbols)))
    assert np.allclose(models[1].probability(symbols), alone.probability(symbols), rtol=1e-12)


def test_a_rare_language_has_limits_of_its_own(spark):
    """Ten documents of a language beside 4,100 of a plainer one; by a hash of the id they are the last."""
    ids = [r.id for r in spark.range(4110).orderBy(F.xxhash64("id")).collect()]
    rng = np.random.default_rng(6)
    rows = [(i, "lo ri lo lo ri ri lo " * 3, "aa") for i in ids[:-10]]
    rows += [(i, " ".join("".join(map(chr, rng.integers(0x4E00, 0x4E40, 4))) for _ in range(300)), "bb") for i in ids[-10:]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.identify(df, df, columns=("lang",)).where("lang = 'bb'").collect()
    assert len(got) == 10 and all(r.lang_pred == "bb" and r.accepted for r in got)


def test_noise_is_rejected(spark):
    df = spark.createDataFrame(_labelled(), "doc_id bigint, text string, lang string")
    noise = spark.createDataFrame([(1, "qxzkw vjhqp xxqzj wkvvq " * 12)], "doc_id bigint, text string")
    assert not language.identify(noise, df).first().accepted


def test_probabilities_sum_to_one():
    words = ["abba", "abab", "baab", "cab"]
    symbols, _ = language._grams(words)
    keys, first, n = np.unique(language._chain(symbols)[-1], return_index=True, return_counts=True)
    model = language.KneserNey(symbols[first], n)
    context = [language.PAD, language.PAD, ord("a"), ord("b")]
    every = np.array([[*context, x] for x in sorted({*map(ord, "abc"), language.END})], np.uint32)
    unknown = np.array([[*context, ord("z")]], np.uint32)
    assert abs(model.probability(every).sum() + model.probability(unknown).sum() - 1) < 1e-12


def _kneser_ney(words, order=5):
    """p(symbol | four symbols) by the recursion over dictionaries of all orders, from the words themselves."""
    grams = [("\x02" * (order - 1) + w + "\x03")[i : i + order] for w in words for i in range(len(w) + 1)]
    levels = [Counter(grams)]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    floor = 1 / (len({g[-1] for g in grams}) + 1)

    def p(context, symbol, k):
        if k < 0:
            return floor
        level = levels[k]
        ones, twos = (sum(1 for v in level.values() if v == n) for n in (1, 2))
        discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
        context = context[len(context) - k :]
        row = {g: v for g, v in level.items() if g[:-1] == context}
        lower = p(context[1:], symbol, k - 1)
        if not row:
            return lower
        total = sum(row.values())
        return max(row.get(context + symbol, 0) - discount, 0) / total + discount * len(row) / total * lower

    return p


def test_probabilities_by_the_plain_recursion():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(60)]
    symbols, _ = language._grams(words)
    _, first, n = np.unique(language._chain(symbols)[-1], return_index=True, return_counts=True)
    model, plain = language.KneserNey(symbols[first], n), _kneser_ney(words)
    for _ in range(300):
        gram = "".join(rng.choices("abcdéz\x02\x03", k=5))
        asked = np.array([[ord(c) for c in gram]], np.uint32)
        assert abs(model.probability(asked)[0] - plain(gram[:-1], gram[-1], 4)) < 1e-12


def test_letters(spark):
    texts = ["½²①", "٣٤٥", "_ __", "日本", "ª", "a1", "²x", "—“”", None, "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df = spark.createDataFrame(_labelled(), "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred != "und" for r in language.identify(docs, df).collect()}
    assert [got[i] for i in range(len(texts))] == [False, False, False, True, True, True, True, False, False, False]


def test_language_without_labels(empty, docs):
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(empty, docs).count() == 0


def _toxic(spark):
    import random

    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        w = ["".join(rng.choices(["lo", "ri", "en", "ta"], k=3)) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["Grumpel", "grumpels", "vile", "v1le", "VİLE"[:2] + "le"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(texts + [(9000, None), (9001, ""), (None, "vile")], "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = _toxic(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, labels.where("doc_id % 4 != 0 OR doc_id IS NULL")).collect()}
    right = [got[i].predicted == int(i % 5 == 0) for i in range(0, 600, 4)]
    assert np.mean(right) > 0.95 and got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1


def test_folding_and_exceptions():
    match = toxicity.Matcher({"vile ": 3.0, "trash ": 2.0, "grum": 1.0})
    assert match("V1LE")[0] == match("vіle")[0] == match("vi\u200ble")[0] == 3.0
    assert match("servile viler")[3] == 0 and match("a trash can, a trash")[3] == 1 and match("grumpel igrum")[3] == 1


def test_lexicon_keeps_what_tells_most(spark):
    """Not the common beginning of a toxic and a plain word, nor a word that few toxic documents hold by chance."""
    rng = random.Random(8)
    rows = []
    for i in range(800):
        w = ["".join(rng.choices(["lo", "ri", "en", "ta"], k=5)) for _ in range(30)]
        if i % 8 == 0:
            w[3] = "patherzon"
        elif i % 3 == 0:
            w[3] = "pathway"
        if i % 16 == 0:
            w[5] = rng.choice(["grumpeling", "grumpeled", "grumpelest"])
        rows.append((" ".join(w), int(i % 8 == 0)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(got) == {"patherzon ", "grumpel"} or set(got) == {"patherzon ", "grumpele", "grumpeli"} or set(got) == {"patherzon "} | {e for e in got if e.startswith("grumpel")}
    assert "path" not in got and len(got) <= 4


def test_exceptions_are_learnt(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        w = ["".join(rng.choices(["lo", "ri", "en", "ta"], k=5)) for _ in range(20)]
        bad = i % 4 == 0
        if bad:
            w[4] = "vilewort"
        elif i % 40 == 1:
            w[4:6] = ["vilewort", "flower"]
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn_lexicon(df)
    assert "vilewort flower" in toxicity.learn_exceptions(df, lexicon)
    asked = spark.createDataFrame([(1000, "en lori a vilewort flower here"), (1001, "en lori a vilewort here")], "doc_id bigint, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df.select("doc_id", "text").unionByName(asked), df.select("doc_id", "toxic"), exceptions=()).where("doc_id >= 1000").collect()}
    assert got == {1000: 0, 1001: 1}


def _plain_hits(text, lexicon, exceptions):
    """Words of a folded text that are or begin with an entry and do not lie inside an exception phrase."""
    text = toxicity.folded(text)
    spared = [m.span() for e in exceptions for m in re.finditer(rf"(?<![^\W_])(?={re.escape(e)}(?![^\W_]))", text) for m in [re.compile(re.escape(e)).match(text, m.start())]]
    hits = 0
    for m in re.finditer(r"[^\W_]+", text):
        found = [len(e.strip()) for e in lexicon if (m[0] == e.strip() if e.endswith(" ") else m[0].startswith(e))]
        hits += bool(found) and not any(a <= m.start() and m.start() + min(found) <= b for a, b in spared)
    return hits


def test_scoring_by_plain_search():
    rng = random.Random(10)
    lexicon, exceptions = {"ab ": 3.0, "abc": 2.0, "ba": 1.0, "cc ": 4.0}, ("ab c", "c abc", "ba ba")
    match = toxicity.Matcher(lexicon, exceptions)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b", "c", " ", "4", "."], k=rng.randint(0, 25)))
        assert match(text)[3] == _plain_hits(text, lexicon, exceptions), text


def test_many_hits_and_exceptions_take_linear_time():
    match = toxicity.Matcher({"trash ": 2.0}, ("trash can",))
    for n in (20_000, 40_000):
        began = time.perf_counter()
        assert match("trash can trash " * n)[3] == n
        assert time.perf_counter() - began < 5


def test_repeated_ids_give_one_text(spark):
    docs, labels = _toxic(spark)
    more = spark.range(5000).selectExpr("0L AS doc_id", "concat('lori enta ', id) AS text")
    got = toxicity.score(docs.unionByName(more), labels).where("doc_id BETWEEN 1 AND 599")
    assert got.where("predicted = CAST(doc_id % 5 = 0 AS INT)").count() > 590


def test_toxicity_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


def test_empty_tables(empty):
    assert packing.pack(empty, PATH).count() == 0 and quality.judge(empty).count() == 0
