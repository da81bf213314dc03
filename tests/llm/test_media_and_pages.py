"""Audio columns, WARC archives, URL filters, mixing."""

import base64
import gzip
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import media, mixing, urls, warc
from spindrift.llm.common import shared_folder


def _resampled(pcm, rate, to):
    """Each sample as its own sum over the filter that media._filters states."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps, half = media._filters(up, down)
    out = []
    for n in range(-(-len(pcm) * up // down)):
        at, phase = n * down // up, n * down % up
        total = sum(int(taps[phase][k]) * int(pcm[at - half + k]) for k in range(2 * half + 1) if 0 <= at - half + k < len(pcm))
        out.append(max(-32768, min(32767, (total + (1 << 14)) >> 15)))
    return out


@pytest.mark.parametrize("to", [4000, 8000, 11025, 12000, 16000])
def test_resampling(monkeypatch, to):
    rng = random.Random(to)
    for n in (1, 7, 192, 901):
        pcm = np.array([rng.randint(-32768, 32767) for _ in range(n)], np.int16)
        want = _resampled(pcm, 8000, to)
        for block in (5, 64, 1 << 18):
            monkeypatch.setattr(media, "BLOCK", block)
            assert media.resample(pcm, 8000, to).tolist() == want
    tone = np.round(12000 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)).astype(np.int16)
    again = np.round(12000 * np.sin(2 * np.pi * 440 * np.arange(len(media.resample(tone, 8000, to))) / to))
    assert np.abs(media.resample(tone, 8000, to)[200:-200] - again[200:-200]).max() < 60
    loud = np.round(12000 * np.sin(2 * np.pi * 3100 * np.arange(4000) / 8000)).astype(np.int16)
    assert to > 4000 or np.abs(media.resample(loud, 8000, to)[100:-100]).max() < 120  # what the lower rate cannot hold is gone


def _samples(payload, kind):
    """Samples by the definitions of the two companding laws, and by blocks of ADPCM."""
    if kind == media.ADPCM:
        return [x for i in range(0, len(payload), 192) for x in _adpcm(payload[i : i + 192])]
    out = []
    for code in payload:
        code ^= 0xFF if kind == media.MULAW else 0x55
        segment, step = code >> 4 & 7, code & 15
        size = ((2 * step + 33) * 2**segment - 33) * 4 if kind == media.MULAW else (2 * step + 1) * 8 if segment == 0 else (2 * step + 33) * 2 ** (segment - 1) * 8
        out.append(-size if bool(code & 128) == (kind == media.MULAW) else size)
    return out


def test_media_round_trip(docs, rows):
    stored = media.store(docs)
    got = media.expand(stored, rate=8000).withColumn("raw", F.col("pcm")).collect()
    found = {(r.doc_id, r.payload_sha256): r.feature for r in media.features(media.expand(stored, rate=8000)).collect()}
    want, payloads = [], {}
    for r in rows:
        t = (r[1] or "").encode()
        p = t.ljust(max(1, -(-len(t) // 192)) * 192)
        payloads[hashlib.sha256(p).hexdigest()] = p
        want.append((r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert {r.codec for r in got} == {"mulaw", "alaw", "adpcm"}
    for r in got:
        p = payloads[r.payload_sha256]
        kind = list(media.CODECS)[zlib.crc32(p) % 3]
        pcm = np.array(_samples(p, kind), np.int16)
        if kind == media.ADPCM:
            pcm = np.array(_resampled(pcm, 16000, 8000), np.int16) if len(pcm) < 5000 else media.resample(pcm, 16000, 8000)
        assert r.codec == media.CODECS[kind] and r.pcm == pcm.astype("<i2").tobytes()
        x = pcm.astype(int).tolist()
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert found[r.doc_id, r.payload_sha256] == f"{r.codec}:{len(x)},{sum(v * v for v in x)},{max(map(abs, x))},{turns},{zlib.crc32(r.pcm):08x}"
    assert media.store(docs.limit(0)).count() == 0 and media.features(media.expand(stored.limit(0))).count() == 0


def test_op8_reads_what_it_stored(spark, rows, tmp_path):
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op8_media(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    same = {}
    for r in got.collect():
        assert same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert got.count() == len(rows)


def test_expansion_tables():
    # Fixed points of the two companding laws.
    assert media.MULAW_PCM[0xFF] == 0 and media.MULAW_PCM[0x80] == 32124 and media.MULAW_PCM[0x00] == -32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0xAA] == 32256 and media.ALAW_PCM[0x2A] == -32256


def _adpcm(block: bytes) -> list[int]:
    p, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [p]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.STEPS[i]
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            p = max(-32768, min(32767, p - d if code & 8 else p + d))
            i = max(0, min(88, i + media.MOVES[code & 7]))
            out.append(p)
    return out


def test_adpcm_blocks():
    rng = random.Random(0)
    blocks = [rng.randbytes(64) for _ in range(20)]
    got = media.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(20, 64))
    assert got.tolist() == [_adpcm(b) for b in blocks]


def test_wav_errors():
    good = media.wav(b"x" * 10, rate=16000)
    assert media.read_wav(good) == (7, 16000, b"x" * 10)
    for bad in (b"", good[:30], good[:-3], b"JUNK" + good[4:]):
        with pytest.raises(ValueError):
            media.read_wav(bad)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS sha1", "1 AS payload", "2 AS archive").repartition(3)


PAGES = [(1, "http://a", "<p>é"), (2, "http://b", "<p>é"), (5, None, "<p>é"), (3, "http://c", None), (4, "x\r\ny", ""), (6, "http://d", "z" * 300_000), (None, "n", "<p>é"), (7, "u", "own"), (7, "u", "own")]


@pytest.mark.parametrize("least", [0, 4, 10])
def test_archives(spark, least):
    manifest = warc.write_archives(_pages(spark, PAGES), shared_folder(spark), min_revisit_bytes=least)
    got = warc.read_archives(manifest).collect()
    assert not any(r.error for r in got) and sum(r.records for r in manifest.collect()) == len(PAGES) == len(got)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        top = max((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        first = len(b) < least or top == i
        want.append((f"urn:page:{i}", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else f"urn:page:{top}"))
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_id) for r in got), key=str) == sorted(want, key=str)
    whole = open(manifest.first().archive.removeprefix("file:"), "rb").read()  # one gzip layer, a member a record
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\n")
    assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in got if r.record_type == "response")


def _record(i, body=b"hello"):
    return warc.record("response", f"urn:page:{i}", "http://x", body, hashlib.sha1(body).digest())


def test_damage_is_a_row_and_reading_goes_on():
    a, b, c = _record(1), _record(2, b"other" * 50), _record(3)
    broken = bytearray(b)
    broken[len(b) // 2] ^= 0xFF
    for data, bad in ((a + bytes(broken) + c, 1), (a + b + c[:-9], 1), (a + b + c, 0), (b"", 0)):
        got = list(warc.read_records(io.BytesIO(data)))
        assert sum(r["error"] is not None for r in got) >= bad and (bad or not any(r["error"] for r in got))
    ids = [r["id"] for r in warc.read_records(io.BytesIO(a + bytes(broken) + c)) if not r["error"]]
    assert ids[0] == "urn:page:1" and ids[-1] == "urn:page:3"
    plain = gzip.decompress(a).replace(b"hello", b"jello")
    assert "digest" in next(warc.read_records(io.BytesIO(gzip.compress(plain))))["error"]


@pytest.mark.parametrize("size", [60, 1_000, 30_000, 300_000])
def test_damage_loses_one_record(size):
    rng = random.Random(size)
    parts = [_record(i, rng.randbytes(size // 2) + b"gzip \x1f\x8b\x08\x00 inside " + rng.randbytes(size // 2)) for i in range(10)]
    for hurt in range(10):
        for place in (0.02, 0.5, 0.97):
            broken = bytearray(parts[hurt])
            broken[max(12, int(len(broken) * place))] ^= 0x55
            got = list(warc.read_records(io.BytesIO(b"".join(parts[:hurt]) + bytes(broken) + b"".join(parts[hurt + 1 :]))))
            assert [r["id"] for r in got if not r["error"]] == [f"urn:page:{i}" for i in range(10) if i != hurt]
            assert sum(r["error"] is not None for r in got) == 1


def test_headers_of_any_length():
    url = "http://x/" + "y" * (3 << 20)
    data = warc.record("response", "urn:page:1", url, b"body", hashlib.sha1(b"body").digest()) + _record(2)
    got = list(warc.read_records(io.BytesIO(data)))
    assert [(r["id"], r["error"]) for r in got] == [("urn:page:1", None), ("urn:page:2", None)] and got[0]["uri"] == url and got[0]["payload"] == b"body"


@pytest.mark.parametrize("most", [0, 1000])
def test_revisits_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    pages = [(i if i % 7 else None, "u", None if i % 2 else f"<p>{i % 10}") for i in range(200)]
    got = warc.read_archives(warc.write_archives(_pages(spark, pages), shared_folder(spark))).collect()
    top = {h: max(i for i, _, g in pages if g == h and i is not None) for _, _, h in pages}
    want = [(f"urn:page:{i}", f"urn:page:{top[h]}" if i != top[h] else None) for i, _, h in pages]
    assert sorted(((r.record_id, r.refers_to_id) for r in got), key=str) == sorted(want, key=str)


def test_archives_of_nothing(spark):
    manifest = warc.write_archives(_pages(spark, []), shared_folder(spark))
    assert warc.read_archives(manifest).count() == 0


URLS = [
    ("http://www.Example.COM/en/712?x", "www.example.com", "/en/712", "example.com/en/7", "allow"), ("https://shop.com/en/1#t", "shop.com", "/en/1", "com/en/", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("http://a.example.net/de/85", "a.example.net", "/de/85", "example.net/de/8", "block"),
    ("http://x.org/es", "x.org", "/es", None, None), ("ftp://x.org?es/", "x.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("http://com/en/", "com", "/en/", "com/en/", "block"), ("a://b://c/d", "b:", "//c/d", None, None), ("http://Ünï.com/en/x", "Ünï.com", "/en/x", "com/en/", "block"),
]


def test_rules(spark):
    rows = [(i, u, "<title>some words here</title>") for i, (u, *_) in enumerate(URLS)] + [(99, "http://free-bets.example.edu/fr/1", None)] * 6 + [(100 + i, f"http://plain{i}.example.edu/fr/1", "<title>Plain words</title>") for i in range(30)]
    got = urls.classify(_pages(spark, rows).withColumnRenamed("sha1", "token").withColumnRenamed("payload", "block")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert by_id[99].verdict == "block" and all(by_id[100 + i].verdict == "allow" for i in range(30))
    assert urls.classify(_pages(spark, [])).count() == 0


def test_rare_words_and_seeds_count_beside_many_others(spark):
    """More than 50,000 words of titles and paths, all more frequent than the words of one blocked host."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q"
    rows = [(i, f"http://site.org/{name(i % 51_000)}", f"<title>{name(i % 51_000)}</title>") for i in range(102_000)]
    rows += [(200_000, "http://zumbelescort.net/", "<title>zumbel</title>")]
    got = {r.page_id: r for r in urls.classify(_pages(spark, rows), rules=()).where("page_id IN (0, 200000)").collect()}
    ok, bad, kinds = 102_000 * 3, 3, 51_000 + 2 + 3
    weight = lambda m, n: math.log((n + 1) / (bad + kinds)) - math.log((m + 1) / (ok + kinds))
    base = math.log(2 / 102_001)
    assert abs(got[200_000].log_odds - (base + 3 * weight(0, 1))) < 1e-9
    assert abs(got[0].log_odds - (base + weight(102_000, 0) * 2 + weight(2, 0))) < 1e-9


def _plain_split(counts, name):
    """Every split of a name, the cheapest first, over all words and all unknown stretches."""
    total = sum(counts.values())
    cost = lambda w: -math.log(counts[w] / total) if w in counts else math.log(total) + 2 + 2.5 * len(w)
    best = {0: (0.0, [])}
    for end in range(1, len(name) + 1):
        best[end] = min(((best[s][0] + cost(name[s:end]), best[s][1] + [name[s:end]]) for s in range(end)), key=lambda x: x[0])
    return best[len(name)][0], cost


@pytest.mark.parametrize("seed", range(20))
def test_segmentation_against_all_splits(seed):
    rng = random.Random(seed)
    vocabulary = {"".join(rng.choices("ab", k=rng.choice([1, 2, 3, 5, 30]))): rng.randint(1, 50) for _ in range(8)}
    name = "".join(rng.choice([*vocabulary, "x", "yy"]) for _ in range(8))
    got = urls.Segmenter(vocabulary)(name)
    least, cost = _plain_split(vocabulary, name)
    assert "".join(got) == name and abs(sum(map(cost, got)) - least) < 1e-9


def test_long_words_and_many_labels(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    rows = [(1, f"http://{long}free.edu/", f"<title>{long} free {long}</title>"), (2, "http://" + "a." * 8000 + "example.com/en/7", None)]
    got = {r.page_id: r for r in urls.classify(_pages(spark, rows)).collect()}
    assert got[2].rule == "example.com/en/7"
    hosts = spark.createDataFrame([(f"{long}free.edu",)], "host string")
    words = spark.createDataFrame([(long, 5), ("free", 9), (long[:24] + "x", 3)], "word string, n long")
    assert urls.split_hosts(hosts, words, 17, 3).first().tokens == [f"h:{long}", "h:free", "t:edu"]


def test_pages_teach_words_of_urls_and_rules_do_not(spark):
    """Hosts that share a word with pages of blocked content are blocked, without that word on any list; ruled places teach nothing."""
    rows = [(i, f"http://zork{i}.zumbel.edu/a", "<title>casino night</title>") for i in range(30)]
    rows += [(100 + i, f"http://quiet{i}.garden.edu/a", "<title>quiet garden</title>") for i in range(60)]
    rows += [(500, "http://zork99.zumbel.edu/b", "<title>nothing here</title>"), (501, "http://quiet99.garden.edu/b", None)]
    rows += [(600 + i, f"http://place{i}.com/en/secretword", None) for i in range(30)] + [(700, "http://place.org/secretword", None)]
    got = {r.page_id: r.verdict for r in urls.classify(_pages(spark, rows)).collect()}
    assert got[500] == "block" and got[501] == "allow" and got[700] == "allow" and all(got[600 + i] == "block" for i in range(30))


def test_classifier_against_plain_naive_bayes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        bad = rng.random() < 0.2
        host = ".".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=2)) + rng.choice([".com", ".net", ".edu"])
        html = rng.choice([None, "<title>plain words</title><p>text</p>"]) if not bad else "<p>win at POKER now</p>"
        rows.append((i, f"http://{'shady.' if bad and rng.random() < 0.8 else ''}{host}/{rng.choice(['en', 'de', 'x'])}/{rng.choice(['one', 'two'])}", html))
    rows += [(i, u, h) for i, u, h in rows[:40]] + [(None, None, None)]
    got = urls.classify(_pages(spark, rows)).collect()
    # each label is one word: known from titles or not, it is not split
    tokens = lambda r: [f"h:{x}" for x in r.host.split(".")[:-1]] + [f"t:{r.host.split('.')[-1]}"] + [f"p:{w}" for w in r.path.split("/") if w] if r.host else ["t:"]
    html = {i: h for i, _, h in rows}
    seen, pages = {0: {}, 1: {}}, [0, 0]
    for r in got:
        if r.rule is None:
            label = int("POKER" in (html[r.page_id] or ""))
            pages[label] += 1
            for t in tokens(r):
                seen[label][t] = seen[label].get(t, 0) + 1
    kinds, sums = len(seen[0].keys() | seen[1].keys()), {k: sum(v.values()) for k, v in seen.items()}
    for r in got:
        weight = lambda t: math.log((seen[1].get(t, 0) + 1) / (sums[1] + kinds)) - math.log((seen[0].get(t, 0) + 1) / (sums[0] + kinds))
        assert abs(r.log_odds - math.log((pages[1] + 1) / (pages[0] + 1)) - sum(map(weight, tokens(r)))) < 1e-9
        assert r.verdict == {None: "block" if r.log_odds > 0 else "allow"}.get(r.rule, r.verdict)
    assert any(r.verdict == "block" and r.rule is None for r in got) and len(got) == len(rows)


def test_op10_contract(spark, tmp_path):
    rows = [(i, u, "<title>words</title>") for i, (u, *_) in enumerate(URLS)] + [(None, "http://example.com/en/7", None)] * 3
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op10_urls(spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.count() == len(rows)
    assert [tuple(r) for r in got.where("page_id IS NULL").collect()] == [(None, "example.com", "/en/7", "example.com/en/7", "allow")] * 3


def test_long_names_take_time_in_proportion():
    import time

    split = urls.Segmenter({"a" * k: 1 for k in range(1, 40)} | {"a" * 20_000: 1})
    began = time.perf_counter()
    assert "".join(split("a" * 20_000 + "b")) == "a" * 20_000 + "b"
    assert time.perf_counter() - began < 5


def test_segmentation():
    split = urls.Segmenter({"free": 50, "bets": 20, "the": 100, "there": 30, "in": 60, "rein": 5})
    assert split("freebets") == ["free", "bets"] and split("therein") == ["there", "in"] and "".join(split("qqfreezz")) == "qqfreezz"


def _targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark, docs, rows):
    rng = random.Random(4)
    more = [(1000 + i, " ".join("w" for _ in range(rng.choice([1, 5, 40]))), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", 0) for i in range(700)]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)).repartition(5)
    got = mixing.mix(df).collect()
    every = rows + more
    sizes = {}
    for r in every:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = _targets(sizes)
    assert len(got) == len(every)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.apply(df).count() == sum(r.copies for r in got if r.copies) and mixing.apply(df).columns == df.columns


def test_many_equal_rows(spark):
    """Equal rows are documents of their own, and their number does not slow the duels down."""
    same = spark.range(60_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    other = spark.range(100).selectExpr("id + 10 AS doc_id", "'a b c' AS text", "'en' AS lang", "'t' AS source", "5L AS n_chars")
    got = mixing.mix(same.unionByName(other)).where("source = 's'").agg(F.sum("taken"), F.max("target"), F.max("copies"), F.min("copies"), F.count("*")).first()
    assert abs(got[0] - got[1]) <= 3 and (got[2], got[3], got[4]) == (2, 1, 60_000)
    assert mixing.apply(same.unionByName(other)).where("source = 's'").count() * 3 == got[0]


def test_clashing_names_are_kept(spark):
    names = ["key", "copies", "_n", "_key", "_times", "_i", "n", "own", "_mix_key", "_mix_row"]
    df = spark.createDataFrame([(i, f"w {i % 5}", "ab"[i % 2]) for i in range(50)] * 2, "doc_id long, text string, source string")
    for name in names:
        df = df.selectExpr("*", f"concat('{name}', doc_id) AS `{name}`")
    got = mixing.apply(df).collect()
    assert mixing.apply(df).columns == df.columns and got and all(r[name] == f"{name}{r.doc_id}" for r in got for name in names)


def test_mixing_odd_tables(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], empty.schema)
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(nothing).collect())


def test_every_document_may_be_taken(spark):
    """The share of documents with an extra copy follows their probability, whatever their size."""
    rows = [(i, "w " * (1 + i % 7), "en", "ab"[i % 2], 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).where("source = 'b'").collect()
    rate = got[0].target / got[0].source_size
    for size in range(1, 8):
        own = [r.copies for r in got if r.size == size]
        assert abs(np.mean(own) - rate) < 0.3
