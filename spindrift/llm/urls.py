"""URL filters: rules first, and for the rest a classifier over the words of host and path.

Host names are segmented by a unigram Viterbi whose word counts come from all page titles. A multinomial naive Bayes
over the words of host and path is trained on the pages that no rule fits, as those of ruled places would teach it the
rules' own hosts and paths. What a page is an example of is told by its html and its segmented host: a seed word there
makes it an example of block, and any other page is one of allow. So words of hosts and paths that go with such content
get weight, whether or not they are on a list. Both models stay tables of any size: rows
are dealt to groups, and each group gets the word counts, split hosts and token weights that its own rows need, each at
most once a group.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts_of, table, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SEEDS = ("adult", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "sex", "slots", "viagra", "xxx")
MAX_RULES = 10_000
STEM = 24  # longer words of titles are found by their first so many letters, and then held against the name itself


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty where url is null or has no "://"."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return pages.withColumn("host", F.translate(raw, UPPER, LOWER)).withColumn("path", path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of pages(host, path): the longest rule that fits, else null.

    rules: (verdict, host, path prefix). A rule fits its host and all subdomains. At most MAX_RULES, as they are part of
    the plan; of rules equal in host and path the last one counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    by_host: dict[str, dict[str, str]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, {})[path] = verdict
    entries = []
    for host, paths in by_host.items():
        entries += [F.lit(host), F.array(*(F.struct(F.lit(len(host) + len(p)).alias("n"), F.lit(host + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for p, v in paths.items()))]
    known = F.create_map(*entries)
    deepest = max(h.count(".") + 1 for h in by_host)  # only as many labels as some rule's host has
    hosts = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, deepest + 1))))
    fits = F.filter(F.flatten(F.filter(F.transform(hosts, lambda h: F.try_element_at(known, h)), lambda x: x.isNotNull())), lambda r: F.startswith(F.col("path"), r["path"]))
    return pages.withColumn("_r", F.array_max(fits)).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.verdict")}).drop("_r")


class Segmenter:
    """Most likely split of a name into words; unknown stretches cost by their length.

    All words that occur in a name are found in one pass over it by an Aho-Corasick automaton.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        import ahocorasick

        total = total or sum(counts.values()) or 1
        self.found = ahocorasick.Automaton()
        for w, n in counts.items():
            self.found.add_word(w, (len(w), -math.log(n / total)))
        self.found.make_automaton()
        self.empty = not len(self.found)
        self.unknown = math.log(total) + 2
        self.held: dict[str, list[str]] = {}

    def __call__(self, name: str) -> list[str]:
        if (got := self.held.get(name)) is not None:
            return got
        ending: dict[int, list[tuple[int, float]]] = {}
        for last, word in [] if self.empty else self.found.iter(name):
            ending.setdefault(last + 1, []).append(word)
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        opened, since = math.inf, 0  # an unknown stretch that is still open, and where it began
        for end in range(1, len(name) + 1):
            begin = best[end - 1] + self.unknown
            if begin < opened:
                opened, since = begin, end - 1
            opened += 2.5
            best[end], back[end] = opened, since
            for size, price in sorted(ending.get(end, ()), reverse=True):  # of equal costs the longest word
                cost = best[end - size] + price
                if cost < best[end]:
                    best[end], back[end] = cost, end - size
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if len(self.held) > 200_000:
            self.held.clear()
        self.held[name] = words = words[::-1]
        return words


def parts(host: str) -> list[str]:
    """Runs of letters of the host's labels but the last."""
    return [part for label in host.split(":")[0].split(".")[:-1] for part in re.findall(r"[^\W\d_]+", label)]


def host_tokens(host: str, split: Segmenter) -> list[str]:
    """Words of the host's labels; the kind of place is part of a token."""
    return [f"h:{w}" for part in parts(host) for w in split(part)] + [f"t:{host.split(':')[0].split('.')[-1]}"]


def path_tokens(path: str) -> list[str]:
    return [f"p:{w}" for w in re.findall(r"[a-z]+", path.lower())]


def title():
    """The lower-case title of a page's html; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)<title[^>]*>([^<]*)", 1), UPPER, LOWER)


def title_words(pages: DataFrame) -> DataFrame:
    """word, n: counts of all words of two letters or more, of any length, of all titles."""
    words = pages.select(F.explode(F.regexp_extract_all(title(), F.lit(r"([\p{L}]{2,})"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def split_hosts(hosts: DataFrame, words: DataFrame, total: int, groups: int) -> DataFrame:
    """host, tokens of distinct hosts; a group of hosts gets the counts of those words(word, n) that occur in them."""
    hosts = hosts.withColumn("g", F.pmod(F.xxhash64("host"), F.lit(groups)))

    def occurring(batches):
        for batch in batches:
            found = set()
            for g, host in zip(batch.column("g").to_pylist(), batch.column("host").to_pylist(), strict=True):
                for p in set(parts(host)):
                    found.update((g, p[i:j]) for i in range(len(p)) for j in range(i + 1, min(len(p), i + STEM) + 1))
            found = list(found)
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found[at : at + 100_000]], t) for k, t in enumerate((pa.int64(), pa.string()))], ["g", "stem"])

    def split(_key, left, right):
        segment = Segmenter(dict(zip(right.column("word").to_pylist(), right.column("n").to_pylist(), strict=True)), total)
        own = left.column("host").to_pylist()
        return pa.table({"host": pa.array(own, pa.string()), "tokens": pa.array([host_tokens(h, segment) for h in own], pa.list_(pa.string()))})

    stems = words.withColumn("stem", F.substring("word", 1, STEM))
    needed = hosts.mapInArrow(occurring, "g long, stem string").distinct().join(stems, "stem").select(F.col("g").alias("of"), "word", "n")
    return hosts.groupBy("g").cogroup(needed.groupBy("of")).applyInArrow(split, "host string, tokens array<string>")


def classify(pages: DataFrame, *, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, log_odds, verdict for each row of pages(page_id, url, html), repeated rows included.

    verdict is the rule's where one fits, else block if the classifier's log odds are above 0. An empty host has no
    evidence but the classes' shares; a null url has an empty host and path, a null html no title, a null page_id stays
    null. Names, paths and titles of any length are used whole, without a cap on words or tokens. Further columns are
    ignored and may have any names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    tune(spark)
    groups = parts_of(pages)
    words = materialise(title_words(pages))
    floor = (words.agg(F.max("n")).first()[0] or 1) // 100 + 1
    seeded = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in (*seeds, "free", "online", "best")))).alias("word"), F.lit(floor).cast("long").alias("n"))
    words = words.unionByName(seeded).groupBy("word").agg(F.max("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0]
    bad = frozenset(f"h:{s}" for s in seeds)
    said = F.coalesce(F.col("html").cast("string"), F.lit(""))
    told = said.rlike(rf"(?i)(?<![\p{{L}}])(?:{'|'.join(map(re.escape, seeds))})(?![\p{{L}}])") if seeds else F.lit(False)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", told.alias("seeded"))
    rows = ruled(parsed(rows), rules).select("page_id", "host", "path", "rule", "rule_verdict", "seeded")
    # equal rows are dealt by their partition too; written, so that a row keeps its group
    rows = materialise(rows.withColumn("g", F.pmod(F.xxhash64("page_id", "host", "path", F.spark_partition_id()), F.lit(groups))))
    hosts = materialise(rows.select("g", "host").distinct())
    split = materialise(split_hosts(hosts.select("host").distinct(), words, total, groups))

    def tokenised(_key, left, right):
        of = dict(zip(right.column("host").to_pylist(), right.column("tokens").to_pylist(), strict=True))
        got = [of[h] + path_tokens(p) for h, p in zip(left.column("host").to_pylist(), left.column("path").to_pylist(), strict=True)]
        return left.append_column("tokens", pa.array(got, pa.list_(pa.string())))

    schema = "page_id long, host string, path string, rule string, rule_verdict string, seeded boolean, g long"
    rows = materialise(rows.groupBy("g").cogroup(hosts.join(split, "host").groupBy("g")).applyInArrow(tokenised, f"{schema}, tokens array<string>"))

    def counted(batches):
        seen = Counter()
        for batch in batches:
            for got, verdict, seeded in zip(*(batch.column(c).to_pylist() for c in ("tokens", "rule_verdict", "seeded")), strict=True):
                if verdict is None:
                    block = int(seeded or not bad.isdisjoint(got))
                    seen[("", block)] += 1
                    seen.update((t, block) for t in got)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["token", "block", "n"])

    counts = rows.select("tokens", "rule_verdict", "seeded").mapInArrow(counted, "token string, block long, n long").groupBy("token").agg(F.sum(F.when(F.col("block") == 0, F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("block") == 1, F.col("n")).otherwise(0)).alias("bad"))
    counts = materialise(counts)
    whole = counts.where("token != ''").agg(F.count("*"), F.sum("ok"), F.sum("bad")).first()
    prior = counts.where("token = ''").first()
    kinds, ok_all, bad_all = (whole[0] or 1), (whole[1] or 0), (whole[2] or 0)
    base = math.log(((prior["bad"] if prior else 0) + 1) / ((prior["ok"] if prior else 0) + 1))

    def scored(_key, left, right):
        weights = {t: math.log((n + 1) / (bad_all + kinds)) - math.log((m + 1) / (ok_all + kinds)) for t, m, n in zip(*(right.column(c).to_pylist() for c in ("token", "ok", "bad")), strict=True)}
        unseen = math.log((ok_all + kinds) / (bad_all + kinds))  # of a word that only ruled pages have
        odds = [base + sum(weights.get(t, unseen) for t in got) for got in left.column("tokens").to_pylist()]
        verdict = [r or ("block" if x > 0 else "allow") for r, x in zip(left.column("rule_verdict").to_pylist(), odds, strict=True)]
        return left.select(["page_id", "host", "path", "rule"]).append_column("log_odds", pa.array(odds, pa.float64())).append_column("verdict", pa.array(verdict, pa.string()))

    needed = rows.select("g", F.explode("tokens").alias("token")).distinct().join(counts, "token").select(F.col("g").alias("of"), "token", "ok", "bad")
    return rows.groupBy("g").cogroup(needed.groupBy("of")).applyInArrow(scored, "page_id long, host string, path string, rule string, log_odds double, verdict string")


def op10_urls(spark, sf_dir):
    """page_id, host, path, rule, verdict of every page; see classify for nulls, repeats, long and empty values."""
    return classify(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
