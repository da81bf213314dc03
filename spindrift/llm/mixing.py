"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents all have the same number of copies r = target / size of the source, at most 2. Its whole part is
given to every document. Its fraction is a probability for each document, and documents duel: of two, mass moves at
random from one to the other, weighted by their sizes, until one has a whole number of copies. What is left of the two
duels on. Sizes times copies keep their sum in every duel, so the words taken from a source miss its target by less
than one document.

Duels run along short arrays (about `GROUP` documents by hash), one fold an array; the one document that each array
leaves with a fraction goes to the next level, until one is left for a source: a tree of log(n) / log(GROUP) levels,
each much smaller than the one before. All random numbers are hashes of the document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
GROUP = 48
RUN = 4096  # equal rows that one array numbers
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and the hash of each row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
    )


def _told_apart(sizes: DataFrame) -> DataFrame:
    """Adds own: the key of a row, and for rows equal in id, source and text a key that their running number salts.

    Equal rows are counted first, in each task and then together, and dealt out again: no key holds more than one row.
    """
    counted = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("_n"))
    rows = _repeated(counted, "_n")
    return rows.select("doc_id", "source", "size", "key", F.when(F.col("_no") == 0, F.col("key")).otherwise(F.xxhash64("key", "_no")).alias("own"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row `times` times, with _no from 0; in two steps, so that no array is long."""
    rows = rows.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN).cast("long"))))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN), F.col(times) - F.col("_a") * RUN) - 1)))
    return rows.withColumn("_no", F.col("_a") * RUN + F.col("_b")).drop("_a", "_b")


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, docs, target. Sources by code point, null last, weigh `weights` in turn.

    One row a source is ranked in one task, so sources should number millions at most. They share `share` times all sizes by weight; a target stops at `most` times its source's size and the excess goes
    to the others by weight. A source is at its cap exactly if it is when every source gets the cap's ratio.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = sources.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    sources = sources.withColumn("_w", weight).withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    upto, all_of = W.orderBy("_ratio").rangeBetween(W.unboundedPreceding, 0), W.partitionBy()
    sources = sources.withColumns({"_t": F.lit(share) * F.sum("source_size").over(all_of), "_below": F.sum("_cap").over(upto), "_rest": F.sum("_w").over(all_of) - F.sum("_w").over(upto)})
    sources = sources.withColumn("_full", F.col("_below") + F.col("_ratio") * F.col("_rest") <= F.col("_t"))
    left = F.col("_t") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_of), F.lit(0.0))
    free = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_of)
    sources = sources.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(left * F.col("_w") / free))
    return sources.select("source", "source_size", "docs", "target")


def _let(value, body):
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _duel(state, item, level: int):
    """The state after its pivot meets the next item; one of the two is decided."""
    a, b = state["pivot"], item
    ratio = a["size"] / b["size"]
    up = F.least(1 - a["p"], b["p"] / ratio)
    down = F.least(a["p"], (1 - b["p"]) / ratio)
    chance = (F.xxhash64(a["own"], b["own"], F.lit(level)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")

    def moved(m):
        pa_, pb = a["p"] + m, b["p"] - m * ratio
        whole_a = (pa_ <= _EPS) | (pa_ >= 1 - _EPS)
        item_of = lambda x, p: F.struct(x["own"].alias("own"), x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"))
        new_a, new_b = item_of(a, pa_), item_of(b, pb)
        return F.struct(F.when(whole_a, new_b).otherwise(new_a).alias("pivot"), F.array_append(state["done"], F.when(whole_a, new_a).otherwise(new_b)).alias("done"))

    return _let(F.when(chance * (up + down) < down, up).otherwise(-down), moved)


def _round(items: DataFrame, level: int, groups) -> DataFrame:
    """One level: a row for each array, with the pivot that is left and the items that are decided."""
    item = F.struct("own", "key", "doc_id", F.col("size").cast("double").alias("size"), "p")
    grouped = items.groupBy("source", F.pmod(F.xxhash64("own", F.lit(level)), groups).alias("_g")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.filter(F.slice("items", 1, 1), lambda _: F.lit(False))
    start = F.struct(F.element_at("items", 1).alias("pivot"), empty.alias("done"))
    fold = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, lambda s, x: _duel(s, x, level))
    return grouped.select("source", fold.alias("f"))


def mix(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies, taken: one row per input row.

    A null text has size 0 and is never taken; a null source is a source of its own, last in order; null ids and
    repeated rows are documents like others, with random numbers of their own. An empty
    table gives an empty result. No document is taken more than `most` times.
    """
    sizes = materialise(_told_apart(sized(docs)))
    by_source = materialise(targets(sizes, weights=weights, share=share, most=most), 1)
    few = by_source.select(F.col("source").alias("_s"), "source_size", "target", "docs")
    rows = sizes.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_r", F.least(rate, F.lit(float(most)))).withColumn("_base", F.floor(F.col("_r") + _EPS).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("_r") - F.col("_base"), F.lit(0.0))).otherwise(F.lit(0.0)))
    open_ = F.col("p") > _EPS
    plain = rows.where(~open_).select("doc_id", "source", "key", "size", F.lit(0).cast("long").alias("extra"))  # own is of use in duels only

    done = [plain]
    items = rows.where(open_).select("source", "own", "key", "doc_id", "size", "p", "docs")
    left, level = by_source.agg(F.max("docs")).first()[0] or 0, 0
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(float(GROUP ** (level + 1))))).cast("long")
        folded = materialise(_round(items, level, groups))
        one = folded.select("source", F.explode("f.done").alias("x"))
        done.append(one.select("x.doc_id", "source", "x.key", F.col("x.size").cast("long").alias("size"), F.when(F.col("x.p") > 0.5, 1).otherwise(0).cast("long").alias("extra")))
        pivots = folded.select("source", "f.pivot.*")
        if left <= GROUP ** (level + 1):
            break
        items = pivots.join(by_source.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        level += 1
    chance = F.xxhash64("own", F.lit(-1)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    done.append(pivots.select("doc_id", "source", "key", F.col("size").cast("long").alias("size"), F.when(chance < F.col("p"), 1).otherwise(0).cast("long").alias("extra")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = every.join(few.withColumn("_r", F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(most)))), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("_r") + _EPS).cast("long") + F.col("extra")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("copies", copies).select("doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it is taken, with all their columns whatever their names.

    Rows equal in id, source and text share their copies: each gets the whole part of its share, and the rest goes one
    each to the first of them by a hash of all columns. Nulls, empty texts and empty tables are as in mix.
    """
    names = docs.columns
    mixed = mix(docs, **options).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    mixed = mixed.where("copies > 0").select(F.col("key").alias("_mix_key"), F.floor(F.col("copies") / F.col("n")).cast("int").alias("_mix_each"), (F.col("copies") % F.col("n")).alias("_mix_rest"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_mix_row"), F.xxhash64("doc_id", "source", "text").alias("_mix_key"))
    rows = rows.join(mixed, "_mix_key")
    each = rows.where("_mix_each > 0").select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_each"))))
    # Fully equal rows are one row with a number; their rests are given out along the numbers of a key, not of its rows.
    some = rows.where("_mix_rest > 0").withColumn("_mix_hash", F.xxhash64(*(F.col(f"_mix_row.`{c}`") for c in names)))
    alike = some.groupBy("_mix_key", "_mix_hash", "_mix_rest").agg(F.count("*").alias("_mix_n"), F.first("_mix_row").alias("_mix_row"))
    before = F.coalesce(F.sum("_mix_n").over(W.partitionBy("_mix_key").orderBy("_mix_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = alike.withColumn("_mix_extra", F.least(F.col("_mix_rest") - before, F.col("_mix_n")).cast("long")).where("_mix_extra > 0")
    extra = _repeated(extra, "_mix_extra").select("_mix_row", F.lit(1).alias("col"))
    return each.unionByName(extra).select(*(F.col(f"_mix_row.`{c}`").alias(c) for c in names))


def op9_mixing(spark, sf_dir):
    """doc_id, size, source_size, target, taken (and source, copies) of every document; see mix for nulls and repeats.

    Null texts have size 0 and are never taken, a null source is the last source, equal rows are documents of their own,
    a text of any length counts whole, and an empty table gives an empty result.
    """
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
