"""Second-stage ranking from a model's replies: batches, parsing, merging, and how far to trust it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.models import completed
from ..verdicts import Refused
from .search import DEFAULT_K, DEFAULT_POOL, K_MOST, POOL_MOST, WEAK_SPREAD, check_range, check_size, scored, top

BATCH = 5
TOP = 2  # of the scale that is asked for
# How replies name a passage and its score, one to a line or as JSON pairs.
LINE = r"(?m)^\s*\[?(\d+)\]?\s*[=:]\s*(-?\d+(?:\.\d+)?)\s*$"
PAIR = r'"?(\d+)"?\s*:\s*(-?\d+(?:\.\d+)?)'
SCALES = {
    "plain": "Grade by what a reader who has nothing but the passage could answer: 2 for the whole answer, 1 for some of it, 0 for none, even where the topic fits.",
    "strict": "Grade with reserve. Give 2 only where the passage itself states the answer. Give 1 where it holds a fact that the answer needs. Everything else is 0, and a batch of zeros is a good grade.",
}


def batches(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds batch and local to candidates(pos, ...): groups of five by position, whatever the partitions are."""
    return candidates.withColumn("batch", F.floor(F.col("pos") / BATCH).cast("bigint")).withColumn("local", F.pmod(F.col("pos"), F.lit(BATCH)).cast("bigint"))


def prompts(candidates: DataFrame, question: str, rubric: str = "plain", by: tuple[str, ...] = ()) -> DataFrame:
    """batch, size, prompt from candidates(pos, file, text)."""
    item = F.concat(F.lit("["), F.col("local").cast("string"), F.lit("] ("), F.col("file"), F.lit(")\n"), T.collapsed("text"))
    rows = batches(candidates).groupBy(*by, "batch").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("local", item.alias("t")))).alias("items"))
    listing = F.array_join(F.transform("items", lambda x: x["t"]), "\n\n")
    n = F.col("size").cast("string")
    prompt = F.concat(F.lit(f"You grade search results.\nA reader asks: {question}\n{SCALES[rubric]}\nPassages, each under its number and file:\n\n"), listing, F.lit("\n\nWrite "), n, F.lit(" grades, each on a line of its own as number=grade. Add no other text."))
    return rows.select(*by, "batch", "size", prompt.alias("prompt"))


def parsed(replies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pos, score of replies(batch, size, reply): lines first, pairs if there are none.

    Indices outside the batch are dropped; of repeated ones the last counts.
    """

    def found(pattern):
        k, v = (F.regexp_extract_all(F.coalesce("reply", F.lit("")), F.lit(pattern), F.lit(g)) for g in (1, 2))
        return F.arrays_zip(k.alias("k"), v.alias("v"))

    rows = replies.withColumn("_lines", found(LINE)).withColumn("_pairs", found(PAIR))
    rows = rows.select(*by, "batch", "size", F.posexplode(F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(F.col("_pairs"))).alias("_at", "_p"))
    rows = rows.select(*by, "batch", "size", "_at", F.col("_p.k").try_cast("bigint").alias("local"), F.col("_p.v").cast("double").alias("score"))
    rows = rows.where((F.col("local") >= 0) & (F.col("local") < F.col("size")))
    rows = rows.groupBy(*by, "batch", "local").agg(F.max_by("score", "_at").alias("score"))
    return rows.select(*by, (F.col("batch") * BATCH + F.col("local")).alias("pos"), "score")


def failures(replies: DataFrame, scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """batch, failure of replies(batch, size, reply, error) that gave no score; the other batches still count."""
    good = scores.select(*by, F.floor(F.col("pos") / BATCH).cast("bigint").alias("batch")).distinct()
    why = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.concat(F.lit("unparseable ("), F.coalesce(F.nullif(F.substring(T.collapsed(F.coalesce("reply", F.lit(""))), 1, 120), F.lit("")), F.lit("(empty)")), F.lit(")")))
    return replies.join(good, [*by, "batch"], "left_anti").select(*by, "batch", why.alias("failure"))


def ordered(candidates: DataFrame, scores: DataFrame, keep: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds score and place to candidates(pos, cosine, ...), the first `keep` by score, cosine and position.

    What was not judged has a null score and comes after every judged one of 0 or more; it is not rejected.
    """
    rows = candidates.join(scores, [*by, "pos"], "left")
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), F.desc("cosine"), "pos")).cast("bigint")
    return rows.withColumn("place", place).where(F.col("place") <= keep)


def distribution(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """score, label (as %g writes it), n over the whole pool."""
    return scores.groupBy(*by, "score").agg(F.count("*").alias("n")).select(*by, "score", T.general("score").alias("label"), "n")


def flags(scores: DataFrame, returned: DataFrame, pool: int) -> DataFrame:
    """One row of diagnostics: judged, of_pool, scale, weak_discrimination, own_scale, pool_may_be_short, next_pool, none_answers."""
    spent = distribution(scores)
    all_ = spent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("judged"), F.min("score").alias("low"), F.max("score").alias("high"), F.max_by("n", "score").alias("at_top"))
    best = returned.agg(F.max("score").alias("best"))
    row = all_.join(F.broadcast(best))
    short = (F.col("high") <= TOP) & (F.col("best") > 0) & (F.col("best") < TOP) & F.lit(pool < POOL_MOST)
    return row.select(
        "judged", F.lit(pool).cast("bigint").alias("of_pool"), "low", "high", F.coalesce(F.col("at_top") > F.col("judged") / 2, F.lit(False)).alias("weak_discrimination"),
        F.coalesce((F.col("high") > TOP) | (F.col("low") < 0), F.lit(False)).alias("own_scale"), F.coalesce(short, F.lit(False)).alias("pool_may_be_short"),
        F.lit(min(2 * pool, POOL_MOST)).cast("bigint").alias("next_pool"), F.coalesce(F.col("best") == 0, F.lit(False)).alias("none_answers"),
    )


def label(score: str, high: str):
    """What a score says; on a scale of the model's own, or between the steps, the raw score."""
    s = F.col(score)
    named = F.when(s == 2, "ANSWERS").when(s == 1, "partial").when(s == 0, "topic only").otherwise(F.format_string("%.1f", s))
    return F.when(s.isNull(), "not judged").when(F.col(high) > TOP, F.format_string("%.1f", s)).otherwise(named)


def throughput(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tokens, seconds, prompt tokens, tokens a second and cold load over calls(eval_count, eval_duration, prompt_eval_count, load_duration)."""
    got = calls.groupBy(*by).agg(F.sum("eval_count").cast("bigint").alias("tokens"), F.sum("eval_duration").cast("bigint").alias("_ns"), F.sum("prompt_eval_count").cast("bigint").alias("prompt_tokens"), F.max("load_duration").cast("bigint").alias("_load"))
    return got.select(*by, "tokens", "prompt_tokens", T.tokens_per_second("tokens", "_ns").alias("tokens_per_second"), T.cold_load_seconds("_load").alias("cold_load_seconds"))


def reranked(chunks: DataFrame, query: list[float], question: str, call, *, k: int = DEFAULT_K, pool: int = DEFAULT_POOL, rubric: str = "plain") -> dict[str, DataFrame]:
    """A search with its second stage: rows (the k best, with score, label and place), flags, failures and replies.

    chunks: (ordinal, file, text, vector, ...); call: messages -> completion. The nearest `pool` chunks, k at least, are
    judged in batches; a batch that fails costs its own scores only, and rows that were not judged say so. With no score
    at all, rows stand in the order of their cosines. The pool is at most POOL_MOST rows, which the driver may hold.
    """
    check_range("k", k, K_MOST)
    check_range("pool", pool, POOL_MOST)
    check_size(chunks, query)
    if not question.strip():
        raise Refused("invalid_request", "the question is empty", "pass what is asked")
    spark = chunks.sparkSession
    best = top(scored(chunks, query), max(pool, k)).drop("vector", "norm").withColumn("pos", F.col("rank") - 1)
    best = spark.createDataFrame(best.collect(), best.schema)  # at most POOL_MOST rows: each is scored and judged once
    replies = completed(prompts(best, question, rubric), call)
    replies = replies.withColumn("reply", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.col("thinking"))).select("batch", "size", "reply", "error", "eval_count", "eval_duration", "prompt_eval_count", "load_duration")
    replies = spark.createDataFrame(replies.collect(), replies.schema)
    scores = parsed(replies)
    rows = ordered(best, scores, k)
    high = F.max("score").over(W.partitionBy())
    spread = F.lit((lambda c: max(c) - min(c) if c else None)([r.cosine for r in best.orderBy("rank").limit(k).collect()])).cast("double")
    rows = rows.withColumn("high", high).withColumn("label", label("score", "high")).withColumn("spread", spread).withColumn("weak_ranking", F.col("spread") < WEAK_SPREAD).drop("high", "text", "pos")
    return {"rows": rows.orderBy("place"), "flags": flags(scores, ordered(best, scores, k), max(pool, k)), "failures": failures(replies, scores), "replies": replies}
