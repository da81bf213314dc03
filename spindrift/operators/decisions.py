"""Typed decisions held against the questions that were asked, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TYPES = ("choice", "noul", "score")
SLACK = 0.02


def question_problems(questions: DataFrame) -> DataFrame:
    """item, problem: the first thing wrong with the questions(item, qid, pos, type, instructions, labels, levels) of an item, or null."""
    problem = (
        F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), F.concat(F.col("qid"), F.lit(": unknown type")))
        .when(T.blank("instructions"), F.concat(F.col("qid"), F.lit(": no instructions")))
        .when((F.col("type") == "choice") & (F.coalesce(F.size("labels"), F.lit(0)) < 2), F.concat(F.col("qid"), F.lit(": fewer than two labels")))
        .when((F.col("type") == "score") & (F.coalesce(F.size("levels"), F.lit(0)) < 2), F.concat(F.col("qid"), F.lit(": fewer than two levels")))
    )
    rows = questions.withColumn("_p", problem)
    return rows.groupBy("item").agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.struct("pos", "_p"))).alias("problem"))


def _distribution(probabilities, keys, tell) -> list:
    values = F.map_values(probabilities)
    inside = F.forall(values, lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False)))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return [
        F.when(probabilities.isNull(), tell("no probabilities")),
        F.when(F.array_sort(F.map_keys(probabilities)) != F.array_sort(keys), tell("probabilities cover other options")),
        F.when(~inside, tell("probability outside 0..1")).when(F.abs(total - 1) > SLACK, tell("probabilities do not sum to 1")),
    ]


def answer_problems(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """item, qid, problems (array): everything about answers(item, qid, type, choice, noul, score, probabilities) that does not fit.

    An answer without a type is accepted as the type that was asked for.
    """
    a = answers.select("item", "qid", F.col("type").alias("a_type"), "choice", "noul", "score", "probabilities", F.lit(True).alias("_there"))
    rows = questions.select("item", "qid", "type", "labels", "levels").join(a, ["item", "qid"], "left")
    tell = lambda what: F.concat(F.col("qid"), F.lit(f": {what}"))
    probabilities, n = F.col("probabilities"), F.size(F.coalesce("levels", F.array().cast("array<string>")))
    steps = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: i < n), lambda i: i.cast("string"))
    in_range = lambda x, high: F.coalesce((x >= 0) & (x <= high), F.lit(False))
    choice = F.array(F.when(~F.coalesce(F.array_contains("labels", F.col("choice")), F.lit(False)), tell("choice was not offered")), *_distribution(probabilities, F.col("labels"), tell))
    noul = F.array(F.when(~in_range(F.col("noul"), 1.0), tell("noul is not a probability")))
    score_ = F.array(F.when(~in_range(F.col("score"), n - 1), tell("score outside the levels")), *(F.when(probabilities.isNotNull(), p) for p in _distribution(probabilities, steps, tell)))
    all_ = F.when(F.col("_there").isNull(), F.array(F.concat(F.lit("no answer for "), F.col("qid")))).when(F.col("a_type").isNotNull() & (F.col("a_type") != F.col("type")), F.array(tell("answered as another type")))
    all_ = all_.when(F.col("type") == "choice", choice).when(F.col("type") == "noul", noul).otherwise(score_)
    return rows.select("item", "qid", F.filter(all_, lambda p: p.isNotNull()).alias("problems"))


def verdicts(problems: DataFrame) -> DataFrame:
    """item, n_problems, verdict: only missing answers are incomplete, a wrong one is a bad response."""
    missing = F.aggregate("problems", F.lit(True), lambda s, p: s & F.startswith(p, F.lit("no answer")))
    rows = problems.groupBy("item").agg(F.sum(F.size("problems")).cast("bigint").alias("n_problems"), F.bool_and(missing).alias("_m"))
    return rows.select("item", "n_problems", F.when(F.col("n_problems") == 0, "ok").when(F.col("_m"), "incomplete").otherwise("bad_response").alias("verdict"))


def missing_endpoint(calls: DataFrame) -> DataFrame:
    """Adds verdict to calls(version, capabilities) that got a 404: the endpoint's fault or the model's."""
    known = F.col("capabilities").isNotNull()
    return calls.withColumn("verdict", F.when((T.supports_decide("version") == "no") | known, "endpoint_unavailable").otherwise("model_not_found"))


def evaluation(decided: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row over decided(expected, got, confidence): accuracy, unlabelled, mean confidence right and wrong, accuracy of what is kept."""
    right, known = F.col("expected") == F.col("got"), F.col("expected").isNotNull()
    kept = known & (F.col("confidence") >= threshold)
    return decided.agg(
        F.count_if(known).alias("labelled"), F.count_if(~known).alias("unlabelled"), F.count_if(right).alias("correct"),
        F.round(F.avg(F.when(known, right.cast("double"))), 6).alias("accuracy"), F.round(F.avg(F.when(right, F.col("confidence"))), 6).alias("confidence_right"),
        F.round(F.avg(F.when(known & ~right, F.col("confidence"))), 6).alias("confidence_wrong"), F.count_if(kept).alias("kept"), F.round(F.avg(F.when(kept, right.cast("double"))), 6).alias("kept_accuracy"),
    )
