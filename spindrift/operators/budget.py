"""Checks before a model call: budgets, roles, capabilities, allowlists; and the model inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..verdicts import Refused, first_of

# Which tool serves a capability, the roles of a message, the gates of operations that write.
TOOL_FOR = {"decision": "decide", "embedding": "embed", "completion": "generate or chat"}
ROLES = ("system", "user", "assistant", "tool")
GATES = {"pull": "allow_pull", "delete": "allow_delete"}


def context_checks(texts: DataFrame, text: str, limit, *, allow_truncation: bool = False, headroom: float = 0.15) -> DataFrame:
    """Adds estimate, usable and verdict; limit is a column or a number, null where unknown."""
    limit = limit if not isinstance(limit, (int, type(None))) else F.lit(limit).cast("bigint")
    rows = texts.withColumn("estimate", T.tokens(F.length(F.coalesce(F.col(text), F.lit("")))))
    verdict, usable = T.context_check("estimate", limit, allow_truncation, headroom)
    return rows.withColumn("usable", usable).withColumn("verdict", verdict)


def oversized(texts: DataFrame, text: str, limit: int) -> DataFrame:
    """Inputs of an embedding call that are over the whole limit: adds estimate and chars."""
    rows = texts.withColumn("chars", F.length(text).cast("bigint")).withColumn("estimate", T.tokens(F.length(text)))
    return rows.where(F.col("estimate") > limit)


def conversation_checks(messages: DataFrame, limit: int | None, *, headroom: float = 0.15) -> DataFrame:
    """conv_id, turns, chars, estimate, usable, verdict: a conversation's budget is its whole history."""
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))
    rows = rows.withColumn("estimate", T.tokens(F.col("chars")))
    verdict, usable = T.context_check("estimate", F.lit(limit).cast("bigint"), False, headroom)
    return rows.withColumn("usable", usable).withColumn("verdict", verdict)


def role_checks(messages: DataFrame) -> DataFrame:
    """conv_id, bad_turn (the first with an unknown role or no text), verdict."""
    bad = ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) | F.col("text").isNull()
    rows = messages.groupBy("conv_id").agg(F.min(F.when(bad, F.col("turn"))).alias("bad_turn"))
    return rows.withColumn("verdict", F.when(F.col("bad_turn").isNull(), "ok").otherwise("invalid_request"))


def limits(models: DataFrame) -> DataFrame:
    """Adds arch, num_ctx, limit, disagree from models(model_info map, parameters)."""
    rows = models.withColumn("arch", T.architecture_limit("model_info")).withColumn("num_ctx", T.num_ctx("parameters"))
    return rows.withColumn("limit", T.context_limit("arch", "num_ctx")).withColumn("disagree", F.coalesce(F.col("arch") != F.col("num_ctx"), F.lit(False)))


def routed(calls: DataFrame) -> DataFrame:
    """Adds verdict and use_tool to calls(capabilities, needs): a list that was not read, or is empty, is no refusal."""
    served = F.filter("capabilities", lambda c: c.isin(*TOOL_FOR) & (c != F.col("needs")))
    refuse = (F.size("capabilities") > 0) & ~F.array_contains("capabilities", F.col("needs")) & (F.size(served) > 0)
    tools = F.create_map(*(F.lit(x) for kv in TOOL_FOR.items() for x in kv))
    refuse = F.coalesce(refuse, F.lit(False))
    return calls.withColumn("verdict", F.when(refuse, "wrong_capability").otherwise("ok")).withColumn("use_tool", F.when(refuse, F.try_element_at(tools, F.try_element_at(served, F.lit(1)))))


def guarded(calls: DataFrame, allowed: DataFrame | None = None, *, allow_pull: bool = False, allow_delete: bool = False) -> DataFrame:
    """Adds verdict to calls(op, model): write gates first, then blank names, then the allowlist, names with and without :latest alike."""
    rows = calls.withColumn("_base", T.base_name("model"))
    on_list = F.lit(True)
    if allowed is not None:
        names = allowed.select(T.base_name("model").alias("_base")).distinct().withColumn("_on", F.lit(True))
        rows, on_list = rows.join(names, "_base", "left"), F.col("_on").isNotNull()
    gates = [((F.col("op") == op) & F.lit(not flag), "not_permitted") for op, flag in (("delete", allow_delete), ("pull", allow_pull))]
    verdict = first_of(*gates, (F.col("model").isNotNull() & T.blank("model"), "invalid_request"), (F.col("model").isNotNull() & ~on_list, "not_permitted"))
    return rows.withColumn("verdict", verdict).select(*calls.columns, "verdict")


def inventory(models: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """name, size label, location, details_error of models(name, size), in order of lower(name); a failed detail stays a row."""
    rows = models
    if details is not None:
        rows = rows.join(details.select("name", F.col("error").alias("details_error"), F.lit(True).alias("_d")), "name", "left")
        rows = rows.withColumn("details_error", F.when(F.col("_d").isNull(), "not fetched").otherwise(F.col("details_error"))).drop("_d")
    else:
        rows = rows.withColumn("details_error", F.lit(None).cast("string"))
    return rows.select("name", T.human_size("size").alias("size_label"), T.location("name", "size").alias("location"), "details_error").orderBy(F.lower("name"), "name")


def inventory_summary(models: DataFrame) -> DataFrame:
    """One row: count, local_count, hosted (names, sorted), verdict; no models is not an empty success."""
    where = T.location("name", "size")
    got = models.agg(F.count("*").alias("models"), F.count_if(where == "local").alias("local_models"), F.array_join(F.array_sort(F.collect_list(F.when(where != "local", F.col("name")))), ",").alias("hosted"))
    return got.withColumn("verdict", F.when(F.col("models") == 0, "no_models_installed").otherwise("ok"))


def check_write(op: str, **flags: bool) -> None:
    if op in GATES and not flags.get(GATES[op]):
        raise Refused("not_permitted", f"{op} is disabled", f"start with {GATES[op]}=True")
