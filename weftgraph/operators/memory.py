"""Conversation turns: tails, context windows, summaries. Turns: conv_id, turn, role, text, intent, plan_title, has_plan, pr_count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scale import top_rows


def last_turns(turns: DataFrame, n: int = 6, preview: int = 200) -> DataFrame:
    tail = top_rows(turns, ["conv_id"], [F.desc("turn")], n, "back")
    cut = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    return tail.select("conv_id", "turn", "back", "role", cut.alias("preview"))


def last_where(turns: DataFrame, present: Column, value: str) -> DataFrame:
    """Latest turn per conversation that carries a key (a plan, PR results)."""
    return turns.filter(present).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(value, "turn").alias(value))


def context_window(turns: DataFrame, pinned: Column, n: int = 12) -> DataFrame:
    """Last n turns; when no pinned turn is among them, the latest pinned one comes first."""
    marked = turns.withColumn("_pin", pinned)
    recent = top_rows(marked, ["conv_id"], [F.desc("turn")], n, "_back")
    start = recent.groupBy("conv_id").agg(F.min("turn").alias("_start"), F.bool_or("_pin").alias("_has"))
    pin = marked.filter("_pin").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    lost = pin.join(start.filter("not _has"), "conv_id").filter("turn < _start").select("conv_id", "turn")
    extra = marked.join(lost, ["conv_id", "turn"], "left_semi").drop("_pin")
    return recent.drop("_pin", "_back").unionByName(extra)


def to_messages(turns: DataFrame, pinned: Column, n: int = 12) -> DataFrame:
    """Context window as ordered (position, message_type, content) rows."""
    w = Window.partitionBy("conv_id").orderBy("turn")  # at most n + 1 rows each
    kind = F.when(F.col("role") == "user", F.lit("human")).otherwise(F.lit("ai"))
    return context_window(turns, pinned, n).select(
        "conv_id", F.row_number().over(w).alias("position"), kind.alias("message_type"), F.col("text").alias("content"))


def history_summary(turns: DataFrame) -> DataFrame:
    """A short state line per conversation: turn count, then latest plan, PR count, or the last three intents."""
    base = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("has_plan"), F.struct("turn", F.coalesce("plan_title", F.lit("")).alias("title")))).alias("plan"),
        F.max(F.when(F.col("pr_count").isNotNull(), F.struct("turn", "pr_count"))).alias("pr"))
    last3 = top_rows(turns, ["conv_id"], [F.desc("turn")], 3, "back").filter("intent is not null and intent <> ''")
    recent = last3.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "intent"))).alias("r"))
    names = F.array_join(F.transform("r", lambda x: x["intent"]), ", ")
    plan = F.when(F.col("plan.title") != "", F.concat(F.lit('Most recent plan: "'), F.col("plan.title"), F.lit('".'))).otherwise(
        F.lit("An implementation plan was generated."))
    part = (
        F.when(F.col("plan").isNotNull(), plan)
        .when(F.coalesce(F.col("pr.pr_count"), F.lit(0)) > 0, F.concat(F.lit("PRs were created: "), F.col("pr.pr_count"), F.lit(" result(s).")))
        .when(F.size("r") > 0, F.concat(F.lit("Recent activity: "), names, F.lit(".")))
    )
    return base.join(recent, "conv_id", "left").select(
        "conv_id", F.concat_ws(" ", F.concat(F.lit("Conversation has "), "n", F.lit(" turns so far.")), part).alias("summary"))


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"))


def append_turns(history: DataFrame, new: DataFrame) -> DataFrame:
    """New turns numbered after the last stored one; ``new`` carries conv_id, seq and the other turn columns."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    numbered = new.join(last, "conv_id", "left").withColumn("turn", F.coalesce("_last", F.lit(-1)) + 1 + F.col("seq")).drop("_last", "seq")
    return history.unionByName(numbered, allowMissingColumns=True)


def clear_conversation(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    return turns.join(conv_ids.select("conv_id").distinct(), "conv_id", "left_anti")
