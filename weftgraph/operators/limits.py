"""Rate limits over an event log: allow or deny per event in event-time order, and usage per session.

Sessions of any size are handled: counts use a pruned top-k, totals and trailing windows use running sums that split
hot sessions, and the two rules with feedback fold over bounded blocks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import rules as R
from weftgraph.plans.scale import MAX_GROUP_ROWS, durable, ordered_fold, running_totals, top_rows

HOUR = 3_600_000_000


def with_micros(df: DataFrame, ts: str = "ts", out: str = "at") -> DataFrame:
    """Adds microseconds since 1970 of a timestamp without zone; no session zone involved."""
    return df.withColumn(out, F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"))


def _limit_of(resource: Column, limits: dict[str, int]) -> Column:
    return reduce(lambda acc, kv: F.when(resource == kv[0], F.lit(kv[1])).otherwise(acc), limits.items(), F.lit(None).cast("int"))


def limit_counts(events: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``events``: session_id, resource, ts, event_id. Denied events do not count, so the first ``limit`` pass.

    The passing rows come from a pruned top-k; the rest only look up the last passing row of their session.
    """
    limits = R.SESSION_LIMITS if limits is None else limits
    base = events.filter(F.col("resource").isin(*limits)).withColumn("limit", _limit_of(F.col("resource"), limits))
    key = ["session_id", "resource"]
    head = durable(top_rows(base, key, [F.col("ts"), F.col("event_id")], max(limits.values()), "rn").filter(F.col("rn") <= F.col("limit")), "passed")
    passed = head.select("*", F.lit(True).alias("allowed"), (F.col("rn") - 1).alias("current")).drop("rn")
    last = head.filter("rn = limit").select(*key, F.struct("ts", "event_id").alias("last"))
    denied = base.join(last, key).filter(F.struct("ts", "event_id") > F.col("last")).drop("last").select(
        *base.columns, F.lit(False).alias("allowed"), F.col("limit").alias("current"))
    return passed.unionByName(denied)


def trailing_counts(events: DataFrame, seconds: int = 3600, max_rows: int = MAX_GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """Events of the session in the trailing window, the event itself included; strict lower bound.

    Every event enters at its time and leaves ``seconds`` later: one running sum over both, no range window.
    """
    at = with_micros(events)
    enter = at.select("session_id", "at", F.lit(1).alias("kind"), "event_id", F.lit(1).alias("d"))
    leave = at.select("session_id", (F.col("at") + seconds * 1_000_000).alias("at"), F.lit(0).alias("kind"), "event_id", F.lit(-1).alias("d"))
    summed = running_totals(enter.unionAll(leave), ["session_id"], ["at", "kind", "event_id"], {"recent": F.col("d")}, max_rows, blocks)
    return summed.filter("kind = 1").select("session_id", "event_id", "at", "recent")


def limit_builds(events: DataFrame, limit: int = R.BUILDS_PER_HOUR, max_rows: int = MAX_GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """``events``: session_id, ts, event_id. Only recorded builds count, at most the last 100 are remembered."""
    recent = durable(trailing_counts(events, 3600, max_rows, blocks), "recent")
    busy = durable(
        recent.groupBy("session_id").agg(F.max("recent").alias("m")).filter((F.col("m") > limit) | (F.lit(limit) > R.REMEMBERED_BUILDS)), "busy")
    calm = recent.join(busy.select("session_id"), "session_id", "left_anti").select(
        "session_id", "event_id", "at", F.lit(True).alias("allowed"), (F.col("recent") - 1).cast("bigint").alias("current"))
    tight = recent.join(busy.select("session_id"), "session_id", "left_semi").select("session_id", "event_id", "at")
    memory = R.REMEMBERED_BUILDS

    def fold(rows: pd.DataFrame, state: list[int]):
        allowed, current = [], []
        for at in rows["at"].tolist():
            state = [t for t in state if t > at - HOUR]
            ok = len(state) < limit
            allowed.append(ok)
            current.append(len(state))
            if ok:
                state = (state + [at])[-memory:]
        return {"allowed": allowed, "current": current}, state

    added = [T.StructField("allowed", T.BooleanType()), T.StructField("current", T.LongType())]
    return calm.unionByName(ordered_fold(tight, ["session_id"], ["at", "event_id"], fold, [], added, max_rows, blocks))


def limit_tokens(events: DataFrame, limit: int = R.TOKENS_PER_SESSION, max_rows: int = MAX_GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """``events``: session_id, ts, event_id, tokens. Denied requests add nothing; a later smaller one may pass."""
    base = with_micros(events).select("session_id", "event_id", "at", F.col("tokens").cast("bigint").alias("tokens"))
    # few sessions go over: their known size lets Spark pick them by broadcast, without a shuffle of the log
    over = durable(base.groupBy("session_id").agg(F.sum("tokens").alias("t")).filter(F.col("t") > limit).select("session_id"), "over")
    within = running_totals(base.join(over, "session_id", "left_anti"), ["session_id"], ["at", "event_id"],
                            {"projected": F.col("tokens")}, max_rows, blocks)
    easy = within.select("session_id", "event_id", "at", "tokens", F.lit(True).alias("allowed"), "projected")

    def fold(rows: pd.DataFrame, state: list[int]):
        total, allowed, projected = state[0], [], []
        for asked in rows["tokens"].tolist():
            ok = total + asked <= limit
            allowed.append(ok)
            projected.append(total + asked)
            if ok:
                total += asked
        return {"allowed": allowed, "projected": projected}, [total]

    added = [T.StructField("allowed", T.BooleanType()), T.StructField("projected", T.LongType())]
    return easy.unionByName(ordered_fold(base.join(over, "session_id", "left_semi"), ["session_id"], ["at", "event_id"], fold, [0], added, max_rows, blocks))


def usage_summary(used: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``used``: session_id, resource, current -> every limited resource per session with what remains."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("resource"), F.lit(v).alias("limit")) for k, v in limits.items()])).alias("x")
    base = used.select("session_id").distinct().select("session_id", wanted).select("session_id", "x.resource", "x.limit")
    summed = used.groupBy("session_id", "resource").agg(F.sum("current").alias("current"))
    full = base.join(summed, ["session_id", "resource"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
    return full.withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("current")))


def counted_usage(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Counter values after the log: passing events per session and resource (no per-event work)."""
    n = events.filter(F.col("resource").isin(*limits)).groupBy("session_id", "resource").agg(F.count("*").alias("n"))
    return n.select("session_id", "resource", F.least("n", _limit_of(F.col("resource"), limits)).alias("current"))


def cost(usage: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """``usage``: session_id, model, tokens -> USD, default price for unknown models."""
    table = R.MODEL_PRICES if prices is None else prices
    price = reduce(lambda acc, kv: F.when(F.col("model") == kv[0], F.lit(kv[1])).otherwise(acc), table.items(), F.lit(R.DEFAULT_PRICE))
    total = usage.groupBy("session_id", "model").agg(F.sum("tokens").alias("tokens"))
    # scaled, then rounded: rounds the stored double, not its shortest decimal text
    usd = F.round(F.col("tokens") / 1_000_000 * price * 10_000) / 10_000
    return total.select("session_id", "model", "tokens", usd.alias("usd"))


def reset(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Events after the latest session start; ``starts``: session_id, ts. Sessions without a start keep everything."""
    last = starts.groupBy("session_id").agg(F.max("ts").alias("since"))
    return events.join(last, "session_id", "left").filter("since is null or ts >= since").drop("since")
