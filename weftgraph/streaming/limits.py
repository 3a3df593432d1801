"""Rate limits on a stream: one state per session with counters, token total and recent builds.

Micro-batches are decided as they arrive; inside one, a session's events are put in time order first. Its events of the micro-batch are held in one
task for that, so a micro-batch should be bounded (``maxFilesPerTrigger``); from batch to batch only the small state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.functions import rules as R
from weftgraph.operators.limits import HOUR

OUTPUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("resource", T.StringType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("current", T.LongType()), T.StructField("limit", T.LongType())])
STATE = T.StructType([
    T.StructField("names", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("tokens", T.LongType()), T.StructField("builds", T.ArrayType(T.LongType()))])


def limit_stream(events: DataFrame, limits: dict[str, int] | None = None, builds_per_hour: int = R.BUILDS_PER_HOUR,
                 token_limit: int = R.TOKENS_PER_SESSION, delay: str = "1 hour", idle: str = "2 hours") -> DataFrame:
    """``events``: session_id, event_id, ts (timestamp), resource, tokens. Resources are the counted ones, ``build``,
    ``tokens`` and ``session_start`` (which clears the session). After ``idle`` without events a session's
    build times go; its counts and tokens stay. The rows of a session in one micro-batch are decided in time order, however they are batched.
    """
    limits = dict(R.SESSION_LIMITS if limits is None else limits)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            names, values, total, _ = state.get
            state.update((list(names), list(values), total, []))
            return
        counts, total, builds = {}, 0, []
        if state.exists:
            names, values, total, builds = state.get
            counts, builds = dict(zip(names, values)), list(builds)
        newest = 0
        for pdf in [pd.concat(list(batches))]:
            pdf = pdf.sort_values(["at", "event_id"], kind="mergesort")
            rows = []
            for event_id, at, resource, asked in zip(pdf["event_id"], pdf["at"], pdf["resource"], pdf["tokens"]):
                newest = max(newest, int(at))
                if resource == "session_start":
                    counts, total, builds = {}, 0, []
                elif resource == "build":
                    builds = [t for t in builds if t > at - HOUR]
                    ok, current, limit = len(builds) < builds_per_hour, len(builds), builds_per_hour
                    builds = (builds + [int(at)])[-R.REMEMBERED_BUILDS:] if ok else builds
                    rows.append((event_id, resource, ok, current, limit))
                elif resource == "tokens":
                    projected = total + int(asked)
                    ok = projected <= token_limit
                    total = projected if ok else total
                    rows.append((event_id, resource, ok, projected, token_limit))
                elif resource in limits:
                    current, limit = counts.get(resource, 0), limits[resource]
                    ok = current < limit
                    counts[resource] = current + 1 if ok else current
                    rows.append((event_id, resource, ok, current, limit))
            if rows:
                out = pd.DataFrame(rows, columns=["event_id", "resource", "allowed", "current", "limit"])
                out.insert(0, "session_id", key[0])
                yield out
        state.update((list(counts), list(counts.values()), total, builds))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + idle_ms)

    timed = events.withWatermark("ts", delay).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("event_id").cast("bigint").alias("event_id"),
        F.unix_micros("ts").alias("at"), "ts", "resource", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"))
    return timed.groupBy("session_id").applyInPandasWithState(decide, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
