"""Query risk rules, guarding with an optional classifier, and rule-based intents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import rules as R
from weftgraph.functions.scalar import first_hit, strip_ws
from weftgraph.operators.audit import audit_event, events_of

_VERDICT = "struct<verdict:string,risk_category:string,reasoning:string,sanitized_query:string>"


def _verdict(verdict: str, category: Column | str | None, reasoning: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(verdict).alias("verdict"), as_col(category).cast("string").alias("risk_category"),
                    as_col(reasoning).alias("reasoning"), F.lit(None).cast("string").alias("sanitized_query"))


def has_risk_phrase(query: Column) -> Column:
    return F.lower(query).rlike("|".join(p.replace(".", "[.]") for p, _, _ in R.RISK_PHRASES))


def quick_risk(query: Column) -> Column:
    """Verdict struct of the first phrase found, NULL when no phrase is found.

    One alternation settles the common case of no hit; only hits look for the first phrase in rule order.
    """
    low = F.lower(query)
    index = F.when(has_risk_phrase(query), first_hit([(low.contains(p), F.lit(i)) for i, (p, _, _) in enumerate(R.RISK_PHRASES)]))
    verdicts = F.array(*[_verdict("blocked", c, f"{why}: '{p}'") for p, c, why in R.RISK_PHRASES])
    return F.get(verdicts, index)


# classify_fn takes a batch of texts and returns (verdict, category, reasoning, sanitized) per text
Classifier = Callable[[Sequence[str]], Sequence[tuple]]


def guard(queries: DataFrame, query: str = "query", enabled: bool = True, classify_fn: Classifier | None = None) -> DataFrame:
    """Adds verdict, risk_category, reasoning, sanitized_query. Only texts without a phrase reach the classifier."""
    if not enabled:
        return queries.withColumn("v", _verdict("safe", None, "IntentGuard is disabled")).select("*", "v.*").drop("v")
    if classify_fn is None:
        safe = _verdict("safe", None, "no rule matched")
        return queries.withColumn("v", quick_risk(F.col(query))).withColumn("v", F.coalesce("v", safe)).select("*", "v.*").drop("v")
    names = ["verdict", "risk_category", "reasoning", "sanitized_query"]
    schema = T.StructType(queries.schema.fields + [T.StructField(n, T.StringType()) for n in names])

    def verdicts(texts: list[str]) -> list[tuple]:
        """One call for a batch; if that fails, one per text, so that only the texts that cannot be classified are blocked."""
        try:
            found = [tuple(x) for x in classify_fn(texts)]
            if len(found) == len(texts):
                return found
            raise ValueError(f"{len(found)} verdicts for {len(texts)} texts")
        except Exception as e:  # a failing classifier must block
            if len(texts) > 1:
                return [x for text in texts for x in verdicts([text])]
            return [("blocked", "social_engineering", f"Classification failed: {str(e)[:100]}. Blocking for safety.", None)]

    def classify(batches):
        for pdf in batches:
            out = [row + (None,) * (4 - len(row)) for row in verdicts(pdf[query].tolist())] if len(pdf) else []
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    risky = has_risk_phrase(F.col(query))
    hit = queries.filter(risky).withColumn("v", quick_risk(F.col(query))).select("*", "v.*").drop("v")
    return hit.unionByName(queries.filter(~F.coalesce(risky, F.lit(False))).mapInPandas(classify, schema))


def guard_events(guarded: DataFrame, query: str = "query", ts: str = "ts", session: str = "session_id", actor: str = "system") -> DataFrame:
    """RECEIVED, then BLOCKED and SECURITY_VIOLATION, or APPROVED, per guarded query."""
    q, t, s = F.col(query), F.col(ts), F.col(session)
    blocked = F.col("verdict") == "blocked"
    category = F.coalesce("risk_category", F.lit("unknown"))
    why = {"category": category, "reasoning": F.col("reasoning")}
    return events_of(
        guarded, audit_event("QUERY_RECEIVED", t, s, actor, query=q, mode=F.lit("guard")),
        F.when(blocked, audit_event("QUERY_BLOCKED", t, s, actor, query=q, **why)),
        F.when(blocked, audit_event("SECURITY_VIOLATION", t, s, actor, query=q, **why)),
        F.when(~blocked, audit_event("QUERY_APPROVED", t, s, actor, query=q)))


def needs_clarification(text: Column) -> Column:
    return F.length(strip_ws(text)) < 10


def intent_rules(turns: DataFrame, plan: Column) -> DataFrame:
    """Intent per user turn. Building or improving needs an earlier plan turn, else clarification.

    The first plan per conversation is a small aggregate, so no window runs over a whole conversation.
    """
    first = turns.filter(plan).groupBy("conv_id").agg(F.min("turn").alias("first_plan"))
    low = F.lower("text")
    had_plan = F.coalesce(F.col("turn") > F.col("first_plan"), F.lit(False))
    cases = []
    for intent, phrases, needs in R.INTENT_PHRASES:
        said = F.lit(False)
        for p in phrases:
            said = said | low.contains(p)
        value = F.when(had_plan, F.lit(intent)).otherwise(F.lit("clarification")) if needs else F.lit(intent)
        cases.append((said, value))
    cases.append((needs_clarification(F.col("text")), F.lit("clarification")))
    return turns.filter("role = 'user'").join(first, "conv_id", "left").select(
        "conv_id", "turn", F.coalesce(first_hit(cases), F.lit("question")).alias("intent"), had_plan.alias("had_plan"))
