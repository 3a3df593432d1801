"""Rate limits, audit events and query rules over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import rules as R
from weftgraph.operators import audit as A
from weftgraph.operators import limits as L
from weftgraph.operators import policy as P
from weftgraph.plans.views import sql_over, table

LIMITS = {"click": 10, "view": 8, "purchase": 5}
TOKEN_LIMIT = 600
BUILD_LIMIT = 1


def log(spark, sf_dir):
    """Events as a log: session = user, resource = event type, tokens = value rounded down."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("resource"),
        F.floor("value").cast("bigint").alias("tokens"),
        F.when(F.col("event_type") == "error", "gpt-4o").when(F.col("event_type") == "view", "gpt-4o-mini").otherwise("other").alias("model"))


def count_limits(spark, sf_dir):
    return L.limit_counts(log(spark, sf_dir), LIMITS).select("session_id", "event_id", "resource", "limit", "allowed", "current")


def build_rate(spark, sf_dir):
    return L.trailing_counts(log(spark, sf_dir)).select("session_id", "event_id", "recent")


def build_rate_blocks(spark, sf_dir):
    """The same through range-split blocks, as for a hot session."""
    return L.trailing_counts(log(spark, sf_dir), max_rows=40, blocks=8).select("session_id", "event_id", "recent")


def build_limit(spark, sf_dir):
    return L.limit_builds(log(spark, sf_dir), BUILD_LIMIT).select("session_id", "event_id", "allowed", "current")


def token_budget(spark, sf_dir):
    return L.limit_tokens(log(spark, sf_dir), TOKEN_LIMIT).select("session_id", "event_id", "tokens", "allowed", "projected")


def token_budget_blocks(spark, sf_dir):
    return L.limit_tokens(log(spark, sf_dir), TOKEN_LIMIT, max_rows=40, blocks=8).select("session_id", "event_id", "tokens", "allowed", "projected")


def usage_summary(spark, sf_dir):
    return L.usage_summary(L.counted_usage(log(spark, sf_dir), LIMITS), LIMITS)


def session_cost(spark, sf_dir):
    return L.cost(log(spark, sf_dir))


def denials(spark, sf_dir):
    d = A.denial_events(L.limit_counts(log(spark, sf_dir), LIMITS))
    return d.select("timestamp", "session_id", "event_type", "error", F.col("details")["limit"].alias("lim"), F.col("details")["current"].alias("cur"))


def session_reset(spark, sf_dir):
    events = log(spark, sf_dir)
    return L.reset(events, events.filter("resource = 'signup'")).select("session_id", "event_id", "resource")


def session_tail(spark, sf_dir):
    return A.session_tail(log(spark, sf_dir), 20).select("session_id", "event_id", "position")


def typed_events(spark, sf_dir):
    """File writes and commits of orders as typed audit rows."""
    o = table(spark, sf_dir, "orders")
    ts, session = F.col("o_orderdate"), F.col("o_custkey")
    rows = A.events_of(
        o, A.audit_event("FILE_WRITE", ts, session, repo=F.col("o_orderstatus"), file_path=F.col("o_orderpriority"),
                         is_new=F.col("o_orderstatus") == "O", lines_added=F.col("o_orderkey"), lines_removed=F.lit(0)),
        F.when(F.col("o_orderstatus") == "F", A.audit_event("COMMIT_CREATED", ts, session, repo=F.col("o_orderstatus"),
                                                            commit_sha=F.col("o_orderkey"), file_count=F.lit(1))))
    return rows.select("timestamp", "session_id", "event_type", "actor", "repo", "file_path",
                       F.col("details")["lines_added"].alias("added"), F.col("details")["commit_sha"].alias("sha"))


_PHRASES = [p for p, _, _ in R.RISK_PHRASES] + ["Force Push To Main now, no restrictions", "fix the login bug", "", "update the README"]
_INTENTS = [p for _, ps, _ in R.INTENT_PHRASES for p in ps] + ["nothing"]


def _pick(items: list[str], index: str) -> str:
    def quoted(v: str) -> str:
        return "concat(" + ", chr(39), ".join(f"'{x}'" for x in v.split("'")) + ")"

    return f"CASE ({index}) % {len(items)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(items)) + " END"


# Each turn's whole text, followed by one phrase from the rule lists, and a short last turn for every conversation; both engines run these texts.
ASKED_SQL = f"SELECT conv_id, turn, concat(text, ' ', {_pick(_PHRASES, 'conv_id * 7 + turn')}) AS query FROM conversations"
TURN_SQL = f"""SELECT conv_id, turn, role, concat(text, ' ', {_pick(_INTENTS, 'conv_id * 5 + turn')}) AS text FROM conversations
  UNION ALL SELECT conv_id, max(turn) + 1, 'user', ' hi ' FROM conversations GROUP BY conv_id"""


def asked(spark, sf_dir):
    return sql_over(spark, sf_dir, ASKED_SQL, ["conversations"])


def quick_risk(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", P.quick_risk(F.col("query")).alias("v")).select(
        "conv_id", "turn", "v.verdict", "v.risk_category", "v.reasoning")


def _classify(texts):
    return [("blocked", "scope_explosion", "many words", None) if len(t.split()) > 60 else ("safe", None, "short", None) for t in texts]


def guard(spark, sf_dir):
    return P.guard(asked(spark, sf_dir), classify_fn=_classify).select("conv_id", "turn", "verdict", "risk_category", "reasoning")


def guard_events(spark, sf_dir):
    queries = asked(spark, sf_dir).select("conv_id", "turn", "query", F.col("conv_id").alias("session_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"))
    rows = P.guard_events(P.guard(queries))
    return rows.select("step", "timestamp", "session_id", "event_type", "query_hash", "verdict", "error", F.col("details")["category"].alias("category"))


def turns(spark, sf_dir):
    return sql_over(spark, sf_dir, TURN_SQL, ["conversations"])


def intent_rules(spark, sf_dir):
    return P.intent_rules(turns(spark, sf_dir), F.col("role") == "system")


def clarification(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", P.needs_clarification(F.col("text")).alias("needs_clarification"))


QUERIES = {f.__name__: f for f in (
    count_limits, build_rate, build_rate_blocks, build_limit, token_budget, token_budget_blocks, usage_summary, session_cost,
    denials, session_reset, session_tail, typed_events, quick_risk, guard, guard_events, intent_rules, clarification)}

_LOG = """WITH RECURSIVE lim(resource, lim) AS (VALUES ('click', 10), ('view', 8), ('purchase', 5)),
 log AS (SELECT user_id AS session_id, event_id, ts, event_type AS resource, CAST(floor(value) AS BIGINT) AS tokens,
   CASE event_type WHEN 'error' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-4o-mini' ELSE 'other' END AS model FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM log)"""
_COUNTS = _LOG + """, c AS (SELECT session_id, event_id, ts, resource, lim, row_number() OVER (PARTITION BY session_id, resource ORDER BY ts, event_id) AS r
   FROM log JOIN lim USING (resource)), d AS (SELECT *, r <= lim AS allowed, least(r - 1, lim) AS current FROM c)"""
_RATE = _LOG + """ SELECT session_id, event_id, count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM log"""
_BUDGET = _LOG + f""", f AS (SELECT session_id, event_id, rn, tokens, tokens <= {TOKEN_LIMIT} AS allowed, tokens AS projected, CASE WHEN tokens <= {TOKEN_LIMIT} THEN tokens ELSE 0 END AS total FROM o WHERE rn = 1
   UNION ALL SELECT o.session_id, o.event_id, o.rn, o.tokens, f.total + o.tokens <= {TOKEN_LIMIT}, f.total + o.tokens, CASE WHEN f.total + o.tokens <= {TOKEN_LIMIT} THEN f.total + o.tokens ELSE f.total END
   FROM f JOIN o ON o.session_id = f.session_id AND o.rn = f.rn + 1) SELECT session_id, event_id, tokens, allowed, projected FROM f"""


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {default} END"


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_HITS = [(f"contains(lower(query), {_lit(p)})", c, f"{w}: '{p}'") for p, c, w in R.RISK_PHRASES]
_RISK = f"""q AS ({ASKED_SQL}), r AS (SELECT *, {_case([(t, _lit('blocked')) for t, _, _ in _HITS], 'NULL')} AS verdict,
  {_case([(t, _lit(c)) for t, c, _ in _HITS], 'NULL')} AS risk_category, {_case([(t, _lit(w)) for t, _, w in _HITS], 'NULL')} AS reasoning FROM q)"""
_INTENT = _case(
    [("(" + " OR ".join(f"contains(lower(text), {_lit(p)})" for p in ps) + ")",
      f"CASE WHEN had THEN '{i}' ELSE 'clarification' END" if needs else f"'{i}'") for i, ps, needs in R.INTENT_PHRASES]
    + [("length(trim(text)) < 10", "'clarification'")], "'question'")

ORACLES = {
    "count_limits": _COUNTS + " SELECT session_id, event_id, resource, lim AS \"limit\", allowed, current FROM d",
    "build_rate": _RATE, "build_rate_blocks": _RATE,
    "build_limit": _LOG + f""", f AS (SELECT session_id, event_id, rn, true AS allowed, 0 AS current, [ts] AS st FROM o WHERE rn = 1
       UNION ALL SELECT session_id, event_id, rn, len(l) < {BUILD_LIMIT}, len(l), CASE WHEN len(l) < {BUILD_LIMIT} THEN list_append(l, ts) ELSE l END
       FROM (SELECT o.session_id, o.event_id, o.rn, o.ts, list_filter(f.st, lambda x: x > o.ts - INTERVAL 1 HOUR) AS l FROM f JOIN o ON o.session_id = f.session_id AND o.rn = f.rn + 1) z)
       SELECT session_id, event_id, allowed, current FROM f""",
    "token_budget": _BUDGET, "token_budget_blocks": _BUDGET,
    "usage_summary": _COUNTS + """ SELECT s.session_id, l.resource, l.lim AS "limit", count(d.event_id) FILTER (allowed) AS current, greatest(0, l.lim - count(d.event_id) FILTER (allowed)) AS remaining
       FROM (SELECT DISTINCT session_id FROM d) s CROSS JOIN lim l LEFT JOIN d ON d.session_id = s.session_id AND d.resource = l.resource GROUP BY s.session_id, l.resource, l.lim""",
    "session_cost": _LOG + """ SELECT session_id, model, sum(tokens) AS tokens, round(sum(tokens) / 1000000.0::DOUBLE * CASE model WHEN 'gpt-4o' THEN 7.5::DOUBLE WHEN 'gpt-4o-mini' THEN 0.3::DOUBLE ELSE 10.0::DOUBLE END, 4) AS usd
       FROM log GROUP BY session_id, model""",
    "denials": _COUNTS + """ SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, CAST(session_id AS VARCHAR) AS session_id, 'RATE_LIMIT_EXCEEDED' AS event_type,
       'Rate limit exceeded for ' || resource AS error, CAST(lim AS VARCHAR) AS lim, CAST(current AS VARCHAR) AS cur FROM d WHERE NOT allowed""",
    "session_reset": _LOG + """ SELECT session_id, event_id, resource FROM log l WHERE ts >= coalesce((SELECT max(ts) FROM log s WHERE s.session_id = l.session_id AND s.resource = 'signup'), ts)""",
    "session_tail": _LOG + " SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS position FROM log QUALIFY position <= 20",
    "typed_events": """WITH e AS (SELECT *, unnest(['FILE_WRITE', CASE WHEN o_orderstatus = 'F' THEN 'COMMIT_CREATED' END]) AS event_type FROM orders)
       SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, CAST(o_custkey AS VARCHAR) AS session_id, event_type, 'system' AS actor, o_orderstatus AS repo,
       CASE WHEN event_type = 'FILE_WRITE' THEN o_orderpriority END AS file_path, CASE WHEN event_type = 'FILE_WRITE' THEN CAST(o_orderkey AS VARCHAR) END AS added,
       CASE WHEN event_type = 'COMMIT_CREATED' THEN CAST(o_orderkey AS VARCHAR) END AS sha FROM e WHERE event_type IS NOT NULL""",
    "quick_risk": f"WITH {_RISK} SELECT conv_id, turn, verdict, risk_category, reasoning FROM r",
    "guard": f"""WITH {_RISK}, w AS (SELECT *, len(regexp_extract_all(query, '[^\\s]+')) > 60 AS long FROM r)
       SELECT conv_id, turn, coalesce(verdict, CASE WHEN long THEN 'blocked' ELSE 'safe' END) AS verdict,
       CASE WHEN verdict IS NULL AND long THEN 'scope_explosion' ELSE risk_category END AS risk_category,
       coalesce(reasoning, CASE WHEN long THEN 'many words' ELSE 'short' END) AS reasoning FROM w""",
    "guard_events": f"""WITH {_RISK}, e AS (SELECT *, unnest(CASE WHEN verdict = 'blocked' THEN ['QUERY_RECEIVED', 'QUERY_BLOCKED', 'SECURITY_VIOLATION'] ELSE ['QUERY_RECEIVED', 'QUERY_APPROVED'] END) AS event_type FROM r)
       SELECT CASE event_type WHEN 'QUERY_RECEIVED' THEN 0 WHEN 'QUERY_BLOCKED' THEN 1 WHEN 'SECURITY_VIOLATION' THEN 2 ELSE 3 END AS step, '2024-01-01T00:00:00.000000+00:00' AS timestamp,
       CAST(conv_id AS VARCHAR) AS session_id, event_type, substr(sha256(query), 1, 16) AS query_hash,
       CASE event_type WHEN 'QUERY_BLOCKED' THEN 'blocked' WHEN 'QUERY_APPROVED' THEN 'approved' END AS verdict,
       CASE WHEN event_type = 'SECURITY_VIOLATION' THEN 'Query blocked: ' || risk_category END AS error,
       CASE WHEN event_type IN ('QUERY_BLOCKED', 'SECURITY_VIOLATION') THEN risk_category END AS category FROM e""",
    "intent_rules": f"""WITH t AS ({TURN_SQL}), p AS (SELECT *, coalesce(turn > min(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id), false) AS had FROM t)
       SELECT conv_id, turn, {_INTENT} AS intent, had AS had_plan FROM p WHERE role = 'user'""",
    "clarification": f"SELECT conv_id, turn, length(trim(text)) < 10 AS needs_clarification FROM ({TURN_SQL})",
}
