"""Conversation windows and summaries; a system turn stands for a turn with a plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import memory as M
from weftgraph.plans.views import sql_over, table

TURN_SQL = """SELECT conv_id, turn, role, text, CASE WHEN role = 'system' THEN NULL WHEN turn % 3 = 0 THEN 'question' ELSE 'plan_request' END AS intent,
  CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN concat('Plan ', conv_id) END AS plan_title, role = 'system' AS has_plan,
  CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN CAST(turn AS INT) END AS pr_count FROM conversations"""


def turns(spark, sf_dir):
    return sql_over(spark, sf_dir, TURN_SQL, ["conversations"])


def last_turns(spark, sf_dir):
    return M.last_turns(turns(spark, sf_dir))


def last_plan(spark, sf_dir):
    return M.last_where(turns(spark, sf_dir), F.col("has_plan"), "text")


def last_pr_results(spark, sf_dir):
    return M.last_where(turns(spark, sf_dir), F.col("pr_count").isNotNull(), "pr_count")


def context_window(spark, sf_dir):
    return M.context_window(turns(spark, sf_dir), F.col("has_plan"), 4).select("conv_id", "turn", "role")


def messages(spark, sf_dir):
    return M.to_messages(turns(spark, sf_dir), F.col("has_plan"), 4)


def history_summary(spark, sf_dir):
    return M.history_summary(turns(spark, sf_dir))


def turn_counts(spark, sf_dir):
    return M.turn_counts(turns(spark, sf_dir))


def append_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    new = t.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), F.lit("user").alias("role"), F.col("n").cast("string").alias("text"))
    return M.append_turns(t, new).select("conv_id", "turn", "role", "text")


def clear_conversations(spark, sf_dir):
    gone = table(spark, sf_dir, "conversations").filter("role = 'system'").select("conv_id")
    return M.clear_conversation(turns(spark, sf_dir), gone).select("conv_id", "turn")


QUERIES = {f.__name__: f for f in (
    last_turns, last_plan, last_pr_results, context_window, messages, history_summary, turn_counts, append_turns, clear_conversations)}

_T = f"WITH t AS ({TURN_SQL})"
_WINDOW = _T + """, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, max(turn) FILTER (has_plan) OVER (PARTITION BY conv_id) AS pin FROM t),
  s AS (SELECT conv_id, min(turn) AS start FROM b WHERE back <= 4 GROUP BY conv_id),
  win AS (SELECT b.* FROM b JOIN s USING (conv_id) WHERE back <= 4 OR (turn = pin AND pin < start))"""
ORACLES = {
    "last_turns": _T + """ SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, role,
        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM t QUALIFY back <= 6""",
    "last_plan": _T + " SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM t WHERE has_plan GROUP BY conv_id",
    "last_pr_results": _T + " SELECT conv_id, max(turn) AS turn, arg_max(pr_count, turn) AS pr_count FROM t WHERE pr_count IS NOT NULL GROUP BY conv_id",
    "context_window": _WINDOW + " SELECT conv_id, turn, role FROM win",
    "messages": _WINDOW + """ SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS message_type, text AS content FROM win""",
    "history_summary": _T + """, g AS (SELECT conv_id, count(*) AS n, max(turn) FILTER (has_plan) AS pt, arg_max(coalesce(plan_title, ''), turn) FILTER (has_plan) AS title,
          arg_max(pr_count, turn) FILTER (pr_count IS NOT NULL) AS pr FROM t GROUP BY conv_id),
        l AS (SELECT conv_id, string_agg(intent, ', ' ORDER BY turn) AS acts FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) WHERE intent IS NOT NULL GROUP BY conv_id)
        SELECT conv_id, 'Conversation has ' || n || ' turns so far.' || coalesce(' ' || CASE WHEN pt IS NOT NULL THEN CASE WHEN title <> '' THEN 'Most recent plan: "' || title || '".' ELSE 'An implementation plan was generated.' END
          WHEN pr > 0 THEN 'PRs were created: ' || pr || ' result(s).' WHEN acts IS NOT NULL THEN 'Recent activity: ' || acts || '.' END, '') AS summary FROM g LEFT JOIN l USING (conv_id)""",
    "turn_counts": _T + " SELECT conv_id, count(*) AS turns FROM t GROUP BY conv_id",
    "append_turns": _T + """ SELECT conv_id, turn, role, text FROM t UNION ALL
        SELECT conv_id, m + 1 + seq, 'user', CAST(n AS VARCHAR) FROM (SELECT conv_id, max(turn) AS m, count(*) FILTER (role = 'user') AS n FROM t GROUP BY conv_id) x, (VALUES (0), (1)) s(seq) WHERE n > 0""",
    "clear_conversations": _T + " SELECT conv_id, turn FROM t WHERE conv_id NOT IN (SELECT conv_id FROM t WHERE role = 'system')",
}
