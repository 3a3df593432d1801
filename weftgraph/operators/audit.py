"""Audit events: typed builders, denial and guard events, session tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import rules as R
from weftgraph.functions.scalar import query_hash
from weftgraph.plans.scale import top_rows

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("actor", T.StringType()),
    T.StructField("query_hash", T.StringType()), T.StructField("repo", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("verdict", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType()),
])
# details that each typed event carries
DETAILS = {
    "QUERY_RECEIVED": ["mode"], "QUERY_BLOCKED": ["category", "reasoning"], "QUERY_APPROVED": [],
    "FILE_WRITE": ["is_new", "lines_added", "lines_removed"], "FILE_DELETE": [],
    "BRANCH_CREATED": ["branch_name", "base"], "COMMIT_CREATED": ["commit_sha", "file_count"],
    "PUSH_EXECUTED": ["branch_name"], "PR_CREATED": ["pr_number", "branch", "base_branch"], "PR_UPDATED": ["pr_number"],
    "SAFETY_VIOLATION": [], "SECURITY_VIOLATION": ["category", "reasoning"],
    "RATE_LIMIT_EXCEEDED": ["resource", "limit", "current"], "ROLLBACK": ["files_restored", "reason"],
    "SESSION_START": [], "SESSION_END": [],
}
VERDICTS = {"QUERY_BLOCKED": "blocked", "QUERY_APPROVED": "approved"}


def audit_event(event_type: str, ts: Column, session: Column, actor: str = "system", query: Column | None = None,
                repo: Column | None = None, file_path: Column | None = None, error: Column | None = None,
                **details: Column) -> Column:
    """One typed event as a struct of AUDIT_SCHEMA. Reasoning is cut at 500 characters; empty fields stay NULL."""
    if event_type not in R.AUDIT_TYPES:
        raise ValueError(f"unknown event type {event_type}")
    allowed = DETAILS[event_type]
    unknown = set(details) - set(allowed) if event_type != "SAFETY_VIOLATION" else set()
    if unknown:
        raise ValueError(f"{event_type} has no details {sorted(unknown)}")
    null = F.lit(None).cast("string")

    def text(name: str, c: Column) -> Column:
        return F.substring(c, 1, 500) if name == "reasoning" else c.cast("string")

    pairs = [x for name, c in details.items() for x in (F.lit(name), text(name, c))]
    if event_type == "RATE_LIMIT_EXCEEDED" and error is None:
        error = F.concat(F.lit("Rate limit exceeded for "), details["resource"])
    if event_type == "SECURITY_VIOLATION" and error is None:
        error = F.concat(F.lit("Query blocked: "), details["category"])
    filled = {
        "query_hash": null if query is None else F.when(query != "", query_hash(query)),
        "repo": null if repo is None else F.nullif(repo, F.lit("")),
        "file_path": null if file_path is None else F.nullif(file_path, F.lit("")),
        "verdict": F.lit(VERDICTS.get(event_type)).cast("string"),
        "details": F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"),
        "error": null if error is None else error,
    }
    stamp = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.struct(stamp.alias("timestamp"), session.cast("string").alias("session_id"), F.lit(event_type).alias("event_type"),
                    F.lit(actor).alias("actor"), *[c.alias(n) for n, c in filled.items()])


def events_of(df: DataFrame, *events: Column) -> DataFrame:
    """Explode event structs (NULL ones are skipped) into audit rows; ``step`` keeps their order."""
    rows = df.select(F.posexplode(F.array(*events)).alias("step", "e")).filter("e is not null")
    return rows.select("step", "e.*")


def denial_events(decisions: DataFrame, actor: str = "system") -> DataFrame:
    """RATE_LIMIT_EXCEEDED rows for denied decisions: session_id, ts, resource, limit, current, allowed."""
    denied = decisions.filter("not allowed")
    return events_of(denied, audit_event(
        "RATE_LIMIT_EXCEEDED", F.col("ts"), F.col("session_id"), actor, resource=F.col("resource"), limit=F.col("limit"), current=F.col("current")))


def session_tail(events: DataFrame, n: int = 100, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Last ``n`` events per session; ``position`` counts backwards from the newest."""
    return top_rows(events, ["session_id"], [F.desc(c) for c in order], n, "position")
