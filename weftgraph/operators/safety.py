"""Content-safety jobs: tables in, violation tables out. Row-wise over whole texts, no shuffle before the summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import rules as R
from weftgraph.functions.scalar import dir_name, file_name, shannon_entropy, string_literals


def scan_secrets(df: DataFrame, content: str = "content", rules: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """One row per text and rule that hits; keeps the other columns, adds rule (order), label, hard."""
    rules = R.SECRET_RULES if rules is None else rules
    hits = [
        F.when(F.col(content).rlike(pattern), F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(hard).alias("hard")))
        for i, (pattern, label, hard) in enumerate(rules)
    ]
    kept = [c for c in df.columns if c != content]
    return df.select(*kept, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*kept, "hit.rule", "hit.label", "hit.hard")


_EXCLUDED = "(?i)\\A(?:" + "|".join(R.ENTROPY_EXCLUSIONS) + ")\\z"


def _excerpt(literal: Column) -> Column:
    return F.when(F.length(literal) > 20, F.concat(F.substring(literal, 1, 20), F.lit("..."))).otherwise(literal)


def scan_entropy(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per quoted literal of 20+ characters above the warning entropy."""
    kept = [c for c in df.columns if c != content]
    literals = df.select(*kept, F.posexplode(string_literals(F.col(content))).alias("pos", "literal")).filter(~F.col("literal").rlike(_EXCLUDED))
    scored = literals.withColumn("entropy", shannon_entropy(F.col("literal"))).filter(F.col("entropy") > R.ENTROPY_WARN)
    return scored.withColumns({
        "hard": F.col("entropy") > R.ENTROPY_HARD,
        "excerpt": _excerpt(F.col("literal")),
    })


def is_binary(c: Column) -> Column:
    controls = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return c.contains("\u0000") | ((F.length(c) > 0) & (controls / F.length(c) > 0.1))


def _binary_reason(c: Column) -> Column:
    return F.when(c.contains("\u0000"), "contains null bytes").otherwise("high concentration of control characters")


def scan_binary(df: DataFrame, content: str = "content") -> DataFrame:
    c = F.col(content)
    return df.filter(is_binary(c)).withColumn("reason", _binary_reason(c)).drop(content)


def _normalised(path: Column) -> Column:
    """Parts of a path after ``.`` and ``..``; a NULL entry marks a step above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(
        F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)))


def scan_paths(df: DataFrame, path: str = "path", root: str = "/repo") -> DataFrame:
    """Rows (…, rule) for paths outside the root, sensitive names and repository configuration files."""
    p = F.col(path)
    absolute = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    base = [x for x in root.split("/") if x]
    # columns of their own: the parts are worked out once a row, not once for every name they are compared with
    split = df.withColumn("_parts", _normalised(absolute))
    split = split.withColumns({"_name": F.lower(F.element_at("_parts", -1)), "_lowered": F.transform("_parts", F.lower),
                               "_rel": F.array_join(F.slice("_parts", len(base) + 1, 1 << 20), "/")})
    parts, name, rel = F.col("_parts"), F.col("_name"), F.col("_rel")
    inside = F.slice(parts, 1, len(base)) == F.array(*[F.lit(x) for x in base]) if base else F.lit(True)
    sensitive = reduce(lambda a, b: a | b, [name.contains(s) | F.array_contains("_lowered", s) for s in R.SENSITIVE_NAMES])
    config = reduce(lambda a, b: a | b, [rel.startswith(s) for s in R.REPO_CONFIG_PATHS]) | F.array_contains(F.split(rel, "/"), ".git")
    rules = F.array_compact(F.array(
        F.when(~inside, F.lit("outside_root")), F.when((F.size(parts) > 0) & sensitive, F.lit("sensitive_name")),
        F.when(inside & config, F.lit("repo_config"))))
    return split.select(*df.columns, F.explode(rules).alias("rule"))


def scan_content(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """All content rules as one violations table (key, kind, label, hard), in one pass over the texts."""
    c = F.col(content)

    def item(kind: str, label: Column, hard: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), hard.alias("hard"))

    secrets = F.array_compact(F.array(*[F.when(c.rlike(p), item("secret", F.lit(label), F.lit(hard))) for p, label, hard in R.SECRET_RULES]))
    scored = F.transform(F.filter(string_literals(c), lambda s: ~s.rlike(_EXCLUDED)), lambda s: F.struct(s.alias("s"), shannon_entropy(s).alias("e")))
    entropy = F.transform(F.filter(scored, lambda x: x["e"] > R.ENTROPY_WARN), lambda x: item("entropy", _excerpt(x["s"]), x["e"] > R.ENTROPY_HARD))
    binary = F.when(is_binary(c), F.array(item("binary", _binary_reason(c), F.lit(True)))).otherwise(
        F.array().cast("array<struct<kind:string,label:string,hard:boolean>>"))  # not a piece of the others: their rules would be run again
    return df.select(key, F.explode(F.concat(binary, secrets, entropy)).alias("v")).select(key, "v.kind", "v.label", "v.hard")


def scan_summary(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Every text with its violation counts; safe means no hard violation, a null text counts as empty. One pass, no shuffle."""
    df = df.withColumn(content, F.coalesce(F.col(content), F.lit("")))
    c = F.col(content)
    scores = F.transform(F.filter(string_literals(c), lambda s: ~s.rlike(_EXCLUDED)), shannon_entropy)
    counted = df.select(
        key, is_binary(c).cast("int").alias("b"), scores.alias("scores"),
        reduce(lambda a, b: a + b, [F.when(c.rlike(p), 1).otherwise(0) for p, _, hard in R.SECRET_RULES if hard]).alias("h"),
        reduce(lambda a, b: a + b, [F.when(c.rlike(p), 1).otherwise(0) for p, _, hard in R.SECRET_RULES if not hard]).alias("s"))
    high = F.size(F.filter("scores", lambda e: e > R.ENTROPY_HARD))
    warm = F.size(F.filter("scores", lambda e: (e > R.ENTROPY_WARN) & (e <= R.ENTROPY_HARD)))
    return counted.select(key, (F.col("b") + F.col("h") + high).alias("hard"), (F.col("s") + warm).alias("soft"),
                          (F.col("b") + F.col("h") + high == 0).alias("is_safe"))


def redact(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, "(?i)" + r[0], r[1]), R.REDACTIONS if rules is None else rules, c)


def redacted(df: DataFrame, content: str = "content") -> DataFrame:
    clean = df.withColumn("clean", redact(F.col(content)))
    return clean.withColumn("changed", F.col("clean") != F.col(content))


def check_file_count(changes: DataFrame, limit: int = R.MAX_FILES_PER_REPO) -> DataFrame:
    return changes.groupBy("repo").agg(F.countDistinct("file_path").alias("files")).select(
        "repo", "files", F.lit(limit).alias("limit"), (F.col("files") > limit).alias("violation"))


def check_diff_size(changes: DataFrame, limit: int = R.MAX_DIFF_LINES) -> DataFrame:
    """``changes``: repo, lines_added, lines_removed."""
    sums = changes.groupBy("repo").agg(F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed"))
    return sums.select("repo", "added", "removed", F.lit(limit).alias("limit"), (F.col("added") + F.col("removed") > limit).alias("violation"))


def check_branches(refs: DataFrame, ref: str = "ref", prefix: str = R.BRANCH_PREFIX, slugs: list[str] | None = None,
                   bases: list[str] | None = None) -> DataFrame:
    """Rows (…, rule) per broken rule. Optional columns ``base_branch`` and ``repo_slug`` are checked when present."""
    r = F.col(ref)
    last = F.substring_index(r, "/", -1)
    escaped = "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in prefix)
    checks = [
        F.when(r.isin(R.PROTECTED_BRANCHES) | last.isin(R.PROTECTED_BRANCHES), F.lit("protected")),
        F.when(~r.rlike(rf"\A{escaped}/[a-z0-9-]+/[0-9]{{8}}-[0-9]{{6}}\z"), F.lit("name_pattern")),
        F.when(r.startswith("refs/tags/") | r.startswith("v") | r.startswith("release-"), F.lit("tag")),
        F.when(r.startswith("+"), F.lit("force_push")),
    ]
    if "base_branch" in refs.columns:
        checks.append(F.when(~F.col("base_branch").isin(bases or R.ALLOWED_BASE_BRANCHES), F.lit("base_branch")))
    if "repo_slug" in refs.columns and slugs is not None:
        checks.append(F.when(~F.col("repo_slug").isin(slugs), F.lit("repo_slug")))
    return refs.select("*", F.explode(F.array_compact(F.array(*checks))).alias("rule"))


def check_authors(commits: DataFrame, email: str = "author_email", org: str | None = None) -> DataFrame:
    allowed = ([f"@{org.lower()}.com"] if org else []) + R.AUTHOR_PATTERNS
    ok = reduce(lambda a, b: a | b, [F.lower(F.col(email)).contains(p) for p in allowed])
    return commits.withColumn("allowed", ok)

