"""File edits: latest state per file, line counts, summaries and restore sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo", "file_path"]


def latest_changes(edits: DataFrame) -> DataFrame:
    """Last write wins, original content from the first edit. Edits: repo, file_path, seq, original, new, description, is_new, is_deleted."""
    last = F.max_by(F.struct("new", "description", "is_new", "is_deleted"), "seq")
    merged = edits.groupBy(*KEY).agg(F.min_by(F.struct("original"), "seq").alias("f"), last.alias("l"))
    return merged.select(*KEY, "f.original", "l.new", "l.description", "l.is_new", "l.is_deleted")


def line_changes(changes: DataFrame) -> DataFrame:
    """Lines added and removed as a multiset difference; a moved line counts as unchanged.

    Only line digests are shuffled, and each digest only needs to be unique inside its file.
    """
    def lines(c: str):
        return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))

    def digests(c: str, sign: int):
        return F.transform(lines(c), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.lit(sign).alias("d")))

    rows = changes.select(*KEY, F.explode(F.concat(digests("new", 1), digests("original", -1))).alias("x"))
    net = rows.groupBy(*KEY, "x.h", "x.g").agg(F.sum("x.d").alias("d"))
    sums = net.groupBy(*KEY).agg(F.sum(F.greatest("d", F.lit(0))).alias("lines_added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("lines_removed"))
    return changes.drop("original", "new").join(sums, KEY, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("lines_added", "lines_removed")})


def change_summary(counted: DataFrame) -> DataFrame:
    """Per repo: modified, created, lines added and removed. File rows stay in ``counted``."""
    return counted.groupBy("repo").agg(
        F.count_if(~F.col("is_new")).alias("files_modified"), F.count_if(F.col("is_new")).alias("files_created"),
        F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"))


def repos_with_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo").agg(F.count("*").alias("changes"))


def reset(edits: DataFrame, repo: str | None = None) -> DataFrame:
    return edits.limit(0) if repo is None else edits.filter(F.col("repo") != repo)


def restore_set(changes: DataFrame, succeeded: DataFrame | None = None) -> DataFrame:
    """What undoes the changes: new files are deleted, others get their original back; optionally only some repos."""
    chosen = changes if succeeded is None else changes.join(succeeded.select("repo").distinct(), "repo", "left_semi")
    action = F.when(F.col("is_new"), "delete").when(F.col("original").isNotNull(), "restore").otherwise("none")
    return chosen.select(*KEY, action.alias("action"), F.when(action == "restore", F.col("original")).alias("content"))
