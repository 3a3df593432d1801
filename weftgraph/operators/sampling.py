"""Style samples: similar files, name collisions, first sample per pattern, convention files.

Candidate lists are cut per group before the join to a length that provably still holds every winner, so a hot
(repo, extension) group never meets its targets pairwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import rules as R
from weftgraph.functions.scalar import dir_name, file_ext, file_name, file_stem
from weftgraph.plans.scale import top_rows


def with_parts(df: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return df.withColumns({"dir": dir_name(p), "name": file_name(p), "ext": file_ext(p)})


def families(name: Column) -> Column:
    """Suffix families of a file name as target."""
    return F.array_compact(F.array(*[F.when(name.endswith(s), F.lit(s)) for s in R.SUFFIX_FAMILIES]))


def _member_families(name: Column) -> Column:
    tests = [F.when((name == s) if s in R.EXACT_NAME_FAMILIES else name.endswith(s), F.lit(s)) for s in R.SUFFIX_FAMILIES]
    return F.array_compact(F.array(*tests))


def _shortlist(files: DataFrame, group: list[str], n: int) -> DataFrame:
    """Files that can be among the first n of their group once one directory and one name are left out.

    A winner has fewer than n winners before it, so it is among the first n + 1 of its directory and of its name;
    of those at most n + 1 lie in the left-out directory and n + 1 carry the left-out name.
    """
    by_dir = top_rows(files, [*group, "dir"], [F.col("path")], n + 1, "_d")
    by_name = top_rows(by_dir, [*group, "name"], [F.col("path")], n + 1, "_n")
    return top_rows(by_name, group, [F.col("path")], 3 * n + 2, "_r").drop("_d", "_n", "_r")


def similar_files(targets: DataFrame, files: DataFrame, n: int = 3) -> DataFrame:
    """Top n per target (repo, target): same directory and extension 10, same suffix family 5, same extension 1 only
    while fewer than n others exist. Best score per file, ties by path."""
    t = with_parts(targets.select("repo", "target").distinct(), "target")
    f = with_parts(files.select("repo", "path").distinct())
    near = top_rows(f, ["repo", "dir", "ext"], [F.col("path")], n + 1, "_r").select("repo", "dir", "ext", "path", F.col("name").alias("found"))
    same_dir = t.join(near, ["repo", "dir", "ext"]).filter("found <> name").select("repo", "target", "path", F.lit(10).alias("score"))
    members = f.select("*", F.explode(_member_families(F.col("name"))).alias("family"))
    fam_list = _shortlist(members, ["repo", "family"], n).select("repo", "family", "path", F.col("name").alias("found"), F.col("dir").alias("at"))
    asked = t.select("*", F.explode(families(F.col("name"))).alias("family"))
    family = asked.join(fam_list, ["repo", "family"]).filter("found <> name and at <> dir").select("repo", "target", "path", F.lit(5).alias("score"))
    # at most n - 1 family files may precede the fillers that are needed, so 2n places are enough
    ext_list = _shortlist(f, ["repo", "ext"], 2 * n).select("repo", "ext", "path", F.col("name").alias("found"), F.col("dir").alias("at"))
    weak = t.join(ext_list, ["repo", "ext"]).filter("found <> name and at <> dir").select("repo", "target", "path", F.lit(1).alias("score"))
    best = same_dir.unionByName(family).unionByName(weak).groupBy("repo", "target", "path").agg(F.max("score").alias("score"))
    return top_rows(best, ["repo", "target"], [F.desc("score"), F.col("path")], n)


def head_lines(content: Column, n: int, notice: Column | None = None) -> Column:
    lines = F.split(content, "\n")
    cut = F.array_join(F.slice(lines, 1, n), "\n")
    return F.when(F.size(lines) > n, F.concat(cut, notice) if notice is not None else cut).otherwise(content)


def samples(similar: DataFrame, files: DataFrame, n: int = 3, max_lines: int = 300) -> DataFrame:
    """Sample texts per repo: distinct over its targets, at most 2n, each cut at ``max_lines`` with a notice."""
    firsts = similar.groupBy("repo", "path").agg(F.min(F.struct("target", "rank")).alias("first"))
    kept = top_rows(firsts, ["repo"], [F.col("first.target"), F.col("first.rank"), F.col("path")], 2 * n, "position")
    total = F.size(F.split("content", "\n"))
    notice = F.concat(F.lit("\n... (truncated, "), total, F.lit(" total lines)"))
    return kept.drop("first").join(files.select("repo", "path", "content"), ["repo", "path"]).select(
        "repo", "position", "path", head_lines(F.col("content"), max_lines, notice).alias("sample"))


def name_collisions(targets: DataFrame, files: DataFrame, n: int = 3) -> DataFrame:
    """Other files with the same lower-case stem and extension, the first n per target as one short text."""
    def keyed(df: DataFrame, path: str) -> DataFrame:
        return df.select("repo", path).distinct().withColumns({"stem": F.lower(file_stem(F.col(path))), "ext": file_ext(F.col(path))})

    listed = top_rows(keyed(files, "path"), ["repo", "stem", "ext"], [F.col("path")], n + 1, "_r").drop("_r")
    pairs = keyed(targets, "target").join(listed, ["repo", "stem", "ext"]).filter("path <> target")
    head = top_rows(pairs, ["repo", "target"], [F.col("path")], n)
    return head.groupBy("repo", "target").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("similar"))


def first_samples(files: DataFrame, max_lines: int = 100) -> DataFrame:
    """First file per repo and sample pattern of its language, cut at the first lines."""
    tests = [F.when((F.col("kind") == kind) & F.col("path").rlike(p), F.lit(d)) for kind, p, d in R.SAMPLE_PATTERNS]
    kind = F.when(F.col("language") == "java", "java").otherwise("typescript")
    hits = files.withColumn("kind", kind).select("repo", "path", "content", F.explode(F.array_compact(F.array(*tests))).alias("pattern"))
    lines = F.slice(F.split("content", "\n"), 1, max_lines)
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) == max_lines, F.lit("\n... (truncated)")).otherwise(F.lit("")))
    return hits.groupBy("repo", "pattern").agg(F.min("path").alias("path"), F.min_by(text, "path").alias("sample"))


def convention_file(files: DataFrame) -> DataFrame:
    """First existing convention file per repo; a README only when it speaks of conventions or style."""
    names = R.CONVENTION_FILES
    rank = reduce(lambda acc, x: F.when(F.col("path") == x[1], F.lit(x[0])).otherwise(acc), enumerate(names), F.lit(None).cast("int"))
    low = F.lower("content")
    readme = (F.col("path") == "README.md") & (low.contains("convention") | low.contains("style"))
    ranked = files.withColumn("prio", F.coalesce(rank, F.when(readme, F.lit(len(names))))).filter("prio is not null")
    best = ranked.groupBy("repo").agg(F.min_by(F.struct("path", "content", "prio"), "prio").alias("b")).select("repo", "b.*")
    cut = F.when(F.length("content") > 5000, F.concat(F.substring("content", 1, 5000), F.lit("\n\n... (truncated)"))).otherwise(F.col("content"))
    return best.select("repo", "path", F.when(F.col("prio") < len(names), cut).otherwise(head_lines(F.col("content"), 200)).alias("text"))
